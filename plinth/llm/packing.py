"""First-fit decreasing packing with a tournament tree of bin capacities, in randomised groups of documents.

A document's ids are cut at multiples of the sequence length; full pieces are sequences of their own. What
remains of each document is placed by first-fit decreasing: the tree's inner nodes hold the largest free
capacity below them, so the leftmost bin that fits is found in logarithmic time. Only piece lengths and
checksums move: one small row a document goes to its group, texts and ids never shuffle.
"""

import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.shared import Generations, splitter

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CACHE = 120_000


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size; sizes must be in falling order and at most capacity."""
    width = 1
    while width < len(sizes):
        width *= 2
    tree = [capacity] * (2 * width)
    bins = []
    for size in sizes:
        k = 1
        while k < width:
            k *= 2
            if tree[k] < size:
                k += 1
        bins.append(k - width)
        tree[k] -= size
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            m = a if a > b else b
            if tree[k] == m:
                break
            tree[k] = m
            k >>= 1
    return bins


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ids:
    """Packed ids of texts. Matches of the split pattern are independent, so the library's model encodes each once; frequent ones are kept.

    A text that spells a special token, and all texts if the tokenizer isn't a plain byte-level one, are left to the library as a whole.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split, self.characters, model = splitter(pattern), _byte_characters(), self.tokenizer.model
        self.plain = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.cache = Generations(lambda p: array("I", [t.id for t in model.tokenize(p.encode().decode("latin-1").translate(self.characters))]).tobytes(), CACHE)

    def encode(self, text: str) -> bytes:
        if self.plain and not any(s in text for s in self.specials):
            return b"".join(map(self.cache.__getitem__, self.split(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def _ids(path: str, pattern: str) -> Ids:
    return Ids(path, pattern)


def pieces(docs: DataFrame, path: str, pattern: str, length: int, end_id: int) -> DataFrame:
    """Per document: its id, token count with the end id, and the checksums of its pieces."""

    def run(batches):
        ids = _ids(path, pattern)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                docs, counts, sums = part.column(0), [], []
                for text in part.column(1).to_pylist():
                    x = ids.encode(text or "") + end
                    counts.append(len(x) // 4)
                    sums.append(np.array([zlib.crc32(x[i : i + 4 * length]) for i in range(0, len(x), 4 * length)], "<u4").tobytes())
                yield pa.RecordBatch.from_arrays([docs, pa.array(counts, pa.int64()), pa.array(sums, pa.binary())], ["doc_id", "doc_tokens", "sums"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, doc_tokens long, sums binary")


def pack(docs: DataFrame, path: str, pattern: str, length: int = 1024, end_id: int = 0, group_docs: int = 8192, seed: int = 7) -> DataFrame:
    """Places every id of every document (doc_id, text) into sequences of at most `length` tokens.

    Null and empty texts hold the end id alone; repeated rows are documents of their own; an empty table gives
    no rows. Groups are dealt by a seeded hash of id, content and input partition, about group_docs documents each, so neither a key that many
    rows share nor rows that are equal make a large group. Ties are broken by doc_id, then checksum.
    """
    groups = max(1, -(-docs.count() // group_docs))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, rest, sequence = [], [], int(pdf["g"].iloc[0]) << 32
        pdf = pdf.sort_values(["doc_id", "sums"], na_position="first", kind="stable")
        for doc, tokens, sums in zip(pdf["doc_id"], pdf["doc_tokens"], pdf["sums"]):
            doc = None if pd.isna(doc) else int(doc)
            for k, crc in enumerate(np.frombuffer(sums, "<u4").tolist()):
                size = min(length, tokens - k * length)
                row = [doc, k * length, size, crc, tokens, sequence, 0]
                rows.append(row)
                if size == length:
                    sequence += 1
                else:
                    rest.append(row)
        rest.sort(key=lambda r: -r[2])
        filled: dict[int, int] = {}
        for row, b in zip(rest, first_fit_decreasing([r[2] for r in rest], length)):
            row[5], row[6] = sequence + b, filled.get(b, 0)
            filled[b] = row[6] + row[2]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    dealt = pieces(docs, path, pattern, length, end_id).withColumn("g", F.pmod(F.xxhash64("doc_id", "sums", F.spark_partition_id(), F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(place, SCHEMA)
