"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Leaf i of the tree holds the rank of the pair that starts at byte position i (none if i is dead or the pair
is no token), so the root is the leftmost pair of minimum rank. A merge kills one position and makes three
point updates, each logarithmic: O(n log n) for a piece of n bytes, however long. Pieces (matches of the
split pattern) are independent; a bounded two-generation cache per Python worker keeps frequent ones.
"""

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.shared import Generations, splitter

NONE = 1 << 62
CACHE = 250_000


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """token -> id of a rank file (base64 token, space, id on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The ids of one piece: always merge the leftmost pair of minimum rank until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1
    while size < n - 1:
        size *= 2
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (top := tree[1]) != NONE:
        i = top & 0xFFFFFFFF
        dead = after[i]
        end = after[dead] if dead < n else n
        after[i] = end
        if end < n:
            before[end] = i
        # the pair at i has a new right side, the pair at the dead position is gone, the one before i grew
        for at, stop in ((i, after[end] if end < n else -1), (dead, -1), (before[i], end)):
            if at < 0 or at >= size:
                continue
            value = NONE
            if stop > 0 and stop - at <= longest:
                r = get(piece[at:stop])
                if r is not None:
                    value = r << 32 | at
            k = size + at
            if tree[k] == value:
                continue
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                m = a if a < b else b
                if tree[k] == m:
                    break
                tree[k] = m
                k >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes texts to packed little-endian unsigned 32-bit ids and back."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.tokens = {v: k for k, v in self.ranks.items()}
        longest = max(map(len, self.ranks), default=0)
        self.split = splitter(pattern)
        self.cache = Generations(lambda p: np.array(merge(p.encode(), self.ranks, longest), "<u4").tobytes(), CACHE)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.split(text or "")))

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _mapped(df: DataFrame, column: str, out: str, f) -> DataFrame:
    """df with a binary column out = f of column, batch by batch; a column of that name is replaced."""
    df = df.drop(out)
    at = df.columns.index(column)

    def run(batches):
        g = f()
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(g, part.column(at).to_pylist()), pa.binary())], [*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def encode(df: DataFrame, path: str, pattern: str, column: str = "text", out: str = "ids") -> DataFrame:
    """df with the packed ids of a text column. Null and empty texts have no ids; every other column stays.

    No shuffle; memory is a batch, the cache and the largest piece.
    """
    return _mapped(df, column, out, lambda: codec(path, pattern).encode)


def decode(df: DataFrame, path: str, pattern: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of packed ids; null ids give empty bytes, an unknown id fails."""
    return _mapped(df, column, out, lambda: codec(path, pattern).decode)


def query(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every document."""
    ids = encode(documents.select("doc_id", "text"), path, pattern).select("doc_id", "ids")
    out = decode(ids, path, pattern)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
