"""Personal data: pattern spans, and information-theoretic sanitisation of the words that give them away.

Base spans (email, ip, card, phone) are protected entities: each value, and each class of values (an e-mail's domain, an ip's first three
parts, a card's first six digits, a phone's first five). All words with a letter or digit are candidate terms. Over all documents, df(e)
counts those with an entity, df(t) those with a term, df(e, t) those with both. With N documents and p = df(e) / N, a term
makes the entity as likely as P(e | t) = (df(e, t) + prior p) / (df(t) + prior), counts smoothed by `prior` documents that hold e at its
usual rate. It reveals log2(P(e | t) / p) bits of the entity's information content -log2(p); at a share of
`disclosure` or more the term is generalised wherever it stands, in all documents. No count is too small: values of one document take part.

df(e, t) is at most df(e), so a term in more than (df(e) + prior p) / p**(1 - disclosure) - prior documents can't reveal e: such pairs
aren't formed. Only terms of documents with an entity are counted, and only revealing ones are looked for in the second scan: which
they are is kept in bitmaps of 2**26 hashes, a size that no corpus changes; what shares a bit is counted, or joined, in vain, never wrongly.
"""

import re
import string

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.shared import fresh, row_name, written

KINDS = ("email", "ip", "card", "phone")
BITS = 1 << 26
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
#: Digits and single dots; four parts each, from the left, are what the pattern of an ip takes.
_PARTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"\S+")
_WORD = re.compile(r"[^\W_]")
_HASH = lambda s: xxhash.xxh3_64_intdigest(s) - (1 << 63)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As leftmost matches of the pattern give: each @ with its longest local part not in an earlier match, and a domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = start < at and _DOMAIN.match(text, at)
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """As leftmost matches of four parts give, those with a part above 255 dropped. Linear: each run of digits and dots is taken once."""
    out = []
    for m in _PARTS.finditer(text):
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[i : i + 4])) + 3
            if all(len(d) <= 3 and int(d or 0) <= 255 for d in (p.lstrip("0") for p in parts[i : i + 4])):
                out.append((at, end))
            at = end + 1
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", a, b) for a, b in ips(text)]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def entities(kind: str, value: str) -> list[int]:
    """Hashes of a span's value and of its class."""
    value = value.lower()
    digits = "".join(_DIGIT.findall(value))
    group = {"email": value.rpartition("@")[2], "ip": value.rpartition(".")[0], "card": digits[:6], "phone": digits[:5]}[kind]
    return [_HASH(f"{kind}:{value}"), _HASH(f"{kind}/{group}")]


def terms_of(text: str, spans) -> list[tuple[str, int, int]]:
    """Words with a letter or digit that overlap no span."""
    return outside([(m[0], m.start(), m.end()) for m in _TERM.finditer(text)], spans)


FOUND = "row string, no long, rk binary, doc_id long, base string, h long"


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(rows: DataFrame) -> DataFrame:
    """Row 'd' for each document with its base spans; for those with any, rows 'e' for entities and 't' for terms (h: hash), once a document.

    no numbers the documents; repeated ones have one each.
    """
    names = [c.split()[0] for c in FOUND.split(", ")]
    types = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        no = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for rk, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text, no = text or "", no + 1
                spans = base_spans(text)
                out.append(("d", no, rk, doc, _joined(spans), None))
                if spans:
                    out += [("e", no, None, None, None, h) for h in {h for kind, s, e in spans for h in entities(kind, text[s:e])}]
                    out += [("t", no, None, None, None, _HASH(w)) for w in {w for w, _, _ in terms_of(text, spans)}]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return rows.select("rk", "doc_id", "text").mapInArrow(run, FOUND)


def bitmap(terms: DataFrame) -> np.ndarray:
    """BITS bits, those of the hashes t set, as 64-bit words. Each word that isn't zero comes to the driver as a row."""
    at = F.col("t").bitwiseAND(BITS - 1)
    found = terms.select(F.shiftright(at, 6).cast("int").alias("k"), F.expr("shiftleft(1L, cast(t & 63 AS int))").alias("x")).groupBy("k").agg(F.bit_or("x").alias("x")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[found["k"].to_numpy()] = found["x"].to_numpy()
    return out


def _in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[(h & (BITS - 1)) >> 6] >> (h & 63)) & 1 == 1


def term_counts(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """(t, df): documents with each term whose bit is set."""

    def run(batches):
        counts: dict[str, int] = {}

        def flush():
            h = np.array([_HASH(w) for w in counts], np.int64)
            n = np.array(list(counts.values()), np.int64)
            take = _in_bitmap(bits, h)
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[take]), pa.array(n[take])], ["t", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in set((text or "").split()):
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) > 150_000:
                    yield flush()
        yield flush()

    return rows.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("df_t"))


def outside(hits: list[tuple[str, int, int]], spans) -> list[tuple[str, int, int]]:
    """The words with a letter or digit that overlap no span; both in order of start."""
    ends, out, k, reach = sorted((a, b) for _, a, b in spans), [], 0, 0
    for w, a, b in hits:
        while k < len(ends) and ends[k][0] < b:
            reach = max(reach, ends[k][1])
            k += 1
        if reach <= a and _WORD.search(w):
            out.append((w, a, b))
    return out


def places(rows: DataFrame, bits: np.ndarray) -> DataFrame:
    """(rk, t, a, b): the words of all texts whose bit is set, outside base spans."""
    types = [pa.binary(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        known: dict[str, int | None] = {}  # the hash of a word whose bit is set
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            parts = [set(t.split()) for t in texts]
            new = list(set().union(*parts) - known.keys())
            if len(known) + len(new) > 150_000:
                known.clear()
                new = list(set().union(*parts))
            h = np.array([_HASH(w) for w in new], np.int64)
            known.update((w, x if set_ else None) for w, x, set_ in zip(new, h.tolist(), _in_bitmap(bits, h).tolist()))
            telling = {w for w in set().union(*parts) if known[w] is not None}
            out = []
            for rk, text, words in zip(batch.column(0).to_pylist(), texts, parts):
                if not telling.isdisjoint(words):
                    hits = [(w, m.start(), m.end()) for m in _TERM.finditer(text) if (w := m[0]) in telling]
                    out += [(rk, known[w], a, b) for w, a, b in outside(hits, base_spans(text))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["rk", "t", "a", "b"])

    return rows.select("rk", "text").mapInArrow(run, "rk binary, t long, a int, b int")


def spans_of(docs: DataFrame, prior: float = 1.0, disclosure: float = 0.8) -> DataFrame:
    """(rk, doc_id, base, terms) of each row of docs (doc_id, text): base spans as kind:start:end, and an array of (a, b) of revealing terms.

    Null texts are empty; repeated rows each give a row and count as documents each; an empty table gives no rows. rk is
    a 128-bit name of (doc_id, text). A term's span never overlaps a base span.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rk", row_name(F.col("doc_id"), F.col("text")))
    found = written(find(rows), "spans")
    every = found.filter("row = 'd'").select("rk", "doc_id", "base")
    total = float(every.count())
    held = found.filter("row = 'e'").select("no", F.col("h").alias("e"))
    near = found.filter("row = 't'").select("no", F.col("h").alias("t"))
    share = F.col("df_e") / total
    df_e = held.groupBy("e").agg(F.count("*").alias("df_e")).filter(F.col("df_e") < total)
    most = (F.col("df_e") + prior * share) / F.pow(share, F.lit(1 - disclosure)) - prior + 1e-6
    df_e = written(df_e.withColumn("most", most), "entities")
    limit = df_e.agg(F.max("most")).first()[0] or 0.0
    df_t = written(term_counts(rows, bitmap(near)).filter(F.col("df_t") <= limit), "counts")
    pairs = near.join(df_t, "t").join(held.join(df_e, "e"), "no").filter(F.col("df_t") <= F.col("most"))
    pairs = pairs.groupBy("e", "t", "df_e", "df_t").agg(F.count("*").alias("df_et"))
    bits = F.log2((F.col("df_et") + prior * share) / (F.col("df_t") + prior) / share)
    telling = written(pairs.filter(bits >= disclosure * -F.log2(share)).select("t").distinct(), "telling")
    terms = places(rows, bitmap(telling)).join(telling, "t").groupBy("rk").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("terms"))
    return every.join(terms, "rk", "left").select("rk", "doc_id", "base", F.coalesce("terms", F.array().cast("array<struct<a:int,b:int>>")).alias("terms"))


def masked(text: str, base: str, terms: list[tuple[int, int]]) -> str:
    """text with each base span as [KIND] and each term as [TERM]; of overlapping spans the outermost start names the mask."""
    spans = sorted([(int(a), int(b), k.upper()) for k, a, b in (x.split(":") for x in base.split(",") if x)] + [(a, b, "TERM") for a, b in terms], key=lambda x: (x[0], -x[1]))
    out, at = [], 0
    for a, b, name in spans:
        if a >= at:
            out += [text[at:a], f"[{name}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with every span in `text` masked; a null text stays null, n_chars follows the text where it exists."""
    rk, base, terms = (fresh(x, docs) for x in ("rk", "base", "terms"))
    spans = spans_of(docs, **options).filter("base <> '' OR size(terms) > 0").select(F.col("rk").alias(rk), F.col("base").alias(base), F.transform("terms", lambda x: F.array(x["a"], x["b"])).alias(terms)).dropDuplicates([rk])
    joined = docs.withColumn(rk, row_name(F.col("doc_id").cast("long"), F.col("text").cast("string"))).hint("merge").join(spans, rk, "left")  # neither side has a bound

    @F.pandas_udf("string")
    def mask(text, base, terms):
        return pd.Series([t if t is None or b is None else masked(t, b, [tuple(x) for x in c]) for t, b, c in zip(text, base, terms)], dtype=object)

    clean = F.when(F.col(base).isNull(), F.col("text")).otherwise(mask("text", base, terms))
    out = joined.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(documents: DataFrame) -> DataFrame:
    out = spans_of(documents)
    parts = F.split("base", ",")
    count = lambda kind: F.size(F.filter(parts, lambda x: x.startswith(kind + ":"))).cast("long").alias(f"n_{kind}")
    terms = F.array_join(F.transform("terms", lambda x: F.concat(F.lit("term:"), x["a"].cast("string"), F.lit(":"), x["b"].cast("string"))), ",")
    return out.select("doc_id", *map(count, KINDS), F.sha2("base", 256).alias("base_sha256"), F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(terms, F.lit(""))).alias("spans"))
