"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word (a run of letters, lower-cased,
with the word-start mark) is scored by the forward algorithm: the sum over all its segmentations into pieces of the product of their
probabilities; a text by the sum of its words' logarithms. Piece probabilities come from expectation-maximisation over the
words of all labelled training rows, on executors; what is collected is a table of vocabulary x languages.
"""

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from plinth.llm.shared import fresh, written

MARK, LONGEST_WORD, UNKNOWN, CACHE = "▁", 32, 1e-7, 150_000
#: Words a task counts before it hands them on, and words whose segmentations are taken together.
COUNTED, TOGETHER = 150_000, 8192
#: Ranges of a unit of log-probability in which fits are counted to find their median.
RANGES = 4096
#: Languages of a model, which is a table of vocabulary x languages; more fail.
MOST_LANGUAGES = 256
_SHARES = 1 << 40
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, int], int]:
    """Number of each ordinary piece of the vocabulary, and the longest one's length."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    names = list(dict.fromkeys(names))
    return {p: i for i, p in enumerate(names)}, min(LONGEST_WORD, max(map(len, names)))


def words(text: str) -> list[str]:
    """Lower-case runs of letters; longer ones in parts of less than LONGEST_WORD characters."""
    out = _LETTERS.findall(text.lower())
    if max(map(len, out), default=0) >= LONGEST_WORD:
        out = [w[i : i + LONGEST_WORD - 1] for w in out for i in range(0, len(w), LONGEST_WORD - 1)]
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=2)
def _table(path: str):
    """Pieces by a 64-bit hash of their characters: two slot tables (the second for what collides in the first) and each piece's hash."""
    known, longest = pieces(path)
    up, down = np.full(LONGEST_WORD + 1, _BASE, np.uint64), np.full(LONGEST_WORD + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    hashes = _mixed(np.array([sum((ord(c) + 1) * int(up[i]) for i, c in enumerate(p[:LONGEST_WORD])) % (1 << 64) for p in known], np.uint64))
    first = np.full(1 << 20, -1, np.int32)
    slot = hashes >> np.uint64(44)
    first[slot] = np.arange(len(hashes))
    rest = np.flatnonzero(first[slot] != np.arange(len(hashes)))
    for odd in np.random.default_rng(1).integers(0, 1 << 63, 1000, np.uint64) | np.uint64(1):
        second = np.full(1 << 20, -1, np.int32)
        second[(hashes[rest] * odd) >> np.uint64(44)] = rest
        if (second >= 0).sum() == len(rest):
            return first, second, odd, hashes, up, down, longest
    raise ValueError("the vocabulary is too large for its slot tables")


def _lattice(words: list[str], vocabulary: str):
    """Order of the words (longest first), their sizes with the mark in that order, and (start, end, numbers) of all substrings by end, then
    start: the piece between them in each word that reaches end, -1 where there is none."""
    first, second, odd, hashes, up, down, longest = _table(vocabulary)
    marked = [MARK + w for w in words]
    sizes = np.array([len(w) for w in marked])
    order = np.argsort(-sizes, kind="stable")  # the words that reach a position come first
    codes = np.frombuffer("".join(marked[i].ljust(LONGEST_WORD, "\0") for i in order).encode("utf-32-le"), "<u4").reshape(len(words), LONGEST_WORD)
    sums = np.zeros((LONGEST_WORD + 1, len(words)), np.uint64)
    np.cumsum(((codes + np.uint64(1)) * up[:LONGEST_WORD]).T, axis=0, out=sums[1:])
    sizes = sizes[order]

    def arcs():
        for end in range(1, int(sizes[0]) + 1):
            m = int(np.searchsorted(-sizes, -end, side="right"))
            for start in range(max(0, end - longest), end):
                h = _mixed((sums[end, :m] - sums[start, :m]) * down[start])
                at = first[h >> np.uint64(44)]
                wrong = hashes[at] != h
                other = second[(h[wrong] * odd) >> np.uint64(44)]
                at[wrong] = np.where((other >= 0) & (hashes[other] == h[wrong]), other, -1)
                yield start, end, at

    return order, sizes, arcs()


def forward(words: list[str], vocabulary: str, probs: np.ndarray) -> np.ndarray:
    """Log-probabilities, words x languages: for each word the sum over all its segmentations. A character of no piece counts UNKNOWN."""
    order, sizes, arcs = _lattice(words, vocabulary)
    f = np.zeros((LONGEST_WORD + 1, len(words), probs.shape[1]))
    f[0] = 1
    for start, end, at in arcs:
        got = f[end, : len(at)]
        hit = np.flatnonzero(at >= 0)
        got[hit] += f[start, hit] * probs[at[hit]]
        if start == end - 1:
            got[at < 0] += f[start, : len(at)][at < 0] * UNKNOWN
    out = np.empty((len(words), probs.shape[1]))
    out[order] = np.log(f[sizes, np.arange(len(words))])
    return out


def expected(word: str, weight: float, known: dict[str, int], longest: int, probs, counts) -> None:
    """Adds the expected number of each piece in a word, under one language's probs, to counts."""
    word = MARK + word
    size = len(word)
    f, b = [0.0] * (size + 1), [0.0] * (size + 1)
    f[0] = b[size] = 1.0
    arcs = []
    for end in range(1, size + 1):
        for start in range(max(0, end - longest), end):
            at = known.get(word[start:end])
            p = probs[at] if at is not None else UNKNOWN if start == end - 1 else 0.0
            if p:
                f[end] += f[start] * p
                if at is not None or start == end - 1:
                    arcs.append((start, end, at, p))
    for start, end, _, p in reversed(arcs):
        b[start] += p * b[end]
    for start, end, at, p in arcs:
        if at is not None:
            counts[at] = counts.get(at, 0.0) + weight * f[start] * p * b[end] / f[size]


def all_expected(words: list[str], weights: list[int], vocabulary: str, probs: np.ndarray) -> np.ndarray:
    """The expected number of each piece in all words, under one language's probs: what expected gives for a word each, summed."""
    order, sizes, arcs = _lattice(words, vocabulary)
    each = np.arange(len(words))
    f, b = np.zeros((2, LONGEST_WORD + 1, len(words)))
    f[0] = b[sizes, each] = 1
    held = []
    for start, end, at in arcs:
        hit = np.flatnonzero(at >= 0)
        p = probs[at[hit]]
        f[end, hit] += f[start, hit] * p
        rest = np.flatnonzero(at < 0) if start == end - 1 else each[:0]
        f[end, rest] += f[start, rest] * UNKNOWN
        held.append((start, end, hit, at[hit], p, rest))
    share = np.asarray(weights, np.float64)[order] / f[sizes, each]
    found = []
    for start, end, hit, _, p, rest in reversed(held):  # what starts at an end came behind it
        found.append(share[hit] * f[start, hit] * p * b[end, hit])
        b[start, hit] += p * b[end, hit]
        b[start, rest] += UNKNOWN * b[end, rest]
    return np.bincount(np.concatenate([x[3] for x in reversed(held)]), np.concatenate(found), len(probs))


def quotas(counts: dict[str, int], most: int) -> dict[str, float]:
    """What each may take of most in all: the same for each, but what small ones leave goes to the others."""
    out, left = {}, float(most)
    for i, k in enumerate(sorted(counts, key=lambda k: (counts[k], k))):
        out[k] = min(float(counts[k]), left / (len(counts) - i))
        left -= out[k]
    return out


def sample_of(labelled: DataFrame, most_docs: int) -> DataFrame:
    """(text, lang): at most about most_docs rows of labelled (doc_id, text, lang) by quotas of the languages, chosen by a hash of doc_id and text."""
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(_SHARES)).alias("h"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if sum(counts.values()) > most_docs:
        below = {k: math.ceil(_SHARES * q / counts[k]) for k, q in quotas(counts, most_docs).items()}
        rows = rows.filter(F.col("h") < F.create_map(*(F.lit(x) for k in below.items() for x in k))[F.col("lang")])
    return rows.select("text", "lang")


def fit(train: DataFrame, vocabulary: str, most_docs: int | None = None, rounds: int = 2, smoothing: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (pieces x languages) from rows (doc_id, text, lang).

    All are learnt from; with most_docs, which no query sets, those that sample_of takes. No rows: no languages.
    """
    rows = sample_of(train, most_docs) if most_docs else train.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")

    def count(batches):
        counts: dict[str, Counter] = {}

        def found():
            for lang, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(words(text))
                if sum(map(len, counts.values())) >= COUNTED:
                    yield from found()
        yield from found()

    counted_words = written(rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = sorted(r["lang"] for r in counted_words.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    known, _ = pieces(vocabulary)
    probs = np.full((len(known), len(langs)), 1 / len(known))
    number = {x: i for i, x in enumerate(langs)}
    for _ in range(rounds if langs else 0):
        shared = train.sparkSession.sparkContext.broadcast(probs)  # pieces x at most MOST_LANGUAGES numbers

        def step(batches, shared=shared):
            held: dict[int, tuple[list[str], list[int]]] = {}
            counts: dict[int, np.ndarray] = {}

            def settle(k):
                got = all_expected(*held.pop(k), vocabulary, np.ascontiguousarray(shared.value[:, k]))
                counts[k] = counts[k] + got if k in counts else got

            for batch in batches:
                for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    k = number[lang]
                    mine = held.setdefault(k, ([], []))
                    mine[0].append(word)
                    mine[1].append(n)
                    if len(mine[0]) == TOGETHER:
                        settle(k)
            for k in list(held):
                settle(k)
            for k, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at])], ["k", "at", "x"])

        # summed on executors; the model's size comes back
        found = counted_words.mapInArrow(step, "k int, at int, x double").groupBy("k", "at").agg(F.sum("x").alias("x")).toArrow()
        counted = np.full(probs.shape, smoothing)
        counted[found["at"].to_numpy(), found["k"].to_numpy()] += found["x"].to_numpy()
        probs = counted / counted.sum(axis=0)
    return langs, probs


class Scorer:
    """Scores texts; a bounded cache keeps words' log-probabilities."""

    def __init__(self, vocabulary: str, langs: list[str], probs: np.ndarray):
        self.vocabulary, self.langs, self.probs = vocabulary, langs, probs
        self.rows, self.at = np.empty((CACHE, max(1, len(langs)))), {}

    def log_probs(self, parts: list[list[str]]) -> list[np.ndarray]:
        """The sum of each list's words; all lists together hold at most CACHE words."""
        new = set().union(*parts) - self.at.keys()
        if len(self.at) + len(new) > CACHE:
            self.at.clear()
            new = set().union(*parts)
        new = sorted(new)
        for i in range(0, len(new), 8192):
            self.rows[len(self.at) : len(self.at) + len(new[i : i + 8192])] = forward(new[i : i + 8192], self.vocabulary, self.probs)
            self.at.update(zip(new[i : i + 8192], range(len(self.at), CACHE)))
        get = self.at.__getitem__
        return [self.rows[list(map(get, p))].sum(axis=0) for p in parts]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, int]]:
        """Language, posterior, log-probability per character under that language, and the number of characters, word marks included."""
        sizes = [0] * len(texts)
        totals: list[np.ndarray | None] = [None] * len(texts)
        held: list[tuple[int, list[str]]] = []
        room = CACHE // 2

        def settle():
            for (k, _), x in zip(held, self.log_probs([p for _, p in held])):
                totals[k] = x if totals[k] is None else totals[k] + x
            held.clear()

        used = 0
        for k, text in enumerate(texts):
            found = words(text) if text and self.langs else []
            sizes[k] = sum(map(len, found)) + len(found)
            for i in range(0, len(found), room):
                part = found[i : i + room]
                if used + len(part) > CACHE:
                    settle()
                    used = 0
                held.append((k, part))
                used += len(part)
        settle()
        out = []
        for x, n in zip(totals, sizes):
            if x is None:
                out.append(("und", 0.0, None, 0))
            else:
                best = int(np.argmax(x))
                out.append((self.langs[best], float(1 / np.exp(x - x[best]).sum()), float(x[best]) / n, n))
        return out


FOUND = {"pred": (pa.string(), T.StringType()), "score": (pa.float64(), T.DoubleType()), "fit": (pa.float64(), T.DoubleType()), "chars": (pa.int64(), T.LongType())}


def scored(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: str, name: str) -> DataFrame:
    """docs, all columns, with a struct `name` of pred, score, fit (log-probability per character) and chars, see Scorer.predict.

    The model (vocabulary x languages) is what goes to the executors; documents don't shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most pieces x MOST_LANGUAGES numbers
    at = docs.columns.index("text")

    def run(batches):
        s = Scorer(vocabulary, *shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                found = [pa.array(x, t) for x, (t, _) in zip(zip(*s.predict(part.column(at).to_pylist())), FOUND.values())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(found, list(FOUND))], [*batch.schema.names, name])

    kind = T.StructType([T.StructField(n, t) for n, (_, t) in FOUND.items()])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def identify(docs: DataFrame, train: DataFrame, vocabulary: str, pred: str = "lang_pred", score: str = "lang_score", **options) -> DataFrame:
    """docs, all columns, with the columns pred and score (posterior of the best language, languages equally likely before); such columns are replaced.

    Null texts, texts without a letter, and all texts if there is no training row, are `und` with score 0. Ties go to the
    first language by name.
    """
    docs = docs.drop(pred, score)
    name = fresh("found", docs)
    found = scored(docs, fit(train, vocabulary, **options), vocabulary, name)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{name}.pred").alias(pred), F.col(f"{name}.score").alias(score))


def training(documents: DataFrame) -> DataFrame:
    """Rows that may be learnt from: crc32 of the id's text modulo 3 is not 1, and lang is known."""
    return documents.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).filter("lang IS NOT NULL")


def held_out(documents: DataFrame) -> DataFrame:
    """Labelled rows that aren't learnt from."""
    return documents.filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).filter("lang IS NOT NULL")


def usual_fit(held: DataFrame, name: str, langs: list[str]) -> dict[str, float]:
    """The median (the lower of two) log-probability per character of each language's rows of held that are predicted right, all of them
    counted; for languages without any, the lowest of the others. held has the struct `name` of scored.

    Fits are counted by ranges, whose number has a bound, and in the range that holds the median by value.
    """
    x = F.col(name)
    fits = held.filter((x["pred"] == F.col("lang")) & x["fit"].isNotNull()).select("lang", x["fit"].alias("fit"), F.floor(x["fit"] * RANGES).alias("part"))
    values = written(fits.groupBy("lang", "part", "fit").agg(F.count("*").alias("n")), "fits")
    by_part = Window.partitionBy("lang").orderBy("part")
    parts = values.groupBy("lang", "part").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(by_part))
    parts = parts.withColumn("half", F.ceil(F.sum("n").over(Window.partitionBy("lang")) / 2))
    middle = parts.filter("upto >= half AND upto - n < half").select("lang", "part", (F.col("half") - F.col("upto") + F.col("n")).alias("least"))
    near = values.join(F.broadcast(middle), ["lang", "part"]).withColumn("upto", F.sum("n").over(Window.partitionBy("lang").orderBy("fit")))
    found = dict(tuple(r) for r in near.filter("upto >= least").groupBy("lang").agg(F.min("fit")).collect())  # a row a language
    return {k: found.get(k, min(found.values())) for k in langs} if found else {}


def accepted(docs: DataFrame, vocabulary: str, least_score: float = 0.5, worst_fit: float = 2.0, slack: float = 8.0) -> DataFrame:
    """docs, all columns, without texts that are of no language, of a doubtful one, or of none that was learnt.

    The posterior only says which language is best, so a text must also reach a log-probability per character of
    worst_fit + slack / characters times what held-out texts of its language usually have; short texts vary more. Without held-out
    texts nothing is known of that, and the posterior alone decides.
    """
    model = fit(training(docs), vocabulary)
    name = fresh("found", docs)
    found = written(scored(docs, model, vocabulary, name), "scored")  # each text is scored once
    usual = usual_fit(held_out(found), name, model[0])
    x = found[name]
    fits = F.lit(True)
    if usual:
        median = F.create_map(*(F.lit(x) for k in usual.items() for x in k))[x["pred"]]
        fits = x["fit"] >= median * (worst_fit + slack / x["chars"])
    return found.filter((x["pred"] != "und") & (x["score"] >= least_score) & fits).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(documents: DataFrame, vocabulary: str) -> DataFrame:
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return identify(docs, training(documents), vocabulary).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
