"""The pipeline's stages, each on its own input, against brute force."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from plinth.llm.shared import table, written
from tests.llm.test_operators import awkward, brute_classes, brute_spans  # noqa: F401


def brute_cut(texts, length, words):
    """Texts without the runs of repeated strings of `length` bytes that hold so many words."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept, at = b"", 0
        for m in re.finditer(b"\x01+", bytes(gone)):
            if len(d[m.start() : m.end()].split()) >= words:
                kept, at = kept + d[at : m.start()], m.end()
        out.append((kept + d[at:]).decode("utf-8", "ignore"))
    return out


def test_planted_passages(spark, sf):
    """Each passage of over 50 words, in several documents of their own words, goes; what documents share below that stays."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages, short = [prose(51 + 5 * (k % 3)) for k in range(30)], [prose(35) for _ in range(10)]
    texts = [f"{prose(150)} {passages[i % 30]} {prose(150)}" for i in range(90)] + [f"{prose(80)} {short[i % 10]} {prose(80)}" for i in range(40)] + [prose(20_000) + " " + passages[0], passages[1], None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.repeated_passages(spark, docs, sf).collect()}
    assert all(not any(p in (t or "") for p in passages) for t in got.values())
    assert all(got[i] == texts[i] for i in range(90, 130)) and got[131] == "" and got[132] is None and got[133] == ""
    assert all(len(got[i].split()) >= 298 for i in range(90)) and len(got[130].split()) >= 19_999


def test_stages_on_awkward_rows(spark, sf, awkward):
    """Clashing names, null ids, repeated rows, a very long text, and an empty table, through every stage."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "_rk_0", "rk", "_lang_pred", "c0", "kept", "spans", "_text", "bands"]
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(i).alias(n) for i, n in enumerate(names[5:])))
    for rows, least in ((docs, 1), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = written(stage(spark, rows, sf), name)
            assert name == "packing" or rows.columns == names
        assert rows.count() >= least and (least or rows.count() == 0)


def test_stages(spark, sf):
    docs = table(spark, sf, "documents").filter(F.length("text") < 6000)
    extra = spark.createDataFrame([(99_001, None, None, None, None), (99_002, "", "en", "s", 0), (99_003, "### 123 $$$", "en", "s", 11)], docs.schema)
    docs = docs.unionByName(extra)
    kept = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        before = list(kept.values())[-1]
        kept[name] = written(stage(spark, before, sf), name)
        if name != "packing":
            assert kept[name].columns == docs.columns
    ids = lambda df: Counter(r[0] for r in df.select("doc_id").collect())
    pairs = lambda df: [tuple(r) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]
    assert ids(docs) - ids(kept["language_id"]) == Counter([99_001, 99_002, 99_003])
    classes = brute_classes(pairs(kept["language_id"]))
    assert ids(kept["ngram_jaccard_join"]) == Counter(i for i, c, _ in classes if i == c)
    after, before = dict(pairs(kept["suffix_array_dedup"])), pairs(kept["ngram_jaccard_join"])
    assert after.keys() == {i for i, _ in before}
    assert all(after[i] == cut for (i, _), cut in zip(before, brute_cut([t for _, t in before], corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS)))
    masked = dict(pairs(kept["pii"]))
    assert masked.keys() == after.keys() and not any(brute_spans(t) for t in masked.values())
    assert all(masked[i] == t for i, t in after.items() if not brute_spans(t))
    assert ids(kept["packing"]).keys() == masked.keys()
    assert kept["pii"].filter(F.col("n_chars") != F.length("text")).count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
