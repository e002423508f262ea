"""Document fingerprints: a Merkle tree over sections, paragraphs and word runs. DataFrame functions only.

A section ends at a blank line, a paragraph at a line end; a paragraph's leaves are runs of up to eight words. A
leaf's hash is xxhash64 of its text (16 hex digits), a paragraph's the first 16 digits of the SHA-256 of its leaves, a
section's that of its paragraphs, the root the first 32 of all sections. The fingerprint string is
root|section:paragraph=leaf,leaf;paragraph=...|section... , so roots test equality, and where sections, paragraphs or leaves
differ, the edit lies. Likeness is the Dice measure over the sets of leaves, 1 where roots are equal.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.shared import written

_LEAF = r"(?:\S{1,48}\s*){1,8}|\s+"


def _short(x: Column, digits: int) -> Column:
    return F.left(F.sha2(x, 256), F.lit(digits))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty. Equal texts, and only those (up to hash collisions), have equal ones."""

    def paragraph(p: Column) -> Column:
        leaves = F.array_join(F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda x: F.lpad(F.lower(F.hex(F.xxhash64(x))), 16, "0")), ",")
        return F.transform(F.array(leaves), lambda x: F.concat(_short(x, 16), F.lit("="), x))[0]

    def section(s: Column) -> Column:
        paragraphs = F.array_join(F.transform(F.split(s, "\n"), paragraph), ";")
        return F.transform(F.array(paragraphs), lambda x: F.concat(_short(x, 16), F.lit(":"), x))[0]

    body = F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section), "|")
    return F.transform(F.array(body), lambda x: F.concat(_short(x, 32), F.lit("|"), x))[0]


def root(fp: Column) -> Column:
    return F.substring_index(fp, "|", 1)


def leaves(fp: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fp, F.lit(r"(?<=[=,])[0-9a-f]{16}"), F.lit(0)))


def paragraphs(fp: Column) -> Column:
    return F.regexp_extract_all(fp, F.lit(r"([0-9a-f]{16})="), F.lit(1))


def edited_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of a's paragraphs whose branch isn't in b: where the edits lie."""
    there = F.transform(paragraphs(a), lambda p, i: F.struct(i.alias("i"), F.array_contains(paragraphs(b), p).alias("kept")))
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(F.transform(F.filter(there, lambda x: ~x["kept"]), lambda x: x["i"]))


def likeness(a_leaves: Column, b_leaves: Column) -> Column:
    """Dice measure of two arrays of distinct leaves; two empty ones are alike."""
    total = F.size(a_leaves) + F.size(b_leaves)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a_leaves, b_leaves)) / total)


def _less(x: Column, y: Column) -> Column:
    """x before y, nulls first."""
    return (x.isNull() & y.isNotNull()) | F.coalesce(x < y, F.lit(False))


def with_next(docs: DataFrame, bucket_rows: int = 2048, segments: int = 64) -> DataFrame:
    """(doc_id, text, next_text): each document with the next one's text by (doc_id, hash of text, text), the first after the last.

    Null texts are empty, null ids come first. One shuffle of the texts: ids are dealt to buckets of about bucket_rows by approximate
    quantiles with equal widths between them, and the first document of each bucket also goes to the bucket before it. An id (or null)
    with many rows has buckets of its own, by the hash of its texts, and its equal rows travel as one with a count. Bucket starts are a
    table, as is all that grows with the documents; Spark broadcasts it only while it is small.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    x = rows.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / segments for i in range(segments + 1)], 1000).alias("q")).first()
    cuts = sorted(set(x["q"] or [0]))
    if len(cuts) < 2:
        cuts = [cuts[0], cuts[0] + 1]
    per = max(1, -(-x["n"] // bucket_rows // (len(cuts) - 1)))
    bounds = F.lit(cuts)
    at = F.greatest(F.lit(1), F.least(F.lit(len(cuts) - 1), F.size(F.filter(bounds, lambda x: x <= F.col("doc_id")))))
    low, high = F.element_at(bounds, at).cast("double"), F.element_at(bounds, at + 1).cast("double")
    inner = F.floor((F.col("doc_id").cast("double") - low) / (high - low) * per)
    base = F.when(F.col("doc_id").isNull(), 0).otherwise((at - 1) * per + F.greatest(F.lit(0), F.least(F.lit(per - 1), inner))).cast("long")
    dealt = rows.withColumn("b", base).withColumn("h", F.xxhash64("text"))
    hot = written(dealt.groupBy("b", "doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * bucket_rows), "hot_ids")
    if hot.isEmpty():
        dealt = dealt.select("b", F.lit(0).alias("c"), F.lit(0).cast("long").alias("s"), "doc_id", "h", "text", F.lit(1).cast("long").alias("copies"))
    else:
        lists = hot.groupBy("b").agg(F.collect_list(F.struct("doc_id", "n")).alias("hots"))
        known = dealt.join(lists, "b", "left").withColumn("hots", F.coalesce("hots", F.array().cast("array<struct<doc_id:bigint,n:bigint>>")))
        known = known.withColumn("own", F.try_element_at(F.filter("hots", lambda x: x["doc_id"].eqNullSafe(F.col("doc_id"))), F.lit(1))["n"])
        c = 2 * F.size(F.filter("hots", lambda x: _less(x["doc_id"], F.col("doc_id")))) + F.col("own").isNotNull().cast("int")
        share = F.col("h").cast("double") / 2.0**64 + 0.5  # from 0 to 1, rises with h
        s = F.coalesce(F.floor(share * F.ceil(F.col("own") / bucket_rows)), F.lit(0)).cast("long")
        known = known.select("b", c.alias("c"), s.alias("s"), "doc_id", "h", "text", "own")
        several = known.filter("own IS NOT NULL").groupBy("b", "c", "s", "doc_id", "h", "text").agg(F.count("*").alias("copies"))
        dealt = known.filter("own IS NULL").drop("own").withColumn("copies", F.lit(1).cast("long")).unionByName(several)
    key = ("b", "c", "s")
    # the least (doc_id, h) of each bucket, and which bucket comes before it: by runs of buckets, then by the runs' last ones
    firsts = dealt.groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")).alias("f"))
    firsts = written(firsts.select(*key, F.col("f.doc_id").alias("doc_id"), F.col("f.h").alias("h"), F.floor(F.col("b") / 4096).alias("run"), F.struct(*key).alias("own")), "bucket_starts")
    runs = firsts.groupBy("run").agg(F.max("own").alias("last"))
    order = Window.orderBy("run")  # a row for 4096 buckets
    runs = runs.select("run", F.coalesce(F.lag("last").over(order), F.max("last").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before_run"))
    prior = firsts.withColumn("before", F.lag("own").over(Window.partitionBy("run").orderBy("own"))).join(runs, "run").select(*key, "doc_id", "h", F.coalesce("before", "before_run").alias("before"))
    p = prior.select(*(F.col(k).alias(f"p_{k}") for k in key), F.col("doc_id").alias("p_doc_id"), F.col("h").alias("p_h"), "before")
    same = (F.col("b") == F.col("p_b")) & (F.col("c") == F.col("p_c")) & (F.col("s") == F.col("p_s")) & F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("h") == F.col("p_h"))
    lead = dealt.join(p, same).groupBy("before").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h", "text")).alias("x"))
    lead = lead.select(*(F.col(f"before.{k}").alias(k) for k in key), F.col("x.doc_id").alias("doc_id"), F.col("x.h").alias("h"), F.col("x.text").alias("text"), F.lit(1).cast("long").alias("copies"), F.lit(1).alias("guest"))
    every = dealt.withColumn("guest", F.lit(0)).unionByName(lead)
    order = Window.partitionBy(*key).orderBy("guest", F.col("doc_id").asc_nulls_first(), "h", "text")
    out = every.withColumn("next_text", F.lead("text").over(order)).filter("guest = 0")
    if hot.isEmpty():
        return out.select("doc_id", "text", "next_text")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "text", F.when(F.col("copy") < F.col("copies"), F.col("text")).otherwise(F.col("next_text")).alias("next_text"))


def query(documents: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with both likenesses.

    A null text is empty; repeated rows are documents of their own, in order of (doc_id, hash of text, text), null ids first; an only
    document is its own next one; an empty table gives no rows; other columns are left behind.
    """
    rows = with_next(documents)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), fingerprint(F.col("next_text")).alias("f_next"))
    rows = rows.select("*", leaves(F.col("fingerprint")).alias("a"), leaves(F.col("edited_fingerprint")).alias("e"), leaves(F.col("f_next")).alias("x"))
    like = lambda leaf, fp: F.when(root(F.col("fingerprint")) == root(F.col(fp)), F.lit(1.0)).otherwise(likeness(F.col("a"), F.col(leaf)))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("e", "edited_fingerprint").alias("near_edited"), like("x", "f_next").alias("near_next"))
