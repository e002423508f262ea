"""URL filtering: longest matching rule first, link-graph propagation for the rest. DataFrame functions only.

Trust is a personalised PageRank from hosts with pages that rules allow, along links between hosts; distrust is one
from hosts with blocked pages, along the same links reversed (who links to a blocked host inherits its distrust). Both
run as one propagation over (kind, host) keys: a join with the normalised edges and a sum, repeated until no rank grows by more than
TOLERANCE of itself in STEPS rounds. A host's links to itself are solved for in its own row, so they take no rounds; ranks only grow, so
a host that mass reaches late, or little of it, is waited for as well. A host is blocked where its distrust exceeds `ratio` times its trust, both being shares of their seeds' mass, by more than rounding
(TOLERANCE of it), however small they are; hosts that no mass reaches are allowed. Edges and seeds are aggregated per host pair and host before anything is joined, so a hot host costs a row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.shared import written

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A value in double or single quotes, which may hold the other quote, or without.
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*("[^"#][^"]*"|'[^'#][^']*'|[^\s"'>#][^\s>]*)"""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Relative: a table's size changes the ranks, not their ratio.
TOLERANCE = 1e-6
#: Rounds in a plan: then the ranks are written and compared with the last written ones.
STEPS = 8


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; empty without :// or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def with_rule(rows: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """rows (with host and path) with a struct `name` (rule, verdict) of the longest rule (verdict, host, path) that fits; null if none.

    Rules are joined by host: each host that occurs is looked up with all its suffixes, so their number makes no plan longer. Of
    rules of equal length the one with the longer host wins, then block over allow. Spark broadcasts a side only while it is small.
    """
    hosts = rows.select("host").distinct()
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    by_host = hosts.select("host", F.explode(F.array_distinct(suffixes)).alias("suffix")).join(rules.select(F.col("host").alias("suffix"), F.col("path").alias("p"), "verdict"), "suffix")
    order = (F.char_length("suffix") + F.char_length("p"), F.char_length("suffix"), (F.col("verdict") == "block").cast("int"))
    fits = written(by_host.groupBy("host").agg(F.collect_list(F.struct(order[0].alias("n"), order[1].alias("h"), order[2].alias("b"), F.concat("suffix", "p").alias("rule"), "verdict", "p")).alias("_fits")), "rules_of_hosts")
    best = F.array_max(F.filter("_fits", lambda x: F.col("path").startswith(x["p"])))
    found = F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))
    return rows.join(fits, "host", "left").withColumn(name, found).drop("_fits")


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, n) of links in pages with a column host; relative links lead to the page's own host."""
    values = F.regexp_extract_all(html, F.lit(_HREF), 1)
    links = F.array_distinct(F.transform(values, lambda x: F.when(x.rlike("^[\"']"), F.substr(x, F.lit(2), F.char_length(x) - 2)).otherwise(x)))
    target = F.when(F.col("link").startswith("//"), host_of(F.concat(F.lit("http:"), F.col("link")))).when(F.col("link").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(F.col("link"))).when(F.col("link").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit("")).otherwise(F.col("host"))
    # relative links are counted in the row: only absolute ones are exploded
    outside = F.filter("links", lambda x: x.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|//)"))
    rows = pages.filter(F.col("host") != "").select("host", links.alias("links"))
    own = rows.groupBy("host").agg(F.sum(F.size("links") - F.size(outside)).alias("n")).select(F.col("host").alias("src"), F.col("host").alias("dst"), "n")
    away = rows.select("host", F.explode(outside).alias("link")).select(F.col("host").alias("src"), target.alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return own.unionByName(away).filter((F.col("dst") != "") & (F.col("n") > 0)).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds (host, trust, distrust: counts).

    The ranks r = (1 - damping) s + damping W r, by Jacobi rounds from below: each rank without its own loop, over 1 - damping w(loop).
    """
    both = edges.select(F.lit("t").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)).alias("own"))
    total = written(total.select("kind", F.col("src").alias("host"), "total", (1 - F.lit(damping) * F.col("own") / F.col("total")).alias("rest")), "totals")
    ends = total.select("kind", F.col("host").alias("dst"), "rest")
    steps = both.filter("src <> dst").withColumnRenamed("src", "host").join(total.select("kind", "host", "total"), ["kind", "host"]).join(ends, ["kind", "dst"], "left")
    steps = written(steps.select("kind", "host", "dst", (F.lit(damping) * F.col("n") / F.col("total") / F.coalesce("rest", F.lit(1.0))).alias("w")), "edges")
    mass = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()  # one row
    start = seeds.select(F.explode(F.array(F.struct(F.lit("t").alias("kind"), "host", (F.col("trust") / F.lit(float(mass["t"] or 1))).alias("s")), F.struct(F.lit("d").alias("kind"), "host", (F.col("distrust") / F.lit(float(mass["d"] or 1))).alias("s")))).alias("x")).select("x.*").filter("s > 0")
    start = start.join(total.select("kind", "host", "rest"), ["kind", "host"], "left")
    start = written(start.select("kind", "host", (F.col("s") * F.lit(1 - damping) / F.coalesce("rest", F.lit(1.0))).alias("r")), "seeds")
    rank, moving = start, True
    while moving:
        last = rank
        for _ in range(STEPS):
            moved = rank.join(steps, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("r") * F.col("w")).alias("r"))
            rank = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        rank = written(rank, "ranks")
        old = last.select("kind", "host", F.col("r").alias("old"))
        moving = not rank.join(old, ["kind", "host"], "left").filter(F.col("r") - F.coalesce("old", F.lit(0.0)) > TOLERANCE * F.col("r")).isEmpty()
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0))
    return rank.groupBy("host").agg(part("t").alias("trust"), part("d").alias("distrust"))


def by_links(edges: DataFrame, seeds: DataFrame, ratio: float = 1.0, **options) -> DataFrame:
    """(host, trust, distrust, by_links: block or allow)."""
    blocked = F.col("distrust") > F.col("trust") * (ratio * (1 + TOLERANCE))
    return propagate(edges, seeds, **options).withColumn("by_links", F.when(blocked, "block").otherwise("allow"))


def judge(pages: DataFrame, rules=RULES, ratio: float = 1.0) -> DataFrame:
    """pages (page_id, url, html) with host, path, rule, verdict, trust and distrust. rules: a table or list of (verdict, host, path).

    Null urls have an empty host and path, fit no rule and are allowed. Null html has no links. Repeated rows are
    judged each. An empty table gives no rows.
    """
    base = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not isinstance(rules, DataFrame):
        each = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
        rules = pages.sparkSession.range(1).select(F.inline(F.array(*each)))
    base = with_rule(base, rules, "m")
    seeds = base.filter("m IS NOT NULL").groupBy("host").agg(F.sum((F.col("m.verdict") == "allow").cast("long")).alias("trust"), F.sum((F.col("m.verdict") == "block").cast("long")).alias("distrust"))
    hosts = by_links(host_edges(base), seeds, ratio)
    known = base.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("verdict"))
    return known.join(hosts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "by_links", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def query(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
