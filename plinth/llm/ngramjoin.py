"""Near-duplicate join on word n-grams: MinHash banding, verified on the full n-gram sets.

Texts are split at white space into words; the set of hashes of all runs of five words (of all words, if fewer) stands for a text.
Rows with equal sets are one node. Signatures are cut into bands of rows; band and row counts are the cheapest that reach the
target recall at the similarity threshold. Band hashes are shuffled; the least node of a bucket leads it, so a node has at most one
leader a band and mostly few different ones. All buckets that a node leads are its star; nodes that share a band share a star.
Each star is verified exactly: intersection sizes of full sets, by blocks of nodes of bounded number and length, so that a star of any
size is dealt to tasks of bounded memory; no pair is emitted. A pair in several stars counts in the one of the least common leader.
Links between different texts are all counted; classes are the components of verified links.
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.shared import Generations, fresh, row_name, written

WORDS = 150_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)


def banding(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows) with 1 - (1 - threshold ** rows) ** bands >= recall: the most rows a band that `most` hashes allow."""
    best = None
    for rows in range(1, 17):
        hit = threshold**rows
        bands = 1 if hit >= 1 else int(np.ceil(np.log1p(-recall) / np.log1p(-hit)))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding of so few hashes reaches this recall")
    return best


class Shingler:
    """Sets of n-gram hashes and MinHash band keys."""

    def __init__(self, n: int, bands: int, rows: int, seed: int):
        self.n, self.bands, self.rows, self.seed = n, bands, rows, seed
        self.word = Generations(lambda w: xxhash.xxh3_64_intdigest(w, seed), WORDS)
        rng = np.random.default_rng(seed)
        self.mult = rng.integers(1, 1 << 63, bands * rows, np.uint64) | np.uint64(1)
        self.flip = rng.integers(0, 1 << 63, bands * rows, np.uint64)
        self.odd = np.resize(_ODD, n) + np.arange(n, dtype=np.uint64) * np.uint64(2)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; empty without words."""
        words = (text or "").split()
        if not words:
            return np.empty(0, np.uint64)
        w = np.array(list(map(self.word.__getitem__, words)), np.uint64)
        size = min(self.n, len(w))
        m = len(w) - size + 1
        h = np.full(m, size, np.uint64)
        for i in range(size):
            x = (w[i : i + m] + h) * self.odd[i]
            h = x ^ (x >> np.uint64(31))
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h.sort()
        return h[np.flatnonzero(np.diff(h, prepend=h[0] - np.uint64(1)))] if m > 1 else h

    def node(self, shingles: np.ndarray) -> tuple[int, int]:
        """Two 64-bit names of a set."""
        x = xxhash.xxh3_128_intdigest(shingles.tobytes(), self.seed)
        return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)

    def bands_of(self, shingles: np.ndarray) -> np.ndarray:
        """A key per band, as signed 64-bit numbers."""
        least = np.full(len(self.mult), np.iinfo(np.uint64).max)
        for at in range(0, len(shingles), 4096):
            part = shingles[at : at + 4096]
            for j in range(len(least)):
                v = ((part ^ self.flip[j]) * self.mult[j]).min()
                if v < least[j]:
                    least[j] = v
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for row in least.reshape(self.bands, self.rows).T:
            key = (key ^ row) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
        return key.view(np.int64)


def _signatures(rows: DataFrame, make) -> DataFrame:
    """(rk, doc_id, node, check, size, bands) of each row."""

    def run(batches):
        s = make()
        for batch in batches:
            nodes, checks, sizes, bands = [], [], [], []
            for text in batch.column(2).to_pylist():
                x = s.shingles(text)
                a, b = s.node(x) if len(x) else (None, None)
                nodes.append(a)
                checks.append(b)
                sizes.append(len(x))
                bands.append(s.bands_of(x) if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], ["rk", "doc_id", "node", "check", "size", "bands"])

    return rows.select("rk", "doc_id", "text").mapInArrow(run, "rk binary, doc_id long, node long, check long, size int, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge list (a, b) with a <> b: root is the least node of its component.

    Alternates large-star and small-star steps; each round is a written table, so no lineage grows and nothing is collected.
    Least neighbours are written too: their joins shuffle both sides, and Spark can split a hot node's edges.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    mark = None
    for turn in itertools.count():
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(new) == mark or not new[0]:
            break
        mark = tuple(new)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").filter("a <> b").distinct()
        now = written(small, f"stars{turn}")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix left x right (indexes into sets): Jaccard similarity at or above threshold, from full sets."""
    sizes = np.array([len(x) for x in sets])
    if len(left) == len(right) == 1:
        common = np.array([[len(np.intersect1d(sets[left[0]], sets[right[0]], assume_unique=True))]], np.float64)
    else:
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        shared = np.bincount(column) > 1  # a hash of one set adds nothing to an intersection
        name = np.cumsum(shared) - 1
        row = np.repeat(np.arange(len(sets)), sizes)
        take = shared[column]
        row, column = row[take], name[column[take]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(left), len(right)))
        width = max(256, 8_000_000 // max(1, len(sets)))
        for at in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(column, [at, at + width])
            dense = np.zeros((len(sets), min(width, int(shared.sum()) - at)), np.float32)
            dense[row[a:b], column[a:b] - at] = 1
            common += dense[left] @ dense[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return common / np.maximum(union, 1) >= threshold


def _verified(members: DataFrame, make, threshold: float) -> DataFrame:
    """(node, root, links) from rows (g, i, j, block, node, weight, leaders, text), dealt and sorted by g, i, j. A unit holds the nodes of two blocks."""

    def unit(rows, g, i, j):
        sets = [r[3] for r in rows]
        nodes, weights = [r[1] for r in rows], np.array([r[2] for r in rows])
        at = np.array([r[0] for r in rows])
        left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
        if not len(left) or not len(right):
            return []
        near = linked(sets, left, right, threshold)
        before = {x: n for n, x in enumerate({x for r in rows for x in r[4] if x < g})}
        if before:  # pairs that have a lesser leader in common count there
            led = np.zeros((len(rows), len(before)), np.float32)
            for n, r in enumerate(rows):
                led[n, [before[x] for x in r[4] if x < g]] = 1
            near &= led[left] @ led[right].T == 0
        if i == j:
            np.fill_diagonal(near, False)
        links = np.zeros(len(rows))
        links[left] += near @ weights[right]
        if i != j:
            links[right] += near.T @ weights[left]
        # components of the unit's links: labels fall until they stay
        rank = np.argsort(np.argsort(nodes))
        label = rank.copy()
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        while True:
            old = label.copy()
            np.minimum.at(label, a, old[b])
            np.minimum.at(label, b, old[a])
            by_rank = np.empty(len(label), np.int64)
            by_rank[rank] = label
            label = by_rank[label]
            if (label == old).all():
                break
        name = np.empty(len(nodes), np.int64)
        name[rank] = nodes
        return [(n, int(name[label[k]]), int(links[k])) for k, n in enumerate(nodes)]

    def run(batches):
        s, at, held = make(), None, {}
        out: list[tuple] = []
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["node", "root", "links"])
        for batch in batches:
            for g, i, j, block, node, weight, leaders, text in zip(*(batch.column(c).to_pylist() for c in range(8))):
                if (g, i, j) != at:
                    if held:
                        out += unit(list(held.values()), *at)
                    at, held = (g, i, j), {}
                if node not in held:  # rows that are repeated come each
                    held[node] = (block, node, weight, s.shingles(text), leaders)
            if out:
                yield batch_of(out)
                out = []
        if held and (out := unit(list(held.values()), *at)):
            yield batch_of(out)

    return members.select("g", "i", "j", "block", "node", "weight", "leaders", "text").mapInArrow(run, "node long, root long, links long")


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, block: int = 512, block_grams: int = 1 << 20, seed: int = 1) -> DataFrame:
    """(rk, doc_id, node, class_id, n_links) of each row of docs (doc_id, text).

    class_id is the least doc_id of the row's class, n_links the number of other rows whose n-gram sets have a Jaccard similarity of at
    least `threshold` with the row's (copies included). Null and empty texts and texts of white space have no n-grams: a class
    each, no links. Null doc_ids stay null and give a null class_id only where a class has no other. Repeated rows are rows of their
    own. An empty table gives no rows. rk is a 128-bit name of (doc_id, text). A unit of verification holds two blocks of about `block`
    nodes and block_grams n-grams each (or one longer text).
    """
    bands, per = banding(threshold, recall)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rk", row_name(F.col("doc_id"), F.col("text")))
    for attempt in itertools.count(seed):  # names of sets are 64 bits; a second name tells collisions, which another seed mends
        make = lambda attempt=attempt: Shingler(n, bands, per, attempt)
        signed = written(_signatures(rows, make), "signatures")
        nodes = written(signed.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("weight"), F.min("rk").alias("rk"), F.max("size").alias("size"), F.min("check").alias("low"), F.max("check").alias("high")), "nodes")
        if nodes.filter("low <> high").isEmpty():
            break
    keys = signed.filter("node IS NOT NULL").select("node", F.explode("bands").alias("band"))
    buckets = written(keys.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("most")).filter("leader < most").select("band", "leader"), "buckets")
    led = keys.join(buckets, "band").groupBy("node").agg(F.array_sort(F.collect_set("leader")).alias("leaders"))  # at most a leader a band
    placed = written(led.join(nodes.select("node", "weight", "rk", "size"), "node"), "candidates")
    member = placed.select("node", "size", F.explode("leaders").alias("g"))
    stars = written(member.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("size") / block_grams)).cast("int").alias("blocks")), "stars")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct("g", F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j"), "block"))
    units = member.join(stars, "g").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("node", pairs.alias("units"))
    units = units.groupBy("node").agg(F.flatten(F.collect_list("units")).alias("units"))
    where = written(placed.join(units, "node").select("rk", "node", "weight", "leaders", "units"), "units")
    texts = rows.select("rk", "text").hint("merge").join(where, "rk")  # neither side has a bound
    dealt = texts.select("node", "weight", "leaders", "text", F.explode("units").alias("u")).select("u.*", "node", "weight", "leaders", "text").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    links = written(_verified(dealt, make, threshold), "links")
    tied = components(links.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "weight").join(tied, "node", "left").join(counted, "node", "left")
    known = written(known.select("node", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "known")
    full = signed.select("rk", "doc_id", "node").join(known, "node", "left")
    classes = written(full.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least_id")), "least_ids")
    return full.join(classes, "root", "left").select("rk", "doc_id", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, without all but one row of each class: the least doc_id (nulls last), then rk, stays. Rows without n-grams all stay."""
    linked_rows = written(join(docs, **options), "classes").filter("n_links > 0")
    many = written(linked_rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("keep")), "kept")
    name = fresh("rk", docs)
    gone = linked_rows.join(many, "root").filter("rk <> keep.rk").select(F.col("rk").alias(name)).distinct()
    keyed = docs.withColumn(name, row_name(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    kept = keyed.hint("merge").join(gone, name, "left_anti")
    twice = written(linked_rows.groupBy("rk").count().filter("count > 1").select(F.col("rk").alias(name)), "repeated_rows")
    if not twice.isEmpty():  # the same row more than once
        kept = kept.join(twice, name, "left_anti").unionByName(kept.join(twice, name, "left_semi").dropDuplicates([name]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(documents: DataFrame) -> DataFrame:
    return join(documents).select("doc_id", "class_id", "n_links")
