"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Rows are dealt to shards of bounded size; each shard sorts one list per dimension, once, and then all queries stream
past it. For a query the lists are read from their best end (highest value where the query's component is positive, lowest where it
is negative), to depths that double; every row met is scored in full by random access. Reading stops when the bound, the
score of a row made of the values at the lists' heads, is below the k-th score (at a tie it goes on: a smaller id could still
win), and for no other reason. The k best of each shard are merged by rank.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.shared import written

FOUND = "q long, vec_id long, score long, scored long, depth long"


class Lists:
    """The sorted lists of one shard. ids must rise, so that positions break ties."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(rows, self.order, axis=0)

    def top(self, own: int | None, q: np.ndarray, k: int, first: int = 8) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Positions and scores of the k best rows whose id isn't `own`, how many rows were scored, and the depth read."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        up = q[dims] > 0
        high, low, weights = dims[up], dims[~up], np.concatenate([q[dims[up]], q[dims[~up]]])
        seen = self.ids == own
        wanted, scored = min(k, n - int(seen.sum())), 0
        best, scores = np.empty(0, np.int64), np.empty(0, q.dtype)
        depth = 0
        while depth < n:
            to = min(n, max(first, 2 * depth)) if len(dims) else n
            met = np.zeros(n, bool) if len(dims) else np.ones(n, bool)  # without lists all rows tie
            met[self.order[n - to : n - depth, high].ravel()] = True
            met[self.order[depth:to, low].ravel()] = True
            new, depth = np.flatnonzero(met & ~seen), to
            seen |= met
            scored += len(new)
            at, got = np.concatenate([best, new]), np.concatenate([scores, self.rows[new] @ q])
            keep = np.lexsort((at, -got))[:k]
            best, scores = at[keep], got[keep]
            if len(best) == wanted and (not wanted or scores[-1] > np.concatenate([self.sorted[n - depth, high], self.sorted[depth - 1, low]]) @ weights):
                break
        return best, scores, scored, depth


def _whole(rows: list, scale: float) -> np.ndarray:
    """Whole numbers floor(scale * x) as doubles, in which their products and sums are exact below 2**53; else as Python's integers."""
    out = np.floor(np.array(rows, np.float64).reshape(len(rows), -1) * scale)
    return _exact(out) if out.size and float(np.abs(out).max()) ** 2 * out.shape[1] >= 2.0**52 else out


def _exact(rows: np.ndarray) -> np.ndarray:
    return rows if rows.dtype == object else np.array([[int(x) for x in r] for r in rows.tolist()], object).reshape(rows.shape)


def _search(batches, k: int, scale: float):
    """FOUND batches from rows (dims, shard, q, vec_id, embedding), sorted: those of a shard first (q null), then its queries."""
    at, ids, held, lists = None, [], [], None
    for batch in batches:
        out: list[tuple] = []
        for dims, shard, q, vec_id, x in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (dims, shard) != at:
                at, ids, held, lists = (dims, shard), [], [], None
            if q is None:
                # sorted by id and value: of equal rows no more than k can be among the k best
                if len(ids) < k or (ids[-k], held[-k]) != (vec_id, x):
                    ids.append(vec_id)
                    held.append(x)
                continue
            if not ids:
                continue
            if lists is None:
                lists, held = Lists(np.array(ids, np.int64), _whole(held, scale)), []
                largest = float(np.abs(lists.rows.astype(float)).max()) if lists.rows.size else 0.0
            asked = _whole([x], scale)
            if object not in (asked.dtype, lists.rows.dtype) and asked.size and float(np.abs(asked).max()) * largest * dims >= 2.0**52:
                asked = _exact(asked)
            if object in (asked.dtype, lists.rows.dtype) and lists.rows.dtype != asked.dtype:
                asked, lists = _exact(asked), lists if lists.rows.dtype == object else Lists(lists.ids, _exact(lists.rows))
            best, scores, scored, depth = lists.top(vec_id, asked[0], k)
            out += [(q, int(i), int(s), scored, depth) for i, s in zip(lists.ids[best], scores)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [c.split()[0] for c in FOUND.split(", ")])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, shard_rows: int = 16384) -> DataFrame:
    """The k best vectors (vec_id, embedding) of each query row: query_id, rank, vec_id, score, scored, depth; ties go to the smaller id.

    Vectors that are null, or hold a null or non-finite component, take no part on either side. Only vectors of
    equal length are compared. Rows that bear the query's id are its own and no candidates; other repeated rows each
    count. Repeated queries have a result each. A query without candidates, and empty tables, give no rows. Rows without an id take no
    part. A score beyond 64 bits fails. scored and depth: rows scored, and depth of lists read, for the query in the row's shard.

    A shard holds about shard_rows rows; every query goes to every shard, so the pairs scored grow with both sides, as exact search asks.
    """
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col("vec_id").isNotNull()
    pick = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(sound).withColumn("dims", F.size("embedding"))
    rows = pick(vectors)
    asked = written(pick(queries).groupBy("vec_id", "embedding", "dims").agg(F.count("*").alias("copies")).withColumn("q", F.monotonically_increasing_id()), "queries")
    shards = max(1, -(-rows.count() // shard_rows))
    data = rows.select("dims", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("long").alias("q"), "vec_id", "embedding")
    ask = asked.select("dims", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "q", "vec_id", "embedding")
    dealt = data.unionByName(ask).repartition("dims", "shard").sortWithinPartitions("dims", "shard", F.col("q").asc_nulls_first(), "vec_id", "embedding")
    found = dealt.mapInArrow(lambda batches: _search(batches, k, scale), FOUND)
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = ranked.join(asked.select("q", F.col("vec_id").alias("query_id"), "copies"), "q")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("query_id", "rank", "vec_id", "score", "scored", "depth")


def query(embeddings: DataFrame) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 50; candidates: every row."""
    return top_k(embeddings, embeddings.filter(F.col("vec_id") % 50 == 0)).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
