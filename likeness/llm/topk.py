"""Exact top-k by inner product with the threshold algorithm, in blocks.

Candidates are dealt by a hash to blocks of about 8,192 rows, queries to groups of about
1,024; a task gets one block and one group, so that its memory is bounded and each side
is sent once per block or group of the other. In a block every dimension has a list of its
rows in order of their values. A query reads the lists of its dimensions in step, from the
top where its own component is positive and from the bottom where it is negative, looks up
the whole vector of every row it meets, and stops once its k-th score is above the
threshold: the inner product with the values next in the lists, which no unread row can
exceed. Lists are read in stretches, and the first is as long as no vector of the block's
greatest length could stop before. The k best of all blocks make the result.

Of equal vectors only the k + 1 smallest ids can be among the best of any query; the others are
left out before the search. Sums are exact: in floating point while they stay below
2**53, in integers otherwise.

Vectors that are null or hold null or non-finite components take no part. A missing
component of a shorter vector counts 0, an empty vector scores 0 with all. Ties go to the smaller id. Rows
of a query's own id are not its candidates; of several query rows with one id the least
vector counts, candidates that repeat an id are all ranked. Other columns play no part.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from likeness.sources.checkpoints import written

BLOCK_ROWS = 8192
GROUP_QUERIES = 1024
STRETCH = 4
FOUND = "query_id long, vec_id long, score long"


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < n[:, None]] = lists.flatten().to_numpy()
    return out


class SortedLists:
    """A block of vectors, and for each dimension its rows in ascending order of value."""

    def __init__(self, vectors: np.ndarray, largest: int):
        # Whole numbers below 2**53 are exact as floats.
        exact = int(np.abs(vectors).max(initial=0)) * largest * max(1, vectors.shape[1]) < 1 << 53
        self.vectors = vectors.astype(np.float64) if exact else vectors
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)
        self.length = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))

    def depths(self) -> list[int]:
        n, found = len(self.vectors), []
        while n > 16:
            found.append(n)
            n //= STRETCH
        return [n, *found[::-1]]

    def thresholds(self, queries: np.ndarray, depths: list[int]) -> np.ndarray:
        """What an unread row can score at most, by query and depth."""
        n = len(self.vectors)
        at = np.array([d for d in depths if d < n], int)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.values[n - 1 - at].T + down @ self.values[at].T

    def search(self, query: np.ndarray, ids: np.ndarray, own: int, k: int,
               depths: list[int], thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k best and their scores, ties to the smaller id."""
        n = len(self.vectors)
        upper, lower = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        most = float(np.sqrt((query.astype(np.float64) ** 2).sum())) * self.length * (1 + 1e-9)
        seen = np.zeros(n, bool)
        best, scores = np.empty(0, np.int64), np.empty(0, self.vectors.dtype)
        read = 0
        for i, depth in enumerate(depths):
            if depth < n and thresholds[i] > most:
                continue  # no score can be above this threshold: read on
            fresh = np.ones(n, bool) if depth >= n else np.zeros(n, bool)
            if depth < n:
                fresh[self.order[n - depth:n - read][:, upper]] = True
                fresh[self.order[read:depth][:, lower]] = True
            fresh &= ~seen
            seen |= fresh
            rows = np.flatnonzero(fresh)
            rows = rows[ids[rows] != own]
            best = np.concatenate([best, rows])
            scores = np.concatenate([scores, self.vectors[rows] @ query])
            if len(best) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                near = scores >= kth
                best, scores = best[near], scores[near]
                order = np.lexsort((ids[best], -scores))[:k]
                best, scores = best[order], scores[order]
            read = depth
            if depth >= n or len(best) >= k and scores.min() > thresholds[i]:
                break
        order = np.lexsort((ids[best], -scores))[:k]
        return best[order], scores[order]


def _search_block(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(candidates) or not len(queries):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.int64())})
        width = max(max(map(len, t.column("vector").to_pylist())) for t in (candidates, queries))
        sought = _matrix(queries.column("vector"), width)
        block = SortedLists(_matrix(candidates.column("vector"), width), int(np.abs(sought).max(initial=0)))
        ids, own = candidates.column("id").to_numpy(), queries.column("id").to_numpy()
        sought = sought.astype(block.vectors.dtype)
        depths = block.depths()
        thresholds = block.thresholds(sought, depths)
        found = [block.search(q, ids, o, k, depths, t) for q, o, t in zip(sought, own, thresholds)]
        return pa.table({
            "query_id": np.repeat(own, [len(r) for r, _ in found]),
            "vec_id": ids[np.concatenate([r for r, _ in found]).astype(np.int64)],
            "score": np.concatenate([s for _, s in found]).astype(np.int64)})
    return run


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` from two tables of ``id`` and ``vector`` (array<long>)."""
    # Of equal vectors the k + 1 smallest ids can be among a query's best (one may be its own), each id k times.
    same, again = (W.partitionBy(F.xxhash64("vector"), "vector", *by).orderBy("id") for by in ((), ("id",)))
    candidates = written(candidates.withColumn("again", F.row_number().over(again)).where(F.col("again") <= k).withColumn(
        "copy", F.dense_rank().over(same)).where(F.col("copy") <= k + 1).select("id", "vector"), "candidates")
    queries = written(queries.groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    blocks = max(1, -(-candidates.count() // BLOCK_ROWS))
    groups = max(1, -(-queries.count() // GROUP_QUERIES))

    def dealt(df, own, n_own, other, n_other):
        return df.withColumn(own, F.pmod(F.xxhash64("id", F.lit(own)), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).groupBy("block", "part")

    found = dealt(candidates, "block", blocks, "part", groups).cogroup(
        dealt(queries, "part", groups, "block", blocks)).applyInArrow(_search_block(k), FOUND)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"))
    return top_k(rows.where("id % 50 = 0"), rows.where("id IS NOT NULL"), 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
