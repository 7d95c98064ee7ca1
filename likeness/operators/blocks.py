"""Distances between blocks of vectors, and the nearest of each query kept.

A block pair is one group of a cogroup: a bounded chunk of master rows and a
bounded chunk of query rows. A task computes the chunk's distances as one matrix
product and gives out each query's ``k`` nearest only, so pairs of rows are never
shuffled, however many rows share a key.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from likeness.sources.checkpoints import written

BLOCK_ROWS = 8192
TILE_ROWS = 512

# Pairs of vectors compared by row at a time.
SLICE_ROWS = 1024

# Distances equal to this many digits are ties, settled by customer id.
TIE_DIGITS = 9

# Coordinates whose squares single precision holds, and room for those too small for it.
MOST_NARROW = 1e15
LEAST_NARROW = 1e-36

# Small blocks are put together to about this many times the rows of the largest of them.
PACKED = 4

# Sizes of at most this many blocks are sent to every task.
BROADCAST_BLOCKS = 200_000


def matrix(column) -> np.ndarray:
    """An Arrow list column, all of one width, as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.empty((0, 0))
    widths = np.diff(column.offsets.to_numpy())
    if column.null_count or (widths != widths[0]).any():
        raise ValueError("vectors of different widths, or missing; filter them first")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1)


def in_metric_space(x: np.ndarray, metric: str) -> np.ndarray:
    """Coordinates in which Euclidean order is the metric's order.

    Cosine: unit vectors, with one more coordinate that is 1 for zero vectors,
    which puts these at distance 1 from all others and 0 from each other.
    """
    if metric == "euclidean" or not len(x):
        return x
    length = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    return np.hstack([unit, (length == 0).astype(np.float64)])


def straight_gaps(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Euclidean distances by one matrix product."""
    squares = (q * q).sum(1)[:, None] + (m * m).sum(1)[None, :] - 2.0 * (q @ m.T)
    return np.sqrt(np.maximum(squares, 0.0))


def row_distances(metric: str):
    """Replaces ``q_vec`` and ``m_vec`` of each row by their distance."""
    def run(batches):
        for batch in batches:
            # A slice at a time, as doubles take twice the room, and several copies.
            for part in (batch.slice(start, SLICE_ROWS) for start in range(0, batch.num_rows, SLICE_ROWS)):
                q, m = (in_metric_space(matrix(part[c]), metric) for c in ("q_vec", "m_vec"))
                if metric == "cosine":
                    gaps = np.maximum(1.0 - np.einsum("ij,ij->i", q, m), 0.0)
                else:
                    gaps = np.linalg.norm(q - m, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part["query_id"], part["customer_id"], pa.array(gaps)],
                    ["query_id", "customer_id", "vdist"])
    return run


def _first_k(rows, order_by, k):
    """Positions of the first ``k`` entries of each row, in the given order."""
    order = np.lexsort((*reversed(order_by), rows))
    sorted_rows = rows[order]
    starts = np.r_[0, np.flatnonzero(np.diff(sorted_rows)) + 1]
    lengths = np.diff(np.r_[starts, len(sorted_rows)])
    place = np.arange(len(sorted_rows)) - np.repeat(starts, lengths)
    return order[place < k]


def nearest_in_block(q, q_cluster, m, m_id, m_cluster, k, metric):
    """(query row, customer id, distance) of each query's ``k`` nearest rows.

    Rows of the query's own cluster are left out where clusters are given.
    """
    found = []
    for start in range(0, len(q), TILE_ROWS):
        tile = q[start:start + TILE_ROWS]
        if metric == "cosine":
            gaps = np.maximum(1.0 - tile @ m.T, 0.0)
            slack = 1e-9
        else:
            gaps = straight_gaps(tile, m)
            # The product form loses digits near zero; keep what may belong.
            slack = 1e-6 * (1.0 + np.abs(gaps).max(initial=0.0))
        if q_cluster is not None:
            own = q_cluster[start:start + TILE_ROWS, None] == m_cluster[None, :]
            gaps = np.where(own, np.inf, gaps)
        if gaps.shape[1] > k:
            bound = np.partition(gaps, k - 1, axis=1)[:, k - 1:k]
            rows, cols = np.nonzero((gaps <= bound + slack) & np.isfinite(gaps))
        else:
            rows, cols = np.nonzero(np.isfinite(gaps))
        if not len(rows):
            continue
        if metric == "cosine":
            exact = gaps[rows, cols]
        else:
            exact = np.empty(len(rows))
            for s in range(0, len(rows), 1 << 15):
                part = slice(s, s + (1 << 15))
                exact[part] = np.linalg.norm(tile[rows[part]] - m[cols[part]], axis=1)
        if gaps.shape[1] > k:
            keep = _first_k(rows, (np.round(exact, TIE_DIGITS), m_id[cols]), k)
            rows, cols, exact = rows[keep], cols[keep], exact[keep]
        found.append((rows + start, m_id[cols], exact))
    if not found:
        return np.empty(0, np.int64), np.empty(0, m_id.dtype), np.empty(0)
    return tuple(np.concatenate(parts) for parts in zip(*found))


class Best:
    """Each query's ``k`` nearest of the customers seen so far, the lowest id first among equals."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.ids = np.zeros((rows, k), np.int64)
        self.gaps = np.full((rows, k), np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, gaps: np.ndarray) -> None:
        """Customers of some queries: a row for each of ``at``, infinitely far where there is none."""
        gaps = np.hstack([self.gaps[at], gaps])
        ids = np.hstack([self.ids[at], ids])
        order = np.round(gaps, TIE_DIGITS)
        pick = np.argpartition(order, self.k - 1, axis=1)[:, :self.k]
        last = np.take_along_axis(order, pick, 1).max(axis=1, keepdims=True)
        tied = np.flatnonzero((np.count_nonzero(order <= last, axis=1) > self.k) & np.isfinite(last[:, 0]))
        if len(tied):
            pick[tied] = np.lexsort((ids[tied], order[tied]), axis=-1)[:, :self.k]
        self.ids[at], self.gaps[at] = (np.take_along_axis(x, pick, 1) for x in (ids, gaps))

    def add_pairs(self, at: np.ndarray, rows: np.ndarray, ids: np.ndarray, gaps: np.ndarray) -> None:
        """Pairs of a place in ``at`` and a customer, in order of the places."""
        if not len(rows):
            return
        counts = np.bincount(rows, minlength=len(at))
        asked = np.flatnonzero(counts)
        place = np.arange(len(rows)) - np.repeat((np.cumsum(counts) - counts)[asked], counts[asked])
        row = np.repeat(np.arange(len(asked)), counts[asked])
        wide = np.zeros((len(asked), counts.max()), np.int64), np.full((len(asked), counts.max()), np.inf)
        wide[0][row, place], wide[1][row, place] = ids, gaps
        self.add(at[asked], *wide)

    def bounds(self, at: np.ndarray) -> np.ndarray:
        """The distance of each query's last; infinite while there are fewer than ``k``."""
        return self.gaps[at].max(axis=1)

    def listed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, customer ids and distances, in order."""
        order = np.lexsort((self.ids, np.round(self.gaps, TIE_DIGITS)), axis=-1)
        ids, gaps = (np.take_along_axis(x, order, 1) for x in (self.ids, self.gaps))
        rows, cols = np.nonzero(np.isfinite(gaps))
        return rows, ids[rows, cols], gaps[rows, cols]


class NearestSoFar:
    """Each query's ``k`` nearest among the customers seen so far, both in the metric's space.

    Products of single precision, at a bound on their error, tell which customers can still
    be among them; only the distances of these are worked out, in double precision.
    """

    def __init__(self, q: np.ndarray, k: int, metric: str = "euclidean"):
        self.q, self.k, self.metric = q, k, metric
        self.square = (q * q).sum(1)
        self.top = np.abs(q).max(initial=0.0)
        self.narrow = np.hstack([-2.0 * q, np.ones((len(q), 1))]).astype(np.float32) if self.top < MOST_NARROW else None
        self.kept = Best(len(q), k)

    @property
    def best(self):
        return self.kept.listed()

    def see(self, q_cluster, m: np.ndarray, m_id: np.ndarray, m_cluster, asked: np.ndarray | None = None) -> None:
        """Some more customers, compared with the queries ``asked``, or with all."""
        asked = np.arange(len(self.q)) if asked is None else asked
        if self.narrow is None or not np.abs(m).max(initial=0.0) < MOST_NARROW:
            rows, ids, gaps = nearest_in_block(
                self.q[asked], None if q_cluster is None else q_cluster[asked], m, m_id, m_cluster, self.k, self.metric)
            order = np.argsort(rows, kind="stable")
            self.kept.add_pairs(asked, rows[order], ids[order], gaps[order])
        elif len(m):
            self._see_narrow(q_cluster, m, m_id, m_cluster, asked)

    def _see_narrow(self, q_cluster, m, m_id, m_cluster, asked):
        square = (m * m).sum(1)
        narrow = np.hstack([m, square[:, None]]).astype(np.float32).T
        # Each of the products, their sums and the numbers put in is off by a rounding at most.
        off = 4 * (m.shape[1] + 8) * np.finfo(np.float32).eps
        for start in range(0, len(asked), TILE_ROWS):
            at = asked[start:start + TILE_ROWS]
            gaps = self.narrow[at] @ narrow
            slack = off * (np.sqrt(self.square[at]) + np.sqrt(square.max(initial=0.0))) ** 2 + LEAST_NARROW
            if q_cluster is not None:
                own = np.flatnonzero(np.isin(m_cluster, q_cluster[at]))
                part = gaps[:, own]
                part[q_cluster[at, None] == m_cluster[own]] = np.inf
                gaps[:, own] = part
            # Room for ties, which the ids settle.
            bound = self.kept.bounds(at)
            most = self._squared(bound + 2 * 10.0 ** -TIE_DIGITS) - self.square[at]
            if np.isinf(most).any() and gaps.shape[1] >= self.k:
                here = np.partition(gaps, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64) + slack
                near = self._distance(np.maximum(here + self.square[at], 0.0)) + 2 * 10.0 ** -TIE_DIGITS
                most = np.minimum(most, self._squared(near) - self.square[at])
            least = np.minimum(most + slack, np.finfo(np.float32).max / 2).astype(np.float32)
            found = np.flatnonzero(gaps <= np.nextafter(least, np.float32(np.inf))[:, None])
            rows, cols = np.divmod(found, gaps.shape[1])
            exact = np.empty(len(rows))
            for s in range(0, len(rows), 1 << 12):
                part = slice(s, s + (1 << 12))
                x, y = self.q[at[rows[part]]], m[cols[part]]
                exact[part] = np.maximum(1.0 - np.einsum("ij,ij->i", x, y), 0.0) if self.metric == "cosine" else np.linalg.norm(x - y, axis=1)
            self.kept.add_pairs(at, rows, m_id[cols], exact)

    def _squared(self, gap):
        """The squared straight distance of vectors at this distance: unit vectors if it is the cosine's."""
        return 2.0 * gap if self.metric == "cosine" else gap ** 2

    def _distance(self, squared):
        return squared / 2.0 if self.metric == "cosine" else np.sqrt(squared)


def _cluster_codes(q, m):
    """Comparable codes of the two sides' clusters, or nothing."""
    if "cluster" not in q.column_names:
        return None, None
    both = pa.chunked_array([*q["cluster"].chunks, *m["cluster"].chunks], q.schema.field("cluster").type)
    codes = both.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    return codes[:q.num_rows], codes[q.num_rows:]


def result_schema(queries: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("customer_id", T.LongType()),
        T.StructField("vdist", T.DoubleType()),
    ])


def _near_in_tables(q: pa.Table, m: pa.Table, k: int, metric: str):
    qc, mc = _cluster_codes(q, m)
    if not q.num_rows or not m.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return nearest_in_block(
        in_metric_space(matrix(q["vec"]), metric), qc,
        in_metric_space(matrix(m["vec"]), metric), m["customer_id"].to_numpy(), mc, k, metric)


def block_task(k: int, metric: str):
    """The work on one block pair: an Arrow table in from each side, one out."""
    def work(q: pa.Table, m: pa.Table) -> pa.Table:
        rows, found, gaps = _near_in_tables(q, m, k, metric)
        return pa.table({
            "query_id": q["query_id"].take(pa.array(rows)),
            "customer_id": pa.array(found, pa.int64()),
            "vdist": pa.array(gaps, pa.float64()),
        })
    return work


def listing_task(k: int, metric: str):
    """As :func:`block_task`, with one row per query, its customers and distances as lists."""
    def work(q: pa.Table, m: pa.Table) -> pa.Table:
        rows, found, gaps = _near_in_tables(q, m, k, metric)
        asked = np.unique(rows)  # rows come in order
        bounds = pa.array(np.searchsorted(rows, np.r_[asked, q.num_rows]), pa.int32())
        return pa.table({
            "query_id": q["query_id"].take(pa.array(asked)),
            "ids": pa.ListArray.from_arrays(bounds, pa.array(found, pa.int64())),
            "gaps": pa.ListArray.from_arrays(bounds, pa.array(gaps, pa.float64()))})
    return work


def _merged_lists(k: int, once: bool = True):
    """Each query's ``k`` nearest of all its lists; a customer met in several counts once, unless not ``once``."""
    def work(table: pa.Table) -> pa.Table:
        lists = table["ids"].combine_chunks()
        codes = table["query_id"].combine_chunks().dictionary_encode("encode")
        row, sizes = codes.indices.to_numpy(), np.diff(lists.offsets.to_numpy())
        # The lists of a query one after another, as a row of a matrix.
        order = np.argsort(row, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.searchsorted(row[order], np.arange(len(codes.dictionary)))
        starts = np.empty(len(row), np.int64)
        starts[order] = ends - sizes[order] - (ends - sizes[order])[first][row[order]]
        width = max(k, int((starts + sizes).max(initial=0)))
        at = np.repeat(row, sizes), np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        ids, gaps = np.zeros((len(codes.dictionary), width), np.int64), np.full((len(codes.dictionary), width), np.inf)
        ids[at], gaps[at] = lists.flatten().to_numpy(), table["gaps"].combine_chunks().flatten().to_numpy()
        if once:
            order = np.argsort(ids, axis=-1, kind="stable")
            ids, gaps = (np.take_along_axis(x, order, 1) for x in (ids, gaps))
            met = np.zeros(ids.shape, bool)
            met[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & np.isfinite(gaps[:, :-1]) & np.isfinite(gaps[:, 1:])
            gaps[met] = np.inf
        best = Best(len(ids), k)
        best.add(np.arange(len(ids)), ids, gaps)
        query, ids, gaps = best.listed()
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        return pa.table({
            "query_id": codes.dictionary.take(pa.array(query)), "customer_id": pa.array(ids, pa.int64()),
            "vdist": pa.array(gaps, pa.float64()), "rank": pa.array(rank.astype(np.int32))})
    return work


def merge_lists(partial: DataFrame, k: int, groups: int, once: bool = True) -> DataFrame:
    """The ``k`` nearest per query over all lists, with their rank, in ``groups`` groups of queries."""
    schema = T.StructType([
        partial.schema["query_id"], T.StructField("customer_id", T.LongType()),
        T.StructField("vdist", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    # As many partitions as groups: by size, Spark would put them into a few tasks.
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups))
    return partial.repartition(groups, group).groupBy(group).applyInArrow(_merged_lists(k, once), schema)


def merge_nearest(partial: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest per query over all blocks, with their rank.

    Spark filters ranks within each task before it shuffles.
    """
    order = Window.partitionBy("query_id").orderBy(
        F.round("vdist", TIE_DIGITS), "customer_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= k)


def split_in_blocks(queries, master, sizes, block_rows=BLOCK_ROWS, pack_rows=0):
    """Both sides grouped by block and part, for a cogroup.

    ``queries`` and ``master`` carry a ``block`` column; ``sizes`` has ``block``,
    ``m_rows`` and ``q_rows``. A block of more than ``block_rows`` customers, or
    half as many queries, is split by a hash of the ids, and the other side's rows
    go to every part. Blocks absent from ``sizes`` are dropped before any shuffle
    of vectors.

    Blocks of at most ``pack_rows`` on both sides share groups of about ``PACKED`` times
    that many rows; their rows then are to be told apart by ``block``.

    The sizes are written and counted, as Spark takes them for larger than the rows with
    their vectors, whose lists it takes for short, and would send these to every task.
    """
    small = (F.col("m_rows") <= pack_rows) & (F.col("q_rows") <= pack_rows)
    group = [F.lit(0).alias("bin"), F.col("block").alias("alone")]
    if pack_rows:
        rows = sizes.filter(small).agg(F.sum(F.greatest("m_rows", "q_rows"))).first()[0] or 1
        bins = F.pmod(F.xxhash64("block"), F.lit(-(-rows // (PACKED * pack_rows))))
        group = [F.when(small, bins).otherwise(-1).alias("bin"),
                 F.when(small, "").otherwise(F.col("block")).alias("alone")]
    parts = written(sizes.select(
        "block", *group,
        F.ceil(F.col("m_rows") / block_rows).cast("int").alias("m_parts"),
        F.ceil(F.col("q_rows") / (block_rows / 2)).cast("int").alias("q_parts")), "parts")
    few = parts.count() <= BROADCAST_BLOCKS
    parts = F.broadcast(parts) if few else parts.hint("merge")

    def split(side, id_column, own, other):
        # Fresh aliases keep the two sides apart when both come from one table.
        fresh = side.select(*[F.col(c).alias(c) for c in side.columns])
        return (
            fresh.join(parts, "block")
            .withColumns({c: F.col(c).alias(c) for c in ("bin", "alone")})
            .withColumn(own, F.pmod(F.xxhash64(id_column), F.col(f"{own}s")))
            .withColumn(other, F.explode(
                F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}s").cast("bigint") - 1)))
            .drop("m_parts", "q_parts"))

    keys = ["bin", "alone", "m_part", "q_part"]
    return (split(queries, "query_id", "q_part", "m_part").groupBy(*keys),
            split(master, "customer_id", "m_part", "q_part").groupBy(*keys))


def nearest_in_blocks(
    queries: DataFrame,
    master: DataFrame,
    sizes: DataFrame,
    k: int,
    metric: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Each query's ``k`` nearest within each ``block`` that it shares."""
    q, m = split_in_blocks(queries, master, sizes, block_rows)
    return q.cogroup(m).applyInArrow(block_task(k, metric), result_schema(queries))


def lists_in_blocks(
    queries: DataFrame, master: DataFrame, sizes: DataFrame, k: int, metric: str, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """As :func:`nearest_in_blocks`, one row per query and block: ``query_id``, ``ids``, ``gaps``."""
    q, m = split_in_blocks(queries, master, sizes, block_rows)
    return q.cogroup(m).applyInArrow(listing_task(k, metric), T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("gaps", T.ArrayType(T.DoubleType()))]))
