"""Exact and approximate nearest-neighbour joins of queries with customers."""

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from likeness.operators import blocks, codes, rounds
from likeness.sources.checkpoints import written

# At most this many queries, of at most this many bytes, are sent to every task.
BROADCAST_ROWS = 1024
BROADCAST_BYTES = 32 << 20
MAX_PIVOTS = 1024

# Where vectors rule few cells out, blocks grow until a query goes to about this many, or
# the rows of one side of a block take this many bytes.
MAX_VISITS = 16
BLOCK_BYTES = 32 << 20
SAMPLED_QUERIES = 256

# Up to this many nearest are searched by codes; beyond, joining that many full vectors to
# each query costs more than comparing all in full.
CODED_K = 32

# About how many queries' candidates are merged at a time.
MERGED_QUERIES = 2048

# Hash tables of the approximate search, and about how many customers share a bucket.
TABLES = 8
BUCKET_ROWS = 128

# Where a shuffle would copy more bytes of vectors than this, queries go out in rounds instead.
COPIED_BYTES = 2 << 30

# Room for rounding when a cell is ruled out.
SLACK = 1e-6


def kept_copies(master: DataFrame, k: int) -> DataFrame:
    """At most ``k`` rows of each group of equal vectors, those of lowest id.

    More of them can never be among the ``k`` nearest of any query, as ids settle
    ties; so a group of copies stays small whatever its share of the table. Copies
    are told apart by ``cluster`` and ``block`` where there are such columns.

    Hashes are counted first, map-side. Only rows of a hash held by more than
    ``k`` are shuffled, ranked within each task before that; the rest stays put.
    """
    by = [c for c in ("cluster", "block") if c in master.columns]
    hashed = master.withColumn("_hash", F.xxhash64("vec", *by))
    often = written(
        hashed.groupBy("_hash").agg(F.count("*").alias("n"))
        .filter(F.col("n") > k).select("_hash"), "copied")
    if often.isEmpty():
        return master
    order = Window.partitionBy("_hash", "vec", *by).orderBy("customer_id")
    few = (
        hashed.join(often, "_hash", "left_semi")
        .withColumn("_copy", F.row_number().over(order)).filter(F.col("_copy") <= k))
    rest = hashed.join(often, "_hash", "left_anti")
    return rest.select(*master.columns).unionByName(few.select(*master.columns))


def _with_vectors(side: DataFrame, dim: int | None) -> DataFrame:
    """Rows that have a vector, of the right width where one is named."""
    side = side.filter(F.col("vec").isNotNull())
    return side if dim is None else side.filter(F.size("vec") == dim)


def nearest(
    queries: DataFrame,
    master: DataFrame,
    k: int,
    metric: str = "cosine",
    *,
    dim: int | None = None,
    block_rows: int = blocks.BLOCK_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
    max_pivots: int = MAX_PIVOTS,
    max_compared: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """The exact ``k`` nearest customers of every query, ranked; ``stored`` says that several steps read them.

    ``queries``: ``query_id``, ``vec``; ``master``: ``customer_id``, ``vec``. When
    both also have ``cluster``, customers of a query's own cluster are left out;
    ``queries`` then has ``cluster_size``, at least the number of those. Customers
    without a vector, or of another width than ``dim``, are nobody's neighbours.

    A few queries are sent to every task of one scan of the master. More are
    joined cell by cell: customers are assigned to the nearest of a bounded set of
    pivots, and the triangle inequality tells which cells a query need not visit. That
    helps with grouped vectors in few dimensions; in many dimensions few cells are
    ruled out, and the work comes near all pairs, in blocks of bounded size. As each row is
    copied to every block it meets, blocks are then made larger than ``block_rows``, up to
    ``BLOCK_BYTES``, so that a query goes to about ``MAX_VISITS``. For up to
    ``CODED_K`` nearest these pairs are compared by byte codes with error bounds, and in full only
    where the bounds leave a pair in the running. Where the blocks' copies would take more than
    ``COPIED_BYTES``, customers stay where they lie, in order of their cells, and the queries are
    sent to them in rounds (:mod:`likeness.operators.rounds`). ``max_compared`` refuses more pairs than that;
    :func:`approximate_nearest` does not compare all.
    """
    queries, master = _with_vectors(queries, dim), _with_vectors(master, dim)
    if "cluster" in queries.columns and "cluster" not in master.columns:
        queries = queries.drop("cluster", "cluster_size")
    few = _few_queries(queries, broadcast_rows)
    if few is not None:
        partial = _scan_with(few, master, queries, k, metric)
    else:
        # Counted without the vectors, so that no vector is read for it.
        rows, asked = master.select("customer_id").count(), queries.select("query_id").count()
        if max_compared is not None and rows * asked > max_compared:
            raise ValueError(
                f"{asked} x {rows} vectors are more pairs than max_compared ({max_compared})")
        if _copied_bytes(master, rows, asked, block_rows) > COPIED_BYTES:
            return _cells_in_rounds(queries, master, rows, asked, k, metric, block_rows, max_pivots)
        partial = _join_cells(queries, master, rows, k, metric, block_rows, max_pivots)
    found = blocks.merge_nearest(partial, k)
    return written(found, "nearest") if stored else found


def _width(master: DataFrame) -> int:
    """Bytes of a vector."""
    first = master.select(F.size("vec")).first()
    return (first[0] if first else 0) * np.dtype(rounds.kind_of(master)).itemsize


def _copied_bytes(master, rows, asked, block_rows) -> int:
    """What all copies take when every query goes to all blocks, these as large as they may grow."""
    width = max(1, _width(master))
    room = max(block_rows, BLOCK_BYTES // width)
    return width * (asked * -(-rows // room) + rows * -(-2 * asked // room))


def _few_queries(queries: DataFrame, limit: int) -> pa.Table | None:
    """The queries, when they are few enough for every task; else nothing."""
    if limit < 1 or queries.select("query_id").limit(limit + 1).count() > limit:
        return None
    table = queries.drop("cluster_size").limit(limit).toArrow()
    return table if table.nbytes <= BROADCAST_BYTES else None


def _scan_with(few, master, queries, k, metric):
    context = master.sparkSession.sparkContext
    shared = context.broadcast(few)

    def scan(batches):
        q = shared.value
        vectors = blocks.in_metric_space(blocks.matrix(q["vec"]), metric)
        near = blocks.NearestSoFar(vectors, k) if metric == "euclidean" else None
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for batch in batches:
            if not batch.num_rows or not q.num_rows:
                continue
            m = pa.Table.from_batches([batch])
            qc, mc = blocks._cluster_codes(q, m)
            if near is not None:
                near.see(qc, blocks.matrix(m["vec"]), m["customer_id"].to_numpy(), mc)
                best = near.best
                continue
            found = blocks.nearest_in_block(
                vectors, qc, blocks.in_metric_space(blocks.matrix(m["vec"]), metric),
                m["customer_id"].to_numpy(), mc, k, metric)
            rows, ids, gaps = (np.concatenate(p) for p in zip(best, found))
            keep = blocks._first_k(rows, (np.round(gaps, blocks.TIE_DIGITS), ids), k)
            best = rows[keep], ids[keep], gaps[keep]
        rows, ids, gaps = best
        yield from pa.table({
            "query_id": q["query_id"].take(pa.array(rows)),
            "customer_id": pa.array(ids, pa.int64()),
            "vdist": pa.array(gaps, pa.float64()),
        }).to_batches(max_chunksize=1 << 16)

    columns = [c for c in ("customer_id", "vec", "cluster") if c in master.columns]
    return master.select(*columns).mapInArrow(scan, blocks.result_schema(queries))


def _pivots(master: DataFrame, rows: int, count: int, metric: str) -> np.ndarray:
    """A bounded, repeatable choice of distinct customers' vectors.

    Ids are thinned out by their hash first, so that few rows are sorted.
    """
    place = F.xxhash64("customer_id")
    thin = place.bitwiseAND((1 << 31) - 1) < int(min(1.0, 4 * count / rows) * (1 << 31))
    candidates = master.select("customer_id", "vec")
    for some in (candidates.filter(thin), candidates):
        chosen = some.orderBy(place, "customer_id").limit(count).toArrow()
        if chosen.num_rows:
            break
    return np.unique(
        blocks.in_metric_space(blocks.matrix(chosen["vec"]), metric), axis=0)


def _cells(queries, master, rows, k, metric, block_rows, max_pivots, keep):
    """Pivots, the customers with their cells, rows and reach of the cells, their blocks, and the rows of a block.

    ``keep`` stores the customers: it gets the pivots and the few copies, and gives a table with ``cell`` and ``reach``.
    """
    pivots = _pivots(
        master, rows, min(max_pivots, math.ceil(4 * rows / block_rows)), metric)
    celled, width = keep(pivots)
    # One row per pivot.
    cells = celled.groupBy("cell").agg(
        F.count("*").alias("m_rows"), F.max("reach").alias("reach")).collect()
    size, reach = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for cell in cells:
        size[cell["cell"]], reach[cell["cell"]] = cell["m_rows"], cell["reach"]
    block = _packed(pivots, size, block_rows)
    if block[-1:].size and block.max() >= MAX_VISITS:
        visits = _usual_visits(queries, pivots, size, reach, block, k, metric)
        room = max(block_rows, BLOCK_BYTES // (pivots.shape[1] * width))
        block_rows = min(room, math.ceil(block_rows * max(1.0, visits / MAX_VISITS)))
        block = _packed(pivots, size, block_rows)
    return pivots, celled, size, reach, block, block_rows


def _query_fields(queries, columns):
    return [queries.schema[c] for c in ("query_id", "vec", "cluster")
            if c in queries.columns and (c != "cluster" or "cluster" in columns)]


def _join_cells(queries, master, rows, k, metric, block_rows, max_pivots):
    spark = master.sparkSession
    if not rows or master.isEmpty():
        return spark.createDataFrame([], blocks.result_schema(queries))
    coded = k <= CODED_K
    columns = [c for c in ("customer_id", "vec", "cluster") if c in master.columns]
    kept = [c for c in columns if c != "vec" or not coded]
    few_copies = kept_copies(master.select(*columns), k)

    def keep(pivots):
        return written(
            few_copies.mapInArrow(
                _assign(pivots, metric, kept, coded),
                T.StructType([
                    *[master.schema[c] for c in kept], *(codes.FIELDS if coded else []),
                    T.StructField("cell", T.IntegerType()),
                    T.StructField("reach", T.DoubleType())])),
            "cells"), 1 if coded else 4

    pivots, celled, size, reach, block, block_rows = _cells(
        queries, master, rows, k, metric, block_rows, max_pivots, keep)
    fields = [f for f in _query_fields(queries, columns) if f.name != "vec" or not coded]
    routed = written(
        queries.mapInArrow(
            _route(pivots, size, reach, block, k, metric, [f.name for f in fields], coded),
            T.StructType([*fields, *(codes.FIELDS if coded else []),
                          T.StructField("blocks", T.ArrayType(T.IntegerType()))])),
        "routes")
    # At most one row per pivot again.
    visits = routed.select(F.explode("blocks").alias("block")).groupBy("block").agg(
        F.count("*").alias("q_rows")).collect()
    m_rows = np.bincount(block, weights=size, minlength=len(pivots)).astype(int)
    sizes = F.broadcast(spark.createDataFrame(
        [(v["block"], int(m_rows[v["block"]]), v["q_rows"]) for v in visits],
        "block int, m_rows bigint, q_rows bigint"))
    blocks_of = spark.createDataFrame(
        list(enumerate(block.tolist())), "cell int, block int")
    q = routed.select("*", F.explode("blocks").alias("block")).drop("blocks")
    m = celled.drop("reach").join(F.broadcast(blocks_of), "cell").drop("cell")
    if not coded:
        return blocks.nearest_in_blocks(q, m, sizes, k, metric, block_rows)
    groups = -(-routed.select("query_id").count() // MERGED_QUERIES)
    pairs = codes.possible_pairs(q, m, sizes, k, max(1, groups), block_rows)
    return _compared_in_full(pairs, queries, few_copies, metric)


def _cells_in_rounds(queries, master, rows, asked, k, metric, block_rows, max_pivots):
    """As :func:`_join_cells`, ranked, with queries sent to the cells instead of copies of both sides."""
    columns = [c for c in ("customer_id", "vec", "cluster") if c in master.columns]
    kind, width = rounds.kind_of(master), _width(master)
    parts = master.sparkSession.sparkContext.defaultParallelism

    def keep(pivots):
        place = np.argsort(_chain(pivots))
        celled = kept_copies(master.select(*columns), k).mapInArrow(
            _assign(pivots, metric, columns, False, kind, place),
            T.StructType([
                T.StructField("vec", T.BinaryType()) if c == "vec" else master.schema[c] for c in columns] + [
                T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType()),
                T.StructField("place", T.IntegerType())]))
        return written(
            celled.repartitionByRange(parts, "place", F.xxhash64("customer_id")).sortWithinPartitions("place").drop("place"),
            "cells"), 4

    pivots, celled, size, reach, block, _ = _cells(queries, master, rows, k, metric, block_rows, max_pivots, keep)
    fields = _query_fields(queries, columns)
    routed = queries.mapInArrow(
        _route(pivots, size, reach, block, k, metric, [f.name for f in fields], False),
        T.StructType([*fields, T.StructField("blocks", T.ArrayType(T.IntegerType()))]))
    return rounds.in_rounds(
        routed, asked, rounds.round_count(asked, width, k), celled.drop("reach"),
        rounds.scan_blocks(kind, width, block, k, metric), k, False)


def _usual_visits(queries, pivots, size, reach, block, k, metric) -> float:
    """How many blocks a query goes to, on average over a bounded, repeatable choice of them."""
    place = F.xxhash64("query_id")
    some = queries.select("query_id", "vec", *[c for c in ("cluster_size",) if c in queries.columns]).orderBy(
        place, "query_id").limit(SAMPLED_QUERIES).toArrow().combine_chunks()
    routes = _route(pivots, size, reach, block, k, metric, [], False)(some.to_batches())
    return float(np.mean([len(cells) for batch in routes for cells in batch["blocks"]] or [0]))


def _compared_in_full(pairs, queries, master, metric):
    """Pairs of ids with the distance of their vectors, by row.

    Merged: by Spark's estimate of their size, vectors would be sent to every task.
    """
    return (
        pairs.join(master.select("customer_id", F.col("vec").alias("m_vec")).hint("merge"), "customer_id")
        .join(queries.select("query_id", F.col("vec").alias("q_vec")).hint("merge"), "query_id")
        .select("query_id", "customer_id", "q_vec", "m_vec")
        .mapInArrow(blocks.row_distances(metric), blocks.result_schema(queries)))


def _chain(pivots: np.ndarray) -> list[int]:
    """The cells in a chain from each to its nearest that is not in it yet."""
    gaps = blocks.straight_gaps(pivots, pivots)
    left, chain, at = np.ones(len(pivots), bool), [], 0
    for _ in range(len(pivots)):
        chain.append(at)
        left[at] = False
        if left.any():
            at = int(np.where(left, gaps[at], np.inf).argmin())
    return chain


def _packed(pivots, size, block_rows):
    """The block of every cell: small cells close to each other share one.

    Cells are chained, and the chain is cut where a block is full.
    """
    block, filled, n = np.zeros(len(pivots), np.int32), 0, 0
    for at in _chain(pivots):
        if filled and filled + size[at] > block_rows:
            n, filled = n + 1, 0
        block[at] = n
        filled += size[at]
    return block


def _assign(pivots, metric, kept, coded, kind=None, place=None):
    """Each customer's nearest pivot and the distance to it; codes for vectors if ``coded``.

    With ``kind`` vectors are packed, and the ``place`` of the cell is told.
    """
    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = blocks.in_metric_space(blocks.matrix(batch["vec"]), metric)
            gaps = blocks.straight_gaps(x, pivots)
            cell = gaps.argmin(axis=1)
            reach = gaps[np.arange(len(cell)), cell]
            more = dict(zip((f.name for f in codes.FIELDS), codes.coded(x))) if coded else {}
            own = [rounds.packed(blocks.matrix(batch[c]), kind) if kind and c == "vec" else batch[c] for c in kept]
            placed = {"place": pa.array(place[cell], pa.int32())} if kind else {}
            yield pa.RecordBatch.from_arrays(
                [*own, *more.values(), pa.array(cell, pa.int32()), pa.array(reach, pa.float64()), *placed.values()],
                names=[*kept, *more, "cell", "reach", *placed])
    return assign


def _route(pivots, size, reach, block, k, metric, names, coded):
    """Adds the blocks with cells that can hold any of a query's ``k`` nearest.

    Taking cells by their farthest point until they hold ``k`` customers gives a
    distance within which ``k`` customers surely lie; a cell whose nearest point
    is farther than that is not needed.
    """
    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q = blocks.in_metric_space(blocks.matrix(batch["vec"]), metric)
            gaps = blocks.straight_gaps(q, pivots)
            need = np.full(len(q), k, np.int64)
            if "cluster_size" in batch.schema.names:
                need = need + batch["cluster_size"].to_numpy(zero_copy_only=False)
            farthest = gaps + reach
            order = farthest.argsort(axis=1)
            held = np.cumsum(size[order], axis=1)
            enough = held >= need[:, None]
            place = enough.argmax(axis=1)
            rows = np.arange(len(q))
            bound = np.where(
                enough[rows, place], farthest[rows, order[rows, place]], np.inf)
            scale = 1.0 + np.abs(gaps).max(axis=1, initial=0.0)
            visit = (gaps - reach <= (bound + SLACK * scale)[:, None]) & (size > 0)
            cells = [np.unique(block[v]) for v in visit]
            more = dict(zip((f.name for f in codes.FIELDS), codes.coded(q))) if coded else {}
            yield pa.RecordBatch.from_arrays(
                [*[batch[n] for n in names], *more.values(), pa.array(cells, pa.list_(pa.int32()))],
                names=[*names, *more, "blocks"])
    return route


def block_sizes(queries: DataFrame, master: DataFrame) -> DataFrame:
    """Rows per side of every block that both sides have."""
    return (
        master.groupBy("block").agg(F.count("*").alias("m_rows"))
        .join(queries.groupBy("block").agg(F.count("*").alias("q_rows")), "block"))


def signs(tables: int, bits: int, dim: int) -> np.ndarray:
    """+1 or -1 for each dimension (rows), table and bit, from an md5 of their numbers."""
    def sign(t, b, d):
        return 1.0 if hashlib.md5(f"{t}:{b}:{d}".encode()).hexdigest()[0] < "8" else -1.0
    return np.array([[sign(t, b, d) for t in range(tables) for b in range(bits)] for d in range(dim)], float)


def bucket_bits(rows: int, bucket_rows: int) -> int:
    """Bits with which ``rows`` customers give at most about ``bucket_rows`` a bucket."""
    return min(60, math.ceil(math.log2(rows / bucket_rows))) if rows > bucket_rows else 0


def bucket_probes(bits: int) -> int:
    """How many buckets of a table a query visits: more where there are more to choose from."""
    return 1 + bits // 2


def probe_masks(margins: np.ndarray, probes: int) -> np.ndarray:
    """For each row of distances to planes, the ``probes`` cheapest sets of planes to cross, as bit masks.

    A set costs the sum of its squared distances; the first is the empty one. A set of ``c``
    planes costs at least as much as each of its ``2 ** c`` subsets, and a plane as much as each nearer
    one, so only small sets of the nearest planes need to be looked at.
    """
    n, bits = margins.shape
    order = np.argsort(margins ** 2, axis=1, kind="stable")[:, :max(probes - 1, 0)]
    near = order.shape[1]
    sets = [s for c in range(min(near, probes.bit_length() - 1) + 1) for s in itertools.combinations(range(near), c)]
    chosen = np.array([[i in s for s in sets] for i in range(near)], float).reshape(near, len(sets))
    cost = np.round(np.take_along_axis(margins ** 2, order, 1) @ chosen, blocks.TIE_DIGITS)
    mask = (np.int64(1) << order.astype(np.int64)) @ chosen.astype(np.int64)
    return np.take_along_axis(mask, np.lexsort((mask, cost), axis=1)[:, :probes], 1)


def _keyed(side: DataFrame, centre: np.ndarray, tables: int, bits: int, probes: int, kind: str | None = None) -> DataFrame:
    """Each row with the buckets that it visits, table by table, as ``_keys``; with ``kind`` its vector is packed, and its length told."""
    plane = signs(tables, bits, len(centre)).reshape(len(centre), tables * bits)
    columns = [c for c in side.columns if c != "cluster_size"]
    side = side.select(*columns)

    def hashed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = blocks.matrix(batch["vec"])
            margins = np.round((x - centre) @ plane, blocks.TIE_DIGITS)
            margins = margins.reshape(batch.num_rows * tables, bits)
            keys = ((margins >= 0) @ (1 << np.arange(bits, dtype=np.int64)))[:, None]
            if probes > 1:
                keys = keys ^ probe_masks(margins, probes)
            width = tables * keys.shape[1]
            own = [rounds.packed(x, kind) if kind and c == "vec" else batch[c] for c in columns]
            more = {"length": pa.array(np.linalg.norm(x, axis=1))} if kind else {}
            yield pa.RecordBatch.from_arrays(
                [*own, *more.values(), pa.ListArray.from_arrays(
                    pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(keys.ravel()))],
                names=[*columns, *more, "_keys"])

    return side.mapInArrow(hashed, T.StructType([
        *[T.StructField("vec", T.BinaryType()) if kind and f.name == "vec" else f for f in side.schema.fields],
        *([T.StructField("length", T.DoubleType())] if kind else []),
        T.StructField("_keys", T.ArrayType(T.LongType()))]))


def _bucketed(side: DataFrame, centre: np.ndarray, tables: int, bits: int, probes: int = 1) -> DataFrame:
    """Each row once per table and probe, with the bucket as ``block``; the first probe is its own."""
    columns = [c for c in side.columns if c != "cluster_size"]
    return _keyed(side, centre, tables, bits, probes).select(*columns, F.posexplode("_keys").alias("_at", "_key")).select(
        *columns, F.struct(F.floor(F.col("_at") / min(probes, 1 << bits)).cast("int").alias("_table"), "_key").alias("block"))


def _buckets_in_rounds(queries, master, asked, centre, tables, bits, probes, k, metric):
    """Customers in order of their buckets, once a table; the queries are sent to them in rounds."""
    kind, width = rounds.kind_of(master), _width(master)
    columns = [c for c in ("customer_id", "vec", "cluster") if c in master.columns and (c != "cluster" or c in queries.columns)]
    parts = master.sparkSession.sparkContext.defaultParallelism
    buckets = written(
        _keyed(kept_copies(master, k).select(*columns), centre, tables, bits, 1, kind)
        .select(*columns, "length", F.posexplode("_keys").alias("_table", "_key"))
        .repartitionByRange(parts, "_table", "_key", F.xxhash64("customer_id"))
        .sortWithinPartitions("_table", "_key"), "buckets")
    keyed = _keyed(queries.select(*[c for c in ("query_id", *columns[1:])]), centre, tables, bits, probes)
    return rounds.in_rounds(
        keyed, asked, rounds.round_count(asked, width, k), buckets,
        rounds.scan_buckets(kind, width, tables, k, metric), k, True)


def approximate_nearest(
    queries: DataFrame,
    master: DataFrame,
    k: int,
    metric: str = "cosine",
    *,
    dim: int | None = None,
    tables: int = TABLES,
    bucket_rows: int = BUCKET_ROWS,
    probes: int | None = None,
    block_rows: int = blocks.BLOCK_ROWS,
    stored: bool = False,
) -> DataFrame:
    """The ``k`` nearest among the customers in the hash buckets that a query visits; ``stored`` as in :func:`nearest`.

    A bucket is the side of ``bits`` planes on which a vector lies; the planes go
    through the mean of the customers, and the number of bits grows with theirs, so that a
    bucket holds about ``bucket_rows`` whatever the size of the table. Customers stand in one
    bucket of each table; a query visits its own and those across the planes that it lies
    nearest to, in order of the squared distances to be crossed. Distances are exact; a
    neighbour in no visited bucket is missed. Where one bucket holds all, nothing is. Buckets that nobody visits
    are dropped before vectors are shuffled, and a hot one is split like any block. Where the copies
    of both sides would take more than ``COPIED_BYTES``, queries go to the buckets in rounds. ``vec`` is of
    one width on both sides, ``dim`` if given.
    """
    queries, master = _with_vectors(queries, dim), _with_vectors(master, dim)
    if master.isEmpty():
        return blocks.merge_nearest(
            master.sparkSession.createDataFrame([], blocks.result_schema(queries)), k)
    counted = master.select(
        F.count("*").alias("n"), Summarizer.mean(array_to_vector("vec")).alias("mean")).first()
    bits, centre = bucket_bits(counted["n"], bucket_rows), counted["mean"].toArray()
    tables = tables if bits else 1
    probes = bucket_probes(bits) if probes is None else probes
    asked = queries.select("query_id").count()
    if (asked * probes + counted["n"]) * tables * _width(master) > COPIED_BYTES:
        return _buckets_in_rounds(queries, master, asked, centre, tables, bits, probes, k, metric)
    q = _bucketed(queries, centre, tables, bits, probes)
    m = _bucketed(kept_copies(master, k), centre, tables, bits)
    partial = blocks.lists_in_blocks(q, m, block_sizes(q, m), k, metric, block_rows)
    listed = asked * tables * probes * min(k, max(bucket_rows, 1))
    found = blocks.merge_lists(partial, k, max(1, -(-listed // rounds.LISTED)))
    return written(found, "nearest") if stored else found
