"""Vectors as one byte a coordinate, with a bound on what the bytes leave out.

The distance of two codes differs from that of their vectors by no more than the sum of
both residuals. So codes tell which customers can be among the nearest of a query, at a
quarter of the bytes of floats, and only these have to be compared in full.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.operators import blocks

FIELDS = [T.StructField("code", T.BinaryType()), T.StructField("scale", T.DoubleType()),
          T.StructField("residual", T.DoubleType())]
LEVELS = 127

# Room for rounding in distances of codes, relative to the largest.
SLACK = 1e-6

# Queries and customers whose distances are computed at a time.
TILE_ROWS = 256
CHUNK_ROWS = 2048
MOST = np.finfo(np.float64).max


def coded(x: np.ndarray) -> list[pa.Array]:
    """Code, scale and residual of each row of vectors in the metric's space."""
    top = np.abs(x).max(axis=1, initial=0.0)
    scale = np.where(top > 0, top / LEVELS, 1.0)
    code = np.rint(x / scale[:, None]).astype(np.int8)
    residual = np.linalg.norm(x - code * scale[:, None], axis=1)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(code.tobytes())])
    return [packed, pa.array(scale), pa.array(residual)]


class Codes:
    """The codes of one side of a block."""

    def __init__(self, table: pa.Table):
        column = table["code"].combine_chunks()
        width = len(column[0].as_py()) if len(column) else 0
        flat = np.frombuffer(b"".join(column.to_pylist()), np.int8)
        # Sums of up to 1,040 products of bytes are whole numbers that floats hold exactly.
        self.kind = np.float32 if width * LEVELS ** 2 < 1 << 24 else np.float64
        self.code = flat.reshape(len(column), width).astype(self.kind)
        self.scale = table["scale"].to_numpy()
        self.residual = table["residual"].to_numpy()
        self.square = self.scale ** 2 * np.einsum("ij,ij->i", self.code, self.code, dtype=np.float64)


def _possible(q: Codes, m: Codes, tile: slice, clusters, k: int):
    """Pairs that can be among a query's ``k`` nearest of a block, with least and greatest distance.

    The customers are taken some at a time, so that a task holds few distances at once.
    Those of any ``k`` bound the distance of the ``k`` nearest of all. ``clusters``, if any, are
    numbers of both sides' own clusters, whose pairs are left out.
    """
    found, bound = [], None
    for start in range(0, len(m.scale), CHUNK_ROWS):
        part = slice(start, start + CHUNK_ROWS)
        gaps = (q.code[tile] @ m.code[part].T).astype(np.float64)
        gaps *= -2.0 * q.scale[tile, None]
        gaps *= m.scale[part]
        gaps += q.square[tile, None]
        gaps += m.square[part]
        np.sqrt(np.maximum(gaps, 0.0, out=gaps), out=gaps)
        slack = SLACK * (1.0 + gaps.max(initial=0.0))
        if clusters is not None:
            gaps[clusters[0][tile, None] == clusters[1][part]] = np.inf
        own = q.residual[tile, None] + slack
        most = gaps + m.residual[part]
        if most.shape[1] >= k:
            near = (most.min(axis=1) if k == 1 else np.partition(most, k - 1, axis=1)[:, k - 1])[:, None] + own
            bound = near if bound is None else np.minimum(bound, near)
        gaps -= m.residual[part]
        # Pairs of one cluster are infinitely far.
        can = np.isfinite(gaps) if bound is None else (gaps <= np.minimum(bound + own, MOST))
        rows, cols = np.nonzero(can)
        error = own[rows, 0]
        found.append((rows, cols + start, gaps[rows, cols] - error, most[rows, cols] + error))
    rows, cols, least, most = (np.concatenate(p) for p in zip(*found))
    if bound is not None:
        keep = least <= bound[rows, 0]
        rows, cols, least, most = rows[keep], cols[keep], least[keep], most[keep]
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order], least[order], most[order]


def _task(k: int):
    def work(q: pa.Table, m: pa.Table) -> pa.Table:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))]
        if q.num_rows and m.num_rows:
            clusters = blocks._cluster_codes(q, m) if "cluster" in q.column_names else None
            q_codes, m_codes, ids = Codes(q), Codes(m), m["customer_id"].to_numpy()
            for start in range(0, q.num_rows, TILE_ROWS):
                tile = slice(start, start + TILE_ROWS)
                rows, cols, least, most = _possible(q_codes, m_codes, tile, clusters, k)
                found.append((rows + start, ids[cols], least, most))
        rows, ids, least, most = (np.concatenate(p) for p in zip(*found))
        asked = np.unique(rows)
        bounds = pa.array(np.searchsorted(rows, np.r_[asked, q.num_rows]), pa.int32())
        return pa.table({
            "query_id": q["query_id"].take(pa.array(asked)),
            **{n: pa.ListArray.from_arrays(bounds, pa.array(v)) for n, v in (
                ("ids", ids), ("least", least), ("most", most))}})
    return work


def _merged(k: int):
    """Of all blocks' pairs of each query, those that can still be among its ``k`` nearest."""
    def work(table: pa.Table) -> pa.Table:
        query = table["query_id"].combine_chunks().dictionary_encode()
        lists = table["ids"].combine_chunks()
        row = np.repeat(query.indices.to_numpy(), np.diff(lists.offsets.to_numpy()))
        ids, least, most = (table[n].combine_chunks().flatten().to_numpy() for n in ("ids", "least", "most"))
        order = np.lexsort((most, row))
        place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        bound = np.full(len(query.dictionary), np.inf)
        at = order[place == k - 1]
        bound[row[at]] = most[at]
        keep = least <= bound[row]
        return pa.table({"query_id": query.dictionary.take(pa.array(row[keep])), "customer_id": pa.array(ids[keep], pa.int64())})
    return work


def possible_pairs(
    queries: DataFrame, master: DataFrame, sizes: DataFrame, k: int, groups: int, block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """(query_id, customer_id) of all that can be among a query's ``k`` nearest over its blocks.

    Both sides carry ``block`` and the fields of a code. No block may hold a pair twice.
    """
    kind = queries.schema["query_id"]
    q, m = blocks.split_in_blocks(queries, master, sizes, block_rows)
    numbers = T.ArrayType(T.DoubleType())
    listed = q.cogroup(m).applyInArrow(_task(k), T.StructType([
        kind, T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("least", numbers), T.StructField("most", numbers)]))
    return listed.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups))).applyInArrow(
        _merged(k), T.StructType([kind, T.StructField("customer_id", T.LongType())]))
