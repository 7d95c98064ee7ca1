"""Similarity joins against brute force, copies and hot keys included."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from likeness.operators.clusters import duplicate_pairs, duplicates_only
from likeness.operators import blocks, codes, neighbours
from likeness.operators.keys import KEYS, hot_keys, shared_key_pairs
from likeness.operators.neighbours import approximate_nearest, nearest
from likeness.plans.pairs import hard_negatives

SCHEMA = "{id} {type}, vec array<float>"


def side(spark, vecs, name, ids=None, kind="bigint"):
    ids = range(len(vecs)) if ids is None else ids
    return spark.createDataFrame(
        [(i, v.tolist()) for i, v in zip(ids, vecs)], SCHEMA.format(id=name, type=kind))


def brute(q, m, k, metric, clusters=None):
    q, m = q.astype("f4").astype(float), m.astype("f4").astype(float)
    out = {}
    for i, x in enumerate(q):
        if metric == "euclidean":
            gaps = np.linalg.norm(m - x, axis=1)
        else:
            nx, nm = np.linalg.norm(x), np.linalg.norm(m, axis=1)
            with np.errstate(all="ignore"):
                gaps = np.maximum(1 - m @ x / (nx * nm), 0)
            gaps = np.where(nx * nm > 0, gaps, np.where(nx + nm > 0, 1.0, 0.0))
        allowed = [j for j in range(len(m)) if clusters is None or clusters[0][i] != clusters[1][j]]
        order = sorted(allowed, key=lambda j: (round(gaps[j], 9), j))[:k]
        out[i] = [(j, round(gaps[j], 6)) for j in order]
    return out


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.customer_id, round(r.vdist, 6)))
    return out


def data(seed=0, n=700, queries=90, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim)) * 3
    m = centres[rng.integers(9, size=n)] + rng.normal(size=(n, dim)) * 0.4
    m[: n // 3] = m[0]          # a third of all rows are copies of one
    m[n // 3] = 0
    q = np.vstack([m[rng.integers(n, size=queries - 3)] + 0.05, m[:1], m[n // 3: n // 3 + 1] * 0, centres[:1]])
    return q, m


FORMS = {
    "scan": {},
    "cells": {"broadcast_rows": 0, "block_rows": 64},
    "one block": {"broadcast_rows": 0},
    "tiny blocks": {"broadcast_rows": 0, "block_rows": 20, "max_pivots": 5},
}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("form", FORMS)
def test_nearest_is_exact(spark, metric, form):
    q, m = data()
    got = nearest(side(spark, q, "query_id"), side(spark, m, "customer_id"), 7, metric, **FORMS[form])
    assert ranked(got) == brute(q, m, 7, metric)


@pytest.mark.parametrize("form", ["scan", "cells"])
def test_own_cluster_is_left_out(spark, form):
    q, m = data(1)
    rng = np.random.default_rng(2)
    mc = rng.integers(4, size=len(m))
    qc = rng.integers(4, size=len(q))
    sizes = np.bincount(mc, minlength=4)
    qs = spark.createDataFrame(
        [(i, v.tolist(), f"c{c}", int(sizes[c])) for i, (v, c) in enumerate(zip(q, qc))],
        "query_id bigint, vec array<float>, cluster string, cluster_size bigint")
    ms = spark.createDataFrame(
        [(i, v.tolist(), f"c{c}") for i, (v, c) in enumerate(zip(m, mc))],
        "customer_id bigint, vec array<float>, cluster string")
    got = nearest(qs, ms, 3, "euclidean", **FORMS[form])
    assert ranked(got) == brute(q, m, 3, "euclidean", (qc, mc))


def test_text_ids_missing_vectors_and_empty_sides(spark):
    q, m = data(3, n=60, queries=6)
    names = [f"q{i}" for i in range(len(q))]
    qs = side(spark, q, "query_id", names, "string").union(
        spark.createDataFrame([("none", None)], "query_id string, vec array<float>"))
    ms = side(spark, m, "customer_id")
    for form in ("scan", "cells"):
        got = ranked(nearest(qs, ms, 2, **FORMS[form]))
        assert got == {f"q{i}": v for i, v in brute(q, m, 2, "cosine").items()}
        assert nearest(qs, ms.limit(0), 2, **FORMS[form]).count() == 0
        assert nearest(qs.limit(0), ms, 2, **FORMS[form]).count() == 0


def identities(n, dim=512, seed=4):
    """Sparse unit vectors as identity texts give them, every third a slight variant."""
    rng = np.random.default_rng(seed)
    common = np.zeros(dim)
    common[rng.integers(dim, size=60)] = 1
    rows = []
    for i in range(n):
        if i % 3 == 2:
            v = rows[-1].copy()
            v[rng.integers(dim, size=4)] += 1
        else:
            v = common.copy()
            np.add.at(v, rng.integers(dim, size=70), 1)
        rows.append(v)
    m = np.array(rows)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_hashed_search_recall_at_the_defaults(spark):
    m = identities(1500)
    q = m[2:600:3]  # each a variant of the row before it
    got = ranked(approximate_nearest(side(spark, q, "query_id"), side(spark, m, "customer_id"), 2))
    exact = brute(q, m, 2, "cosine")
    hits = sum(len(set(got.get(i, [])) & set(v)) for i, v in exact.items())
    assert hits / sum(map(len, exact.values())) > 0.9
    # Distances of what is found are exact, and in order.
    for i, found in got.items():
        assert found[0] == exact[i][0]


def test_hashed_buckets_stay_small(spark):
    for n in (500, 4000):
        m = side(spark, identities(n), "customer_id")
        bits = neighbours.bucket_bits(n, neighbours.BUCKET_ROWS)
        centre = identities(n).mean(axis=0)
        sizes = [r["count"] for r in neighbours._bucketed(m, centre, 4, bits).groupBy("block").count().collect()]
        assert sum(sizes) == 4 * n and sum(s * s for s in sizes) / (4 * n) < 6 * neighbours.BUCKET_ROWS


@pytest.mark.parametrize("n", [1, 2, 64, 128, 129])
def test_hashed_search_of_small_tables_misses_nothing(spark, n):
    assert neighbours.bucket_bits(n, 128) == (n > 128)
    m = identities(n)
    if n <= 128:
        got = ranked(approximate_nearest(side(spark, m, "query_id"), side(spark, m, "customer_id"), 3))
        assert got == brute(m, m, 3, "cosine")


def test_probes_are_the_cheapest_sets_of_planes():
    rng = np.random.default_rng(8)
    for bits in (1, 2, 5, 9):
        margins = rng.normal(size=(40, bits))
        for probes in (1, 2, 3, 4, 8, 13):
            got = neighbours.probe_masks(margins, probes)
            for row, masks in zip(margins, got):
                cost = lambda mask: round(sum(x * x for i, x in enumerate(row) if mask >> i & 1), 9)
                assert masks.tolist() == sorted(range(1 << bits), key=lambda mask: (cost(mask), mask))[:probes]


def test_more_probes_find_more(spark):
    m = identities(1500, seed=9)
    sides = side(spark, m[:300], "query_id"), side(spark, m, "customer_id")
    exact = brute(m[:300], m, 3, "cosine")
    hits = []
    for probes in (1, 3, 6):
        got = ranked(approximate_nearest(*sides, 3, tables=2, bucket_rows=32, probes=probes))
        hits.append(sum(len(set(got.get(i, [])) & set(v)) for i, v in exact.items()))
    assert hits[0] < hits[1] < hits[2]


def test_codes_bound_distances_and_spare_full_ones(spark):
    m = identities(1500)
    m[7] = 0
    x = blocks.in_metric_space(m, "cosine")
    fields = dict(zip(("code", "scale", "residual"), codes.coded(x)))
    side_of = codes.Codes(pa.table(fields))
    rows, cols, least, most = codes._possible(side_of, side_of, slice(0, 300), None, 1500)
    exact = np.linalg.norm(x[:300, None] - x[None], axis=2)[rows, cols]
    assert len(rows) == 300 * 1500 and (least <= exact).all() and (exact <= most).all()
    # All pairs of one block: what the bounds leave is far below a twentieth of them.
    table = pa.table({"customer_id": np.arange(1500), "query_id": np.arange(1500), **fields})
    listed = codes._task(2)(table, table)
    assert len(codes._merged(2)(listed)) < 0.05 * 1500 ** 2


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_coded_and_full_cells_agree(spark, metric, monkeypatch):
    q, m = identities(300, seed=11), identities(900, seed=11)
    sides = side(spark, q, "query_id"), side(spark, m, "customer_id")
    found = ranked(nearest(*sides, 5, metric, broadcast_rows=0, block_rows=128))
    monkeypatch.setattr(neighbours, "CODED_K", 0)
    assert found == ranked(nearest(*sides, 5, metric, broadcast_rows=0, block_rows=128)) == brute(q, m, 5, metric)


def test_the_cell_form_refuses_too_many_pairs(spark):
    q, m = data(4, n=50, queries=10)
    sides = side(spark, q, "query_id"), side(spark, m, "customer_id")
    with pytest.raises(ValueError, match="max_compared"):
        nearest(*sides, 2, broadcast_rows=0, max_compared=499)
    assert nearest(*sides, 2, broadcast_rows=0, max_compared=None).count() == 20


def test_both_forms_skip_other_widths_and_unknown_clusters(spark):
    q, m = data(5, n=60, queries=8)
    odd = spark.createDataFrame([(900, [1.0, 2.0]), (901, None)], "query_id bigint, vec array<float>")
    qs = side(spark, q, "query_id").union(odd).withColumn("cluster", F.lit("x")).withColumn("cluster_size", F.lit(1))
    ms = side(spark, m, "customer_id").union(odd.withColumnRenamed("query_id", "customer_id"))
    forms = [ranked(nearest(qs, ms, 3, dim=12, **FORMS[f])) for f in ("scan", "cells")]
    assert forms[0] == forms[1] == brute(q, m, 3, "cosine")


def test_vectors_of_mixed_width_are_refused_not_reshaped():
    import pyarrow as pa

    from likeness.operators.blocks import matrix
    with pytest.raises(ValueError, match="different widths"):
        matrix(pa.array([[1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0, 5.0]]))
    assert matrix(pa.array([[1.0], [2.0]]).slice(1)).tolist() == [[2.0]]


def keyed_rows(spark, n, hot):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        phone = "+91000" if i < hot else f"+91{int(rng.integers(n // 2))}"
        email = "" if i % 4 == 0 else f"m{int(rng.integers(n))}@x.io"
        gov = "" if i % 3 == 0 else f"G{int(rng.integers(n))}"
        rows.append((i, phone, email, gov, rng.normal(size=6).tolist()))
    schema = "customer_id bigint, phone_e164 string, email_norm string, gov_id_norm string, vec array<float>"
    return rows, spark.createDataFrame(rows, schema)


def test_shared_keys_are_never_cut(spark):
    rows, master = keyed_rows(spark, 240, hot=80)
    queries = master.withColumnRenamed("customer_id", "query_id")
    holders = {}
    for r in rows:
        for c, key in enumerate(r[1:4]):
            if key:
                holders.setdefault((c, key), set()).add(r[0])
    for limit in (None, 10):
        hot = None if limit is None else hot_keys(queries, master, limit)
        got = {}
        for r in shared_key_pairs(queries, master, hot).collect():
            got.setdefault(r.query_id, set()).add(r.customer_id)
        if hot is not None:
            assert {(r.block, r.m_rows, r.q_rows) for r in hot.collect()} == {
                (f"{list(KEYS)[c]}:{k}", len(v), len(v)) for (c, k), v in holders.items() if len(v) > limit}
        for r in rows:
            sets = [holders[c, k] for c, k in enumerate(r[1:4]) if k]
            listed = [s for s in sets if limit is None or len(s) <= limit]
            assert got.get(r[0], set()) == set().union(*listed)


@pytest.mark.parametrize("part_rows", [10_000, 40])
def test_duplicate_pairs_in_a_hot_group(spark, part_rows):
    ids = spark.range(1200).withColumnRenamed("id", "customer_id").withColumn(
        "identity_text", F.when(F.col("customer_id") < 400, "hot").otherwise(
            (F.col("customer_id") % 300).cast("string")))
    pairs = duplicate_pairs(duplicates_only(ids), 5, part_rows=part_rows).collect()
    text = {r.customer_id: r.identity_text for r in ids.collect()}
    size = {}
    for t in text.values():
        size[t] = size.get(t, 0) + 1
    partners = {}
    for p in pairs:
        assert p.customer_id != p.cand_customer_id
        assert text[p.customer_id] == text[p.cand_customer_id]
        partners.setdefault(p.customer_id, []).append(p.cand_customer_id)
    for c, t in text.items():
        found = partners.get(c, [])
        assert len(set(found)) == len(found) == min(5, size[t] - 1)


def test_arcs_make_the_pairs_of_the_whole_ring(spark):
    ids = spark.range(50_300).select(F.col("id").alias("customer_id"), F.when(
        F.col("id") < 50_000, "hot").otherwise((F.col("id") % 100).cast("string")).alias("identity_text"))
    members = duplicates_only(ids)
    runs = [{tuple(r) for r in duplicate_pairs(members, 3, part_rows=n).select(
        "customer_id", "cand_customer_id").collect()} for n in (100_000, 10_000, 7)]
    assert len(runs[0]) == 3 * 50_000 + 100 * 3 * 2 and runs[0] == runs[1] == runs[2]


def test_duplicate_pairs_depend_on_the_seed_only(spark):
    ids = spark.range(50).select(F.col("id").alias("customer_id"), F.lit("t").alias("identity_text"))
    run = lambda seed: {tuple(r) for r in duplicate_pairs(
        duplicates_only(ids), 2, seed=seed).select("customer_id", "cand_customer_id").collect()}
    assert run("a") == run("a") != run("b")


def test_limited_depth_of_hard_negatives(spark):
    rows = [(1, "a", [0.0, 1.0]), (2, "a", [0.0, 1.1]), (3, "b", [0.0, 3.0]), (4, "c", [9.0, 9.0])]
    table = spark.createDataFrame(rows, "customer_id bigint, identity_text string, identity_vec array<float>")
    members = duplicates_only(table)
    found = lambda **o: {tuple(r) for r in hard_negatives(members, table, **o).collect()}
    assert found() == {(1, 3), (2, 3)}
    assert found(depth=3) == {(1, 3), (2, 3)}
    assert found(depth=2) == set()


def test_keys_cover_the_indexed_columns():
    assert set(KEYS.values()) == {"phone_e164", "email_norm", "gov_id_norm"}


@pytest.mark.parametrize("k", [3, 40])
def test_blocks_grow_where_queries_go_to_all_of_them(spark, k, monkeypatch):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(1200, 16)).astype("f4")
    sides = side(spark, m[:200], "query_id"), side(spark, m, "customer_id")
    seen, packed = [], neighbours._packed
    monkeypatch.setattr(neighbours, "_packed", lambda p, s, rows: seen.append(rows) or packed(p, s, rows))
    monkeypatch.setattr(neighbours, "MAX_VISITS", 4)
    found = ranked(nearest(*sides, k, "euclidean", broadcast_rows=0, block_rows=32))
    assert seen[0] == 32 and seen[1] >= 8 * 32
    assert found == brute(m[:200], m, k, "euclidean")


def test_codes_in_chunks_leave_what_codes_at_once_leave(monkeypatch):
    x = blocks.in_metric_space(identities(700, seed=4), "cosine")
    side_of = codes.Codes(pa.table(dict(zip(("code", "scale", "residual"), codes.coded(x)))))
    own = np.arange(700) // 2
    exact = np.linalg.norm(x[:50, None] - x[None], axis=2)
    exact[own[:50, None] == own] = np.inf
    for chunk in (16, 700):
        monkeypatch.setattr(codes, "CHUNK_ROWS", chunk)
        rows, cols, least, most = codes._possible(side_of, side_of, slice(0, 50), (own, own), 5)
        assert (np.diff(rows) >= 0).all() and np.isfinite(most).all()
        left = set(zip(rows.tolist(), cols.tolist()))
        near = np.argsort(exact, axis=1, kind="stable")[:, :5]
        assert all((i, j) in left for i in range(50) for j in near[i].tolist())


def test_small_blocks_share_groups_and_large_ones_do_not(spark):
    rows = spark.range(3100).select(F.col("id").alias("customer_id"), F.when(
        F.col("id") < 100, "big").otherwise(F.concat(F.lit("k"), (F.col("id") / 3).cast("int"))).alias("block"))
    asked = rows.withColumnRenamed("customer_id", "query_id")
    sizes = neighbours.block_sizes(asked, rows)
    q, m = blocks.split_in_blocks(asked, rows, sizes, 256, 64)
    groups = q.cogroup(m).applyInArrow(lambda a, b: pa.table({
        "blocks": [len(set(b["block"].to_pylist()))], "same": [
            set(a["block"].to_pylist()) == set(b["block"].to_pylist())], "big": ["big" in b["block"].to_pylist()],
        "rows": [b.num_rows]}), "blocks bigint, same boolean, big boolean, rows bigint").collect()
    assert len(groups) < 20 and all(g["same"] for g in groups)
    assert [(g["blocks"], g["rows"]) for g in groups if g["big"]] == [(1, 100)]
    assert sum(g["rows"] for g in groups) == 3100
