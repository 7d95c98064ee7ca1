"""A bounded number of pairs: no vectors are made, sent or compared beyond what these need."""

import numpy as np
import pyarrow as pa

from likeness.functions.encode import hashed_trigrams
from likeness.operators import blocks
from likeness.plans.pairs import pair_source


def test_steps_without_vectors_encode_none(spark):
    rows = [(1, "name:a", [1.0, 0.0]), (2, "name:b", [1.0]), (3, "name:b", None)]
    master = spark.createDataFrame(rows, "customer_id long, identity_text string, identity_vec array<float>")
    table = pair_source(master, dim=2)
    assert {(r.customer_id, len(r.identity_vec)) for r in table.collect()} == {(1, 2), (3, 2)}
    narrow = table.select("customer_id", "identity_text")
    assert {r.customer_id for r in narrow.collect()} == {1, 3}
    assert "ArrowEvalPython" not in narrow._jdf.queryExecution().executedPlan().toString()


def test_masked_texts_give_no_vector():
    found = hashed_trigrams(8, nulls=True).func(pa.array([None, "abcd", None])).to_pylist()
    assert found[0] is found[2] is None
    assert found[1] == hashed_trigrams(8).func(pa.array(["abcd"])).to_pylist()[0]
    assert hashed_trigrams(8, nulls=True).func(pa.array([None], pa.string())).to_pylist() == [None]


def test_nearest_so_far_equals_the_plain_comparison():
    rng = np.random.default_rng(3)
    for trial in range(60):
        k, scale = int(rng.integers(1, 5)), 10.0 ** rng.choice([-30, -4, 0, 6, 20])
        q, m = (rng.integers(-2, 3, (n, 3)) * scale for n in (9, 60))
        ids, own, other = rng.permutation(60), rng.integers(0, 4, 9), rng.integers(0, 4, 60)
        near = blocks.NearestSoFar(q, k)
        for s in range(0, 60, 7):
            near.see(own, m[s:s + 7], ids[s:s + 7], other[s:s + 7])
        rows, found, gaps = blocks.nearest_in_block(q, own, m, ids, other, k, "euclidean")
        keep = blocks._first_k(rows, (np.round(gaps, blocks.TIE_DIGITS), found), k)
        for a, b in zip(near.best, (rows[keep], found[keep], gaps[keep])):
            assert np.array_equal(a, b)


def test_a_batch_of_one_file_is_encoded_by_all_cores(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from likeness.plans import ingest as plan

    tasks, kept = [], plan.written
    monkeypatch.setattr(plan, "written", lambda df, name: (tasks.append(df.rdd.getNumPartitions()), kept(df, name))[1])
    people = spark.range(40).select(F.col("id").alias("place"), F.concat(F.lit("Asha "), F.col("id").cast("string")).alias("full_name"))
    for column in ("dob", "phone", "email", "gov_id", "addr_line", "city", "state", "postal_code", "country"):
        people = people.withColumn(column, F.lit("").cast("string"))
    loaded, rejects = plan.ingest(
        people.coalesce(1), str(tmp_path / "master"), "one", F.to_timestamp(F.lit("2024-01-30")), order=["place"])
    assert tasks == [spark.sparkContext.defaultParallelism]
    assert [(r.customer_id, r.full_name) for r in loaded.orderBy("customer_id").collect()] == [
        (i + 1, f"Asha {i}") for i in range(40)]
    assert not rejects.count()
