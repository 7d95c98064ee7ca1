"""What Spark makes of the expressions and jobs."""

from datetime import date

import pytest
from pyspark.sql import functions as F

import querybook
from likeness.plans.stats import created_on_day, stats
from likeness.sources.master import MASTER, scan_customers
from querybook.scalars import person_pairs, with_features

SF = "/root/testdata/sf0.001"

JVM_ONLY = [
    name for name in querybook.QUERIES
    if name.startswith(("p1_", "p2_", "p3_", "p4_", "p5_", "p6_", "p7_", "p16_", "f6_", "f7_",
                        "f8_", "f9_", "f10_", "f11_", "f12_", "f13_", "x2_", "x3_", "x4_",
                        "x5_", "x6_", "m1_hashed_vector", "m2_", "m3_", "m5_", "m6_", "a3_",
                        "a7_", "f2_", "j3_", "w3_", "w5_", "j7_", "j8_"))
    and not name.endswith("_batched")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_in_the_plan(spark, name):
    text = plan(querybook.QUERIES[name](spark, SF))
    assert "Python" not in text and "InPandas" not in text and "InArrow" not in text


@pytest.mark.parametrize("name", [
    "a7_identity_clusters", "e1_check_by_keys", "e1_check_exact", "e1_duplicate_check", "e3_labelled_pairs",
    "e5_stats_report", "e6_loan_check", "j1_topk_exact_cells", "j3_document_copies", "j4_hard_negative",
    "j5_hot_keys", "j5_shared_keys", "j6_approximate_nearest", "m10_training_features", "p10_public_names"])
def test_no_cross_joins_anywhere(spark, name):
    text = plan(querybook.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.fixture()
def stored(spark, tmp_path):
    path = str(tmp_path / "master")
    row = {"customer_id": 1, "batch_id": "a", "created_on": date(2024, 1, 30)}
    row = [tuple(row.get(n) for n in MASTER.names)]
    spark.createDataFrame(row, MASTER).write.partitionBy("batch_id", "created_on").parquet(path)
    return spark.read.schema(MASTER).parquet(path)


def test_the_day_filter_prunes_partitions(spark, stored):
    text = plan(created_on_day(stored, F.to_date(F.lit("2024-01-30"))))
    assert "PartitionFilters: [isnotnull(created_on" in text


def test_stats_read_one_column_and_shuffle_ids_once(spark, stored):
    text = plan(stats(stored, F.to_date(F.lit("2024-01-30"))))
    assert "ReadSchema: struct<gov_id_norm:string>" in text
    assert text.count("Exchange hashpartitioning") == 1


def test_the_master_scan_leaves_the_vector(spark, stored):
    assert "identity_vec" not in plan(scan_customers(stored)).split("ReadSchema")[1]


def test_ranks_are_filtered_before_the_shuffle(spark):
    text = plan(querybook.QUERIES["w2_ranked_candidates"](spark, SF))
    assert "Window [row_number()" in text
    text = plan(querybook.QUERIES["p10_public_names"](spark, SF))
    assert "WindowGroupLimit" in text


def test_texts_are_folded_before_pairing_only(spark):
    text = plan(with_features(person_pairs(spark, SF), batched=True))
    assert text.count("ArrowEvalPython") <= 3


def broadcast_columns(df):
    """What each broadcast of the plan sends to every task."""
    lines = plan(df).splitlines()
    return [lines[i + 1] for i, line in enumerate(lines) if "BroadcastExchange" in line]


def test_rows_with_vectors_are_not_broadcast_to_their_block_sizes(spark):
    from likeness.operators import blocks, neighbours
    rows = spark.range(64).select(
        F.col("id").alias("customer_id"), F.array(F.lit(1.0).cast("float")).alias("vec"), (F.col("id") % 4).alias("block"))
    asked = rows.withColumnRenamed("customer_id", "query_id")
    for most in (blocks.BROADCAST_BLOCKS, 3):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(blocks, "BROADCAST_BLOCKS", most)
            sizes = neighbours.block_sizes(asked, rows)
            found = blocks.lists_in_blocks(asked, rows, sizes, 2, "cosine")
        assert not any("vec" in sent for sent in broadcast_columns(found))
        assert found.count() == 64


def test_vectors_of_pairs_are_not_broadcast(spark):
    assert not broadcast_columns(with_features(person_pairs(spark, SF)))
    master = person_pairs(spark, SF).select("customer_id", "identity_vec")
    pairs = master.select("customer_id", F.col("customer_id").alias("query_id"))
    from likeness.plans.check import with_distances
    assert not broadcast_columns(with_distances(
        pairs, master.withColumnRenamed("customer_id", "query_id"), master))


@pytest.mark.parametrize("name", ["m1_hashed_vector", "m1_hashed_vector_batched"])
def test_no_vector_is_computed_where_the_table_is_read(spark, name):
    text = querybook.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter ((size(" not in text and "Filter (size(" not in text
