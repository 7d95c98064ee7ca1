"""Masters compacted and read by key, and tables kept as merged runs."""

import os

import pytest
from pyspark.sql import functions as F

from likeness.operators.clusters import add_to_clusters, identity_clusters, kept_clusters
from likeness.plans.check import check_duplicates
from likeness.plans.ingest import ingest
from likeness.plans.stats import customers_per_day
from likeness.sources import master as m
from likeness.sources.master import compact, drop_superseded, read_keys, read_master
from likeness.sources.runs import append_run, drop_merged, read_runs, runs
from likeness.streaming.jobs import check_batch, correct, latest, upsert_batch
from test_jobs import master_of, now, raw


def many_batches(spark, path, n, per=2):
    """A master of ``n`` small batches on two days, as streams leave it; without keys."""
    rows = master_of(spark, *[{"full_name": f"N{i}", "gov_id": f"G{i}", "phone": "", "email": ""} for i in range(n * per)])
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("customer_id") % 2).cast("int"))
    rows.withColumn("created_at", day.cast("timestamp")).withColumn("created_on", day).withColumn(
        "batch_id", F.format_string("stream-s-%012d", F.expr(f"customer_id div {per}"))).select(*m.MASTER.names).write.partitionBy(
            "batch_id", "created_on").parquet(path)


def content(df):
    return sorted((r.customer_id, r.full_name, str(r.created_on), r.batch_id) for r in df.collect())


def data_files(folder):
    return {d: [f for f in os.listdir(f"{folder}/{d}") if f.endswith(".parquet")]
            for d in os.listdir(folder) if d.startswith("created_on=")}


def test_many_batches_fold_into_few_files_a_day(spark, tmp_path):
    path = str(tmp_path / "master")
    many_batches(spark, path, 150)
    before = content(read_master(spark, path))
    keys = sorted(read_keys(spark, path).collect())
    # A compaction that was broken off has no list of batches, and no reader.
    read_master(spark, path).limit(3).drop("batch_id").write.partitionBy("created_on").parquet(
        f"{path}/_compacted/gen=00000000/rows")
    assert content(read_master(spark, path)) == before
    folder = compact(spark, path)
    files = data_files(f"{folder}/rows")
    assert set(files) == {"created_on=2024-01-01", "created_on=2024-01-02"}
    assert all(1 <= len(f) <= 2 for f in files.values())
    assert content(read_master(spark, path)) == before
    assert sorted(read_keys(spark, path).collect()) == keys and len(keys) == 300
    day = read_master(spark, path).filter("created_on = DATE '2024-01-02'")
    assert "PartitionFilters: [isnotnull(created_on" in day._jdf.queryExecution().toString()
    assert day.count() == 150
    assert len(drop_superseded(spark, path)) == 301 and not [f for f in os.listdir(path) if f.startswith("batch_id")]
    assert content(read_master(spark, path)) == before and compact(spark, path) == folder


def test_batches_go_on_and_are_replaced_after_a_compaction(spark, tmp_path):
    path = str(tmp_path / "master")
    first = raw(spark, *[{"full_name": f"A{i}"} for i in range(5)])
    second = raw(spark, *[{"full_name": f"B{i}"} for i in range(4)])
    ingest(first, path, "b1", now(), writer="w", order=["full_name"])
    ingest(second, path, "b2", now(), writer="w", order=["full_name"])
    compact(spark, path)
    before = content(read_master(spark, path))
    # Replays, before and after the old folder is gone.
    for _ in range(2):
        ingest(second, path, "b2", now(), writer="w", order=["full_name"])
        assert content(read_master(spark, path)) == before
        drop_superseded(spark, path)
    with pytest.raises(ValueError, match="name the stream anew"):
        ingest(second, path, "b1", now(), writer="v", order=["full_name"])
    ingest(raw(spark, {"full_name": "C", "gov_id": "NEW"}), path, "b3", now(), writer="w", order=["full_name"])
    assert content(read_master(spark, path))[:9] == before
    assert [r.customer_id for r in read_master(spark, path).filter("batch_id = 'b3'").collect()] == [10]
    compact(spark, path)
    drop_superseded(spark, path)
    assert len(content(read_master(spark, path))) == 10
    assert read_keys(spark, path).filter("block = 'gov_id:NEW'").first().customer_id == 10
    assert read_keys(spark, path).count() == 30


def rows_read(df):
    """Rows that the scans of a plan without shuffles gave out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.mark.parametrize("asked", [10, 40])
def test_few_keys_read_few_row_groups(spark, tmp_path, asked):
    folder = str(tmp_path / "keys")
    rows = spark.range(400_000).select(
        F.concat(F.lit("gov_id:"), F.sha1(F.col("id").cast("string"))).alias("block"),
        F.col("id").alias("customer_id"))
    m.write_keys(rows, folder, group_bytes=64 << 10)
    keys = spark.read.parquet(folder)
    wanted = rows.filter(F.col("id") % (400_000 // asked) == 7).select("block")
    found = m.among(keys, "block", wanted)
    assert rows_read(found) < 0.25 * 400_000
    assert found.count() == asked
    assert m.among(keys, "block", wanted, listed=3).count() == asked  # joined where they are many


def test_stream_check_by_stored_keys_equals_the_batch_check(spark, tmp_path):
    path, verdicts = str(tmp_path / "master"), str(tmp_path / "verdicts")
    people = [{"full_name": f"N{i}", "gov_id": f"G{i % 6}", "phone": f"+1{i:09d}", "email": ""} for i in range(24)]
    ingest(raw(spark, *people[:12]), path, "b1", now())
    ingest(raw(spark, *people[12:]), path, "b2", now())
    asked = raw(spark, people[3], {"gov_id": "nobody", "phone": "", "email": ""}, {"gov_id": None, "phone": None, "email": None},
                {**people[20], "full_name": ""})
    want = check_duplicates(asked, read_master(spark, path), method="keys", hot_rows=2).orderBy("query_id").collect()
    for state in ("keys by batch", "compacted", "no keys stored"):
        if state == "compacted":
            compact(spark, path)
        if state == "no keys stored":
            path = str(tmp_path / "old")
            read_master(spark, str(tmp_path / "master")).write.partitionBy("batch_id", "created_on").parquet(path)
        check_batch("s", path, verdicts, hot_rows=2)(asked, 0)
        got = spark.read.parquet(verdicts).drop("batch_id").orderBy("query_id").collect()
        assert [r.asDict(True) for r in got] == [r.asDict(True) for r in want], state
    assert [r.is_duplicate for r in want][:2] == [True, False] and want[0].candidates


def test_runs_merge_in_tiers_and_keep_the_last_batch(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert read_runs(spark, path) is None
    merge = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    for b in range(10):
        append_run(spark.createDataFrame([(b % 2, 1), (9, 1)], "k long, n long"), path, b, merge, fan=3)
    assert runs(spark, path) == [(0, 8), (9, 9)]
    append_run(spark.createDataFrame([(5, 1)], "k long, n long"), path, 9, merge, fan=3)  # replayed
    with pytest.raises(ValueError, match="cannot be replaced"):
        append_run(spark.createDataFrame([(5, 1)], "k long, n long"), path, 4, merge, fan=3)
    # A merged run that was broken off does not count.
    os.makedirs(f"{path}/run={0:012d}-{26:012d}")
    want = {0: 5, 1: 4, 9: 9, 5: 1}
    for _ in range(2):
        assert {r.k: r.n for r in merge(read_runs(spark, path)).collect()} == want
        drop_merged(spark, path)


def test_kept_clusters_equal_those_of_all_customers(spark, tmp_path):
    path = str(tmp_path / "clusters")
    rows = master_of(spark, *[{"full_name": f"N{i % 7}", "gov_id": "" if i % 3 else "G"} for i in range(60)])
    with pytest.raises(ValueError, match="no batch yet"):
        kept_clusters(spark, path)
    for b in range(18):
        add_to_clusters(rows.filter(F.col("customer_id") % 20 == b), path, b)
    add_to_clusters(rows.filter(F.col("customer_id") % 20 >= 18), path, 18)
    assert runs(spark, path)[0] == (0, 15)
    order = lambda df: sorted(tuple(r) for r in df.collect())
    assert order(kept_clusters(spark, path)) == order(identity_clusters(rows))


def test_reports_bring_in_rows_that_came_too_late(spark, tmp_path):
    path = str(tmp_path / "counts")
    batch = lambda *rows: spark.createDataFrame(rows, "d string, customers long").select(
        F.to_date("d").alias("created_on"), "customers")
    read = lambda: {str(r.created_on): r.customers for r in latest(spark, path, ["created_on"]).collect()}
    write = upsert_batch(path, ["created_on"])
    with pytest.raises(ValueError, match="no batch"):
        correct(batch(), path, ["created_on"])
    for b in range(20):
        write(batch((f"2024-01-{1 + b // 4:02d}", b + 1)), b)
    assert len(runs(spark, path)) == 5  # 0 to 15, and four
    assert read() == {"2024-01-01": 4, "2024-01-02": 8, "2024-01-03": 12, "2024-01-04": 16, "2024-01-05": 20}
    master = spark.createDataFrame([("2024-01-01",)] * 6 + [("2024-01-05",)] * 30, "d string").select(
        F.to_date("d").alias("created_on"))
    correct(customers_per_day(master), path, ["created_on"])
    assert read() == {"2024-01-01": 6, "2024-01-02": 8, "2024-01-03": 12, "2024-01-04": 16, "2024-01-05": 30}
    write(batch(("2024-01-05", 31)), 20)  # what the stream says later is newer
    assert read()["2024-01-05"] == 31 and read()["2024-01-01"] == 6
