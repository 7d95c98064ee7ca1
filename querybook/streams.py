"""The streams, run to the end of what has arrived; results equal the batch jobs'."""

import uuid

from pyspark.sql import functions as F

from likeness.sources.checkpoints import checkpoint_dir
from likeness.sources.master import append_customers, compact, drop_superseded, read_master
from likeness.streaming.jobs import (
    applicant_stream, check_stream, daily_counts, holder_counts, ingest_stream, latest,
    upsert_batch)
from querybook.base import AS_OF, applicants, customers, query, sql_cust
from querybook.checks import _KEYED, _VERDICT, _verdict, check_sql


def _folder(spark):
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def _arrivals(spark, sf_dir, folder):
    """Applicants as files to be read as a stream."""
    raw = applicants(spark, sf_dir).withColumn(
        "created_at", F.col("created_on").cast("timestamp"))
    raw.repartitionByRange(4, "created_at", "customer_id").write.parquet(f"{folder}/arrivals")
    return applicant_stream(spark, f"{folder}/arrivals", raw.schema, files_per_batch=2)


def _finish(writer, folder):
    writer.option("checkpointLocation", f"{folder}/progress-{uuid.uuid4().hex}").trigger(
        availableNow=True).start().awaitTermination()


@query("t1_stream_ingest", sql_cust("""
  SELECT identity_text, CAST(created_on AS VARCHAR) AS created_on, count(*) AS customers
  FROM cust GROUP BY identity_text, created_on"""))
def t1(spark, sf_dir):
    folder = _folder(spark)
    stream = _arrivals(spark, sf_dir, folder).drop("created_on")
    _finish(ingest_stream(
        stream, "arrivals", f"{folder}/master", F.to_timestamp(F.lit(AS_OF)), order=["customer_id"]), folder)
    return read_master(spark, f"{folder}/master").groupBy(
        "identity_text", F.col("created_on").cast("string").alias("created_on")
    ).agg(F.countDistinct("customer_id").alias("customers"))


@query("s11_compacted_master", sql_cust("""
  SELECT row_number() OVER (ORDER BY customer_id % 3, customer_id) AS customer_id,
         identity_text, CAST(created_on AS VARCHAR) AS created_on, 'b' || customer_id % 3 AS batch
  FROM cust"""))
def s11_compacted(spark, sf_dir):
    """Three batches, two of them compacted, the old folders dropped, and all compacted again."""
    path = f"{_folder(spark)}/master"
    rows = customers(spark, sf_dir).withColumn("created_at", F.col("created_on").cast("timestamp"))
    for i in range(3):
        append_customers(rows.filter(F.col("customer_id") % 3 == i), path, f"b{i}",
                         F.to_timestamp(F.lit(AS_OF)), ["customer_id"])
        if i:
            compact(spark, path)
            drop_superseded(spark, path)
    return read_master(spark, path).select(
        "customer_id", "identity_text", F.col("created_on").cast("string").alias("created_on"),
        F.col("batch_id").alias("batch"))


@query("t2_stream_check", check_sql(_VERDICT, _KEYED))
def t2(spark, sf_dir):
    folder = _folder(spark)
    stream = _arrivals(spark, sf_dir, folder).withColumnRenamed("customer_id", "query_id")
    master = customers(spark, sf_dir)
    append_customers(
        master, f"{folder}/master", "bulk", F.to_timestamp(F.lit(AS_OF)), ["customer_id"])
    _finish(check_stream(
        stream, "arrivals", f"{folder}/master", f"{folder}/verdicts", method="keys"), folder)
    # The master numbers its customers from 1, in order of their former ids.
    checked = spark.read.parquet(f"{folder}/verdicts")
    return _verdict(checked).withColumn("best_customer_id", F.when(
        F.col("best_customer_id") > 0, F.col("best_customer_id") - 1
    ).otherwise(F.col("best_customer_id")))


def _updated(counts, keys):
    """The counts of a stream in update mode, each micro-batch written to a table."""
    folder = _folder(counts.sparkSession)
    _finish(counts.writeStream.outputMode("update").foreachBatch(
        upsert_batch(f"{folder}/counts", keys)), folder)
    return latest(counts.sparkSession, f"{folder}/counts", keys)


@query("t3_stream_daily_counts", sql_cust("""
  SELECT CAST(created_on AS VARCHAR) AS created_on, count(*) AS customers
  FROM cust GROUP BY created_on"""))
def t3_days(spark, sf_dir):
    stream = _arrivals(spark, sf_dir, _folder(spark))
    # All files of a day arrive together here, so that no row comes too late.
    return _updated(daily_counts(stream, "40 days"), ["created_on"]).select(
        F.col("created_on").cast("string").alias("created_on"), "customers")


@query("t3_stream_holders", sql_cust("""
  SELECT gov_id_norm, count(*) AS holders,
         CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) > 1 THEN 'repeated' ELSE 'none' END AS alert
  FROM cust WHERE gov_id_norm <> '' GROUP BY gov_id_norm"""))
def t3_holders(spark, sf_dir):
    from likeness.functions.normalize import norm_govid
    stream = _arrivals(spark, sf_dir, _folder(spark)).withColumn(
        "gov_id_norm", norm_govid(F.col("gov_id")))
    return _updated(holder_counts(stream), ["gov_id_norm"])
