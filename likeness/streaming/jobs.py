"""Streams of applicants: checked against the master, ingested, and counted."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from likeness.operators.keys import key_rows
from likeness.plans.check import check_duplicates
from likeness.plans.ingest import ingest
from likeness.plans.records import query_object
from likeness.plans.stats import HIGH_RISK_HOLDERS, ALERT_HOLDERS
from likeness.schemas import RAW_APPLICANT, RAW_FIELDS
from likeness.sources.checkpoints import written
from likeness.sources.master import customers_with_keys, read_master
from likeness.sources.readers import folders, path_exists
from likeness.sources.runs import append_run, read_runs, runs


def applicant_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_APPLICANT,
    file_format: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Applicant files as they arrive; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def batch_name(stream: str, batch_id: int) -> str:
    """Streams into one master number their batches apart."""
    return f"stream-{stream}-{batch_id:012d}"


def run_id(batch: DataFrame) -> str:
    """The identity of the running query; it stays with its progress folder."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def ingest_batch(
    stream: str,
    master_path: str,
    created_at: Column,
    rejects_path: str | None = None,
    order: list[str] | None = None,
    **checks,
) -> Callable[[DataFrame, int], None]:
    """The work on one micro-batch: load it under the stream's name and its own number.

    A batch that is run again finds the ids of the other batches unchanged and
    replaces its own folder with the same rows. A stream started again on a fresh
    progress folder counts from 0; it is refused, and needs another name.
    """
    def load(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(stream, batch_id)
        _, rejects = ingest(
            batch, master_path, name, created_at, order=order, writer=run_id(batch), **checks)
        if rejects_path is not None:
            rejects.write.mode("overwrite").parquet(
                f"{rejects_path.rstrip('/')}/batch_id={name}")
    return load


def check_batch(
    stream: str, master_path: str, verdicts_path: str, **check
) -> Callable[[DataFrame, int], None]:
    """The work on one micro-batch: verdicts against the master as it is.

    Customers of this and later batches of the stream are left out, so that a batch that
    is run again after its ingest gives the same verdicts. By default only customers that
    share a key are looked at: they are found by the master's stored keys, of which a small
    batch reads few row groups, and the master itself is not scanned.
    """
    check = {"method": "keys"} | check

    def run(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(stream, batch_id)
        seen = ~F.col("batch_id").startswith(f"stream-{stream}-") | (F.col("batch_id") < name)
        if check["method"] == "keys":
            asked = written(key_rows(query_object(
                batch.select("query_id", *RAW_FIELDS), "query_id")).distinct(), "asked")
            master = customers_with_keys(batch.sparkSession, master_path, asked, seen)
        else:
            master = read_master(batch.sparkSession, master_path).filter(seen)
        check_duplicates(batch, master, **check).write.mode("overwrite").parquet(
            f"{verdicts_path.rstrip('/')}/batch_id={name}")
    return run


def ingest_stream(
    stream: DataFrame, name: str, master_path: str, created_at: Column, **options
) -> DataStreamWriter:
    """A writer that loads every micro-batch; the caller starts it."""
    return stream.writeStream.foreachBatch(
        ingest_batch(name, master_path, created_at, **options))


def check_stream(
    stream: DataFrame, name: str, master_path: str, verdicts_path: str, **check
) -> DataStreamWriter:
    """A writer that checks every micro-batch; ``stream`` has ``query_id``."""
    return stream.writeStream.foreachBatch(
        check_batch(name, master_path, verdicts_path, **check))


def check_and_ingest_stream(
    stream: DataFrame,
    name: str,
    master_path: str,
    verdicts_path: str,
    created_at: Column,
    check: dict | None = None,
    **options,
) -> DataStreamWriter:
    """Every micro-batch is checked first and loaded then.

    Duplicates within one micro-batch meet in the next check of either.
    """
    first = check_batch(name, master_path, verdicts_path, **(check or {}))
    then = ingest_batch(name, master_path, created_at, **options)

    def run(batch: DataFrame, batch_id: int) -> None:
        first(batch, batch_id)
        then(batch, batch_id)
    return stream.writeStream.foreachBatch(run)


def newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Brings changes to the last one of each key; ``batch`` tells which that is."""
    def merge(changes: DataFrame) -> DataFrame:
        values = [c for c in changes.columns if c not in (*keys, "batch")]
        return changes.groupBy(*keys).agg(
            F.max("batch").alias("batch"), F.max_by(F.struct(*values), "batch").alias("last"),
        ).select(*keys, "batch", "last.*")
    return merge


def upsert_batch(path: str, keys: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """The work on one micro-batch of changed counts: append them under the batch's number.

    For the update mode; :func:`latest` gives the table as it stands. A batch run again
    replaces its own rows. With ``keys`` the batches before are merged in tiers, so that
    ``latest`` opens a number of folders that grows with the logarithm of the batches.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        append_run(
            batch.withColumn("batch", F.lit(batch_id).cast("bigint")), path, batch_id,
            newest(keys) if keys else None)
    return run


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last count of each key that :func:`upsert_batch` or :func:`correct` wrote."""
    changes = read_runs(spark, path)
    if changes is None:
        raise ValueError(f"{path}: no batch yet")
    for name in sorted(folders(spark, path, "correction="), reverse=True):
        folder = f"{path.rstrip('/')}/correction={name}"
        if path_exists(spark, f"{folder}/_SUCCESS"):
            # Where both are of one batch, the correction is the later word.
            changes = changes.withColumn("batch", F.col("batch") * 2).unionByName(
                spark.read.schema(changes.schema).parquet(folder).withColumn("batch", F.col("batch") * 2 + 1))
            break
    return newest(keys)(changes).drop("batch")


def correct(counts: DataFrame, path: str, keys: list[str]) -> None:
    """Put a report's counts in place of the stream's, for rows that came too late for it.

    ``counts`` has the stream's columns, as from :func:`likeness.plans.stats.customers_per_day`
    over the master, and should be limited to keys that are closed: a count that the stream
    changes later is taken as newer. Each correction stands for those before it, so it should
    cover all that is closed.
    """
    spark = counts.sparkSession
    done = runs(spark, path)
    if not done:
        raise ValueError(f"{path}: no batch to correct yet")
    last = done[-1][1]
    number = 1 + max((int(n) for n in folders(spark, path, "correction=")), default=-1)
    wanted = read_runs(spark, path).columns
    counts.withColumn("batch", F.lit(last).cast("bigint")).select(*wanted).write.parquet(
        f"{path.rstrip('/')}/correction={number:012d}")


def daily_counts(customers: DataFrame, late: str = "1 day") -> DataFrame:
    """Customers per day of creation; rows later than ``late`` are not counted.

    The batch report counts these too, and :func:`correct` brings them in.
    """
    return (
        customers.withWatermark("created_at", late)
        .groupBy(F.window("created_at", "1 day").alias("day"))
        .agg(F.count("*").alias("customers"))
        .select(F.to_date("day.start").alias("created_on"), "customers"))


def holder_counts(customers: DataFrame) -> DataFrame:
    """Running holders per government id, with its alert level.

    The state has one counter per distinct id.
    """
    return (
        customers.filter(F.nullif("gov_id_norm", F.lit("")).isNotNull())
        .groupBy("gov_id_norm").agg(F.count("*").alias("holders"))
        .withColumn("alert", F.when(
            F.col("holders") >= HIGH_RISK_HOLDERS, "high").when(
            F.col("holders") >= ALERT_HOLDERS, "repeated").otherwise("none")))
