"""The customer master: a Parquet table partitioned by day of creation.

New rows lie in one folder per batch, ``batch_id=<load>/created_on=<day>``, so that loading a
batch again replaces exactly its own rows. :func:`compact` rewrites many batches as one
generation, ``_compacted/gen=<n>``, by day; its list of batches is written last and is what
readers go by. Beside the rows lie the customers' keys, sorted, to find them by.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness import schemas
from likeness.operators.keys import KEYS, key_rows
from likeness.sources.checkpoints import written
from likeness.sources.readers import delete, folders, lower_columns, path_exists, require_columns

SCAN_COLUMNS = ["customer_id", "dob", *schemas.CUSTOMER_TEXT_FIELDS, "identity_text"]

MASTER = T.StructType([
    *schemas.CUSTOMER.fields,
    T.StructField("batch_id", T.StringType()),
    T.StructField("created_on", T.DateType()),
])


# One row per key of a customer.
INDEX = T.StructType([
    T.StructField("block", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("batch_id", T.StringType()),
])

# Up to this many values go into a filter that Parquet reads by; more are joined.
LISTED = 2_000


def bloom(column: str) -> dict[str, str]:
    """Options of a writer whose row groups can be skipped by values of ``column``."""
    return {f"parquet.bloom.filter.enabled#{column}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def generation(spark: SparkSession, path: str) -> tuple[str | None, set[str], set[str]]:
    """The folder of the last whole generation, its batches, and those loaded again since."""
    base = f"{path.rstrip('/')}/_compacted"
    for n in sorted(folders(spark, base, "gen="), reverse=True):
        folder = f"{base}/gen={n}"
        if path_exists(spark, f"{folder}/batches/_SUCCESS"):
            # One short name per batch, as the driver lists the folders too.
            held = {r[0] for r in spark.read.schema("batch_id string").parquet(f"{folder}/batches").collect()}
            return folder, held, set(folders(spark, f"{folder}/reloaded", "of="))
    return None, set(), set()


def _fresh(spark: SparkSession, path: str, held: set[str], reloaded: set[str]) -> list[str]:
    """Batches that are read from their own folders."""
    return sorted(set(folders(spark, path, "batch_id=")) - (held - reloaded))


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """The customer master at ``path``; no rows when there is none yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], MASTER)
    folder, held, reloaded = generation(spark, path)
    if folder is None:
        return spark.read.schema(MASTER).parquet(path)
    rows = spark.read.schema(MASTER).parquet(f"{folder}/rows")
    if reloaded:
        rows = rows.filter(~F.col("batch_id").isin(sorted(reloaded)))
    fresh = _fresh(spark, path, held, reloaded)
    return rows.unionByName(_batches(spark, path, fresh)) if fresh else rows


def _batches(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    base = path.rstrip("/")
    return spark.read.schema(MASTER).option("basePath", base).parquet(
        *[f"{base}/batch_id={name}" for name in names])


def write_keys(rows: DataFrame, folder: str, group_bytes: int = 4 << 20) -> None:
    """Key rows in order of the key, in small row groups; many rows of one key fall to several tasks."""
    rows.repartitionByRange("block", "customer_id").sortWithinPartitions("block", "customer_id").write.options(
        **bloom("block")).option("parquet.block.size", group_bytes).mode("overwrite").parquet(folder)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(block, customer_id, batch_id) of all keys of the master.

    Batches without stored keys, as of masters written before there were any, are scanned.
    """
    base = path.rstrip("/")
    folder, held, reloaded = generation(spark, path)
    parts = [spark.createDataFrame([], INDEX)]
    if folder:
        kept = spark.read.schema(INDEX).parquet(f"{folder}/keys")
        parts.append(kept.filter(~F.col("batch_id").isin(sorted(reloaded))) if reloaded else kept)
    fresh = _fresh(spark, path, held, reloaded)
    stored = [b for b in fresh if path_exists(spark, f"{base}/_keys/batch_id={b}/_SUCCESS")]
    if stored:
        parts.append(spark.read.schema(INDEX).option("basePath", f"{base}/_keys").parquet(
            *[f"{base}/_keys/batch_id={b}" for b in stored]))
    if len(stored) < len(fresh):
        scanned = _batches(spark, path, sorted(set(fresh) - set(stored)))
        parts.append(key_rows(scanned, "customer_id", "batch_id").select(*INDEX.names))
    whole, *rest = parts
    for part in rest:
        whole = whole.unionByName(part)
    return whole


def among(df: DataFrame, column: str, values: DataFrame, listed: int = LISTED) -> DataFrame:
    """Rows whose ``column`` is one of ``values`` (one column of that name, distinct).

    Up to ``listed`` values become a filter, by which Parquet skips row groups; more are joined.
    """
    few = values.limit(listed + 1).collect()
    if len(few) <= listed:
        return df.filter(F.col(column).isin([r[0] for r in few]))
    return df.join(values, column, "left_semi")


def customers_with_keys(
    spark: SparkSession, path: str, asked: DataFrame, seen: Column | None = None, listed: int = LISTED
) -> DataFrame:
    """The master's rows that hold one of the keys ``asked`` for (distinct ``block``), all of them.

    ``seen`` narrows the batches looked at. Reads the keys' row groups that can hold a key
    asked for and then the rows' that can hold a customer found, not the master.
    """
    keys, rows = read_keys(spark, path), read_master(spark, path)
    if seen is not None:
        keys, rows = keys.filter(seen), rows.filter(seen)
    ids = written(among(keys, "block", asked, listed).select("customer_id").distinct(), "holders")
    return among(rows, "customer_id", ids, listed)


def scan_customers(customers: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Named columns of any customer table, by default all but the vector.

    Column names are folded to lower case; a table without ids is refused.
    """
    table = require_columns(lower_columns(customers), "customer_id")
    wanted = columns or [c for c in SCAN_COLUMNS if c in table.columns]
    return table.select(*wanted)


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    bounds: tuple[int, int],
    partitions: int,
    columns: list[str] | None = None,
    **properties: str,
) -> DataFrame:
    """A customer table in a database, read in ranges of ``customer_id``."""
    wanted = columns or SCAN_COLUMNS
    rows = (
        spark.read.format("jdbc").options(
            url=url, dbtable=table, partitionColumn="customer_id",
            lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
        .options(**properties).load())
    return scan_customers(rows, wanted)


# One small row per batch: who wrote it, and the last id that it uses. The writer is put
# down in ``_claims`` before any row of the batch, the last id after the last row.
MANIFEST = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("writer", T.StringType()),
    T.StructField("last_id", T.LongType()),
])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    folder = f"{path.rstrip('/')}/_manifest"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(folder)


def last_id(spark: SparkSession, path: str, other_than: str) -> int:
    """The largest id in use by other batches, zero for a new master.

    From the manifest. Only folders of batches that are not in it, as after a crash between
    rows and manifest, have their ids scanned; the names of the folders tell.
    """
    # One row per folder, whose names the driver lists as well.
    used = {r["batch_id"]: r["last_id"] or 0 for r in read_manifest(spark, path).collect()}
    last = max((n for batch, n in used.items() if batch != other_than), default=0)
    unlisted = set(folders(spark, path, "batch_id=")) - used.keys() - {other_than}
    if unlisted:
        rows = read_master(spark, path).filter(F.col("batch_id").isin(sorted(unlisted)))
        last = max(last, rows.agg(F.coalesce(F.max("customer_id"), F.lit(0))).first()[0])
    return last


def refuse_other_writer(spark: SparkSession, path: str, batch_id: str, writer: str) -> None:
    """A batch is replaced by its own writer only, also one that was broken off.

    Puts the writer down when there is none yet.
    """
    claim = f"{path.rstrip('/')}/_claims/of={batch_id}"
    row = read_manifest(spark, path).filter(F.col("batch_id") == batch_id).first()
    if row is None and path_exists(spark, claim):
        row = spark.read.schema("writer string").parquet(claim).first()
    if row is None:
        spark.createDataFrame([(writer,)], "writer string").coalesce(1).write.mode("overwrite").parquet(claim)
    elif row["writer"] != writer:
        raise ValueError(
            f"batch {batch_id} was loaded by '{row['writer']}', not by '{writer}'; name the stream anew")


def with_ids(rows: DataFrame, after: int, order: list[str] | None = None) -> DataFrame:
    """Number the rows ``after + 1, after + 2, ...`` without a global sort task.

    Rows keep their input order, or are range-partitioned by ``order``. The
    staged table fixes each row's place, one small count per partition gives
    the offsets, and a retried task cannot renumber anything.
    """
    if order:
        # A digest as tie-break, so that many rows of one value can be split.
        tie = F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")])
        rows = rows.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    place = F.monotonically_increasing_id()
    staged = written(
        rows.withColumn("_part", F.shiftright(place, 33).cast("int"))
        .withColumn("_place", place.bitwiseAND((1 << 33) - 1)),
        "numbered")
    # One row per task of the staging job, counted on the driver's side of a
    # broadcast; its size is the number of tasks.
    counts = staged.groupBy("_part").count().collect()
    offsets, total = [], after
    for part, n in sorted((r["_part"], r["count"]) for r in counts):
        offsets.append((part, total))
        total += n
    schema = T.StructType([
        T.StructField("_part", T.IntegerType()), T.StructField("_offset", T.LongType())])
    starts = rows.sparkSession.createDataFrame(offsets, schema)
    return (
        staged.join(F.broadcast(starts), "_part")
        .withColumn("customer_id", F.col("_offset") + F.col("_place") + 1)
        .drop("_part", "_place", "_offset"))


def append_customers(
    customers: DataFrame,
    path: str,
    batch_id: str,
    created_at: Column,
    order: list[str] | None = None,
    writer: str = "",
) -> DataFrame:
    """Append normalised customers under fresh ids; gives the batch as written.

    ``created_at`` is used where rows bring no time of their own. One writer at a
    time: ids continue from the largest of the other batches, so writing a batch
    again gives the same rows. A batch that another ``writer`` loaded is refused.
    """
    spark = customers.sparkSession
    refuse_other_writer(spark, path, batch_id, writer)
    stamp = (
        F.coalesce(F.col("created_at"), created_at)
        if "created_at" in customers.columns else created_at)
    numbered = with_ids(
        customers.withColumn("created_at", stamp),
        last_id(spark, path, other_than=batch_id), order)
    folder = f"{path.rstrip('/')}/batch_id={batch_id}"
    numbered.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.CUSTOMER.fields],
        F.to_date("created_at").alias("created_on"),
    ).write.options(**bloom("customer_id")).mode("overwrite").partitionBy("created_on").parquet(folder)
    loaded = _batches(spark, path, [batch_id])
    write_keys(
        key_rows(loaded.select("customer_id", *KEYS.values()), "customer_id").select("block", "customer_id"),
        f"{path.rstrip('/')}/_keys/batch_id={batch_id}")
    compacted, held, _ = generation(spark, path)
    if batch_id in held:
        spark.createDataFrame([(batch_id,)], "batch_id string").coalesce(1).write.mode("overwrite").parquet(
            f"{compacted}/reloaded/of={batch_id}")
    loaded.agg(F.max("customer_id").alias("last_id")).select(
        F.lit(batch_id).alias("batch_id"), F.lit(writer).alias("writer"), "last_id",
    ).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/_manifest/of={batch_id}")
    return loaded


def compact(spark: SparkSession, path: str) -> str | None:
    """Rewrite all batches, and the generation before, as one generation by day; gives its folder.

    Days are rebalanced to files of the advisory size, so that many small batches make few
    files a day and a large day several. Rows keep their ids and batches. What was there
    stays until :func:`drop_superseded`, so that running readers go on. Readers turn to the new
    generation when its list of batches is whole; a compaction that was broken off is never read.
    Ids of batches, writers and replays are as before. One writer at a time, this one included.
    """
    if not path_exists(spark, path):
        return None
    base = path.rstrip("/")
    folder, held, reloaded = generation(spark, path)
    fresh = _fresh(spark, path, held, reloaded)
    if not fresh:
        return folder
    number = max([int(n) for n in folders(spark, f"{base}/_compacted", "gen=")], default=-1) + 1
    target = f"{base}/_compacted/gen={number:08d}"
    read_master(spark, path).hint("rebalance", "created_on").sortWithinPartitions(
        "created_on", "customer_id").write.options(**bloom("customer_id")).partitionBy(
            "created_on").parquet(f"{target}/rows")
    write_keys(read_keys(spark, path), f"{target}/keys")
    spark.createDataFrame([(b,) for b in sorted(held | set(fresh))], "batch_id string").coalesce(
        1).write.parquet(f"{target}/batches")
    return target


def drop_superseded(spark: SparkSession, path: str) -> list[str]:
    """Delete batch folders and generations that no reader starts with any more; gives their names."""
    base = path.rstrip("/")
    folder, held, reloaded = generation(spark, path)
    if folder is None:
        return []
    mine = folder.rsplit("/", 1)[1]
    gone = [f"_compacted/gen={n}" for n in folders(spark, f"{base}/_compacted", "gen=") if f"gen={n}" != mine]
    for b in sorted(set(folders(spark, path, "batch_id=")) & (held - reloaded)):
        gone += [f"batch_id={b}", f"_keys/batch_id={b}"]
    for name in gone:
        delete(spark, f"{base}/{name}")
    return gone
