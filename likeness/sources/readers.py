"""Readers for applicants, customers and labelled pairs."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness import schemas
from likeness.functions.vectors import vector_from_json

TEXT_FORMATS = {".csv": ",", ".tsv": "\t"}
PARQUET_FORMATS = [".parquet", ".pq"]


def _hadoop_path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Names of the folders in ``path`` that begin with ``prefix``, without it."""
    fs, p = _hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return [n.removeprefix(prefix) for n in names if n.startswith(prefix)]


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop_path(spark, path)
    fs.delete(p, True)


def _is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _has_parquet(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return any(
        s.isFile() and s.getPath().getName().endswith(".parquet")
        for s in fs.listStatus(p))


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multiline: bool = False,
) -> DataFrame:
    """A delimited file with a header, every column read as text.

    Types are never inferred, so ``+`` signs and leading zeros stay. Columns
    come from the header; a ``schema`` has to agree with it. Large files are split;
    where quoted fields hold line breaks, ``multiline=True`` reads each file in one task.
    """
    sep = TEXT_FORMATS.get(os.path.splitext(path)[1].lower(), ",")
    reader = (
        spark.read.option("header", True).option("sep", sep)
        .option("quote", '"').option("escape", '"').option("multiLine", multiline))
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet shards, columns united; ``data/`` is used if present."""
    data = f"{path.rstrip('/')}/data"
    folder = data if _is_dir(spark, data) else path
    return (
        spark.read.option("mergeSchema", True)
        .option("pathGlobFilter", "*.parquet").parquet(folder))


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """A dataset of split folders: ``train`` when there is one, else all."""
    fs, p = _hadoop_path(spark, path)
    splits = sorted(
        s.getPath().getName() for s in fs.listStatus(p)
        if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))
    if not splits:
        raise ValueError(f"{path}: neither delimited text nor Parquet, and no folder of either")
    chosen = ["train"] if "train" in splits else splits
    frames = [
        spark.read.option("mergeSchema", True).parquet(f"{path.rstrip('/')}/{s}")
        for s in chosen]
    return concat(frames)


def concat(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; a column missing in one is null there."""
    whole, *rest = frames
    for frame in rest:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole


def read_table(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Read by what the path is: a folder of shards or splits, or a file.

    ``multiline`` is for delimited files whose quoted fields hold line breaks.
    """
    extension = os.path.splitext(path)[1].lower()
    if _is_dir(spark, path):
        data = f"{path.rstrip('/')}/data"
        folder = data if _is_dir(spark, data) else path
        if _has_parquet(spark, folder):
            return read_shards(spark, path)
        if extension in TEXT_FORMATS:
            return read_delimited(spark, path, multiline=multiline)
        return read_splits(spark, path)
    if extension in TEXT_FORMATS:
        return read_delimited(spark, path, multiline=multiline)
    if extension in PARQUET_FORMATS:
        return spark.read.parquet(path)
    raise ValueError(f"{path}: neither delimited text nor Parquet, and no folder of either")


def read_payloads(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Applicants from JSON, an object on every line; large files are split.

    Without ``lines`` each file is one object or an array of them.
    """
    reader = spark.read.schema(schemas.RAW_PAYLOAD).option("multiLine", not lines)
    raw = reader.json(path)
    return resolve_aliases(raw)


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"column is missing: {', '.join(missing)}")
    return df


def vectors_from_text(df: DataFrame, column: str = "identity_vec") -> DataFrame:
    """Parse a vector column stored as JSON text; others pass unchanged."""
    if column in df.columns and isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(column, vector_from_json(F.col(column)))
    return df


def resolve_aliases(df: DataFrame) -> DataFrame:
    """Applicants under their field names, whichever accepted spelling is used.

    Columns that are no identity field (ids, loan fields) pass through.
    """
    present = set(df.columns)
    fields = []
    spellings = set()
    for field in schemas.RAW_FIELDS:
        names = [n for n in [field, *schemas.ALIASES.get(field, [])]]
        spellings.update(names)
        found = [F.col(n).cast("string") for n in names if n in present]
        value = F.coalesce(*found) if found else F.lit(None).cast("string")
        fields.append(value.alias(field))
    others = [F.col(c) for c in df.columns if c not in spellings]
    return df.select(*others, *fields)
