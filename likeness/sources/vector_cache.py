"""Encoded vectors kept by encoder and identity text, so that none is computed twice."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.sources.readers import path_exists

Encoder = Callable[[DataFrame], DataFrame]


def text_key(encoder: str, column: str = "identity_text"):
    """Digest of a text as one encoder sees it.

    ``encoder`` names the model, its version and its width.
    """
    return F.sha2(F.concat_ws("\n", F.lit(encoder), F.col(column)), 256).alias("text_key")


def missing_texts(texts: DataFrame, cache: DataFrame, encoder: str) -> DataFrame:
    """Distinct texts whose vector by this encoder the cache does not hold."""
    distinct = texts.select("identity_text").distinct()
    return distinct.select("identity_text", text_key(encoder)).join(
        cache.select("text_key"), "text_key", "left_anti")


def cached_vectors(texts: DataFrame, path: str, encode: Encoder, encoder: str) -> DataFrame:
    """Vectors of all distinct texts, encoding and appending only the missing.

    ``encode`` adds ``identity_vec`` to a table of ``identity_text``; ``encoder`` names it.
    Two writers may append a text twice; it is read once.
    """
    spark = texts.sparkSession
    if path_exists(spark, path):
        todo = missing_texts(texts, spark.read.parquet(path), encoder)
    else:
        todo = texts.select("identity_text").distinct().select(
            "identity_text", text_key(encoder))
    encode(todo).select("text_key", "identity_vec").write.mode("append").parquet(path)
    wanted = texts.select("identity_text").distinct().select("identity_text", text_key(encoder))
    return wanted.join(spark.read.parquet(path), "text_key").dropDuplicates(["text_key"]).select(
        "identity_text", "identity_vec")
