"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept and is written before the next reads
it: toxic documents go, of near duplicates (five-word shingles, similarity 0.8) the one with the
smallest id stays, contaminated documents go, personal data in the texts is replaced by its
kind, and the rest is packed into sequences, whose texts come out in pieces (bin, place, text).
"""

from pyspark.sql import DataFrame, SparkSession

from likeness.llm import contamination, neardup, packing, pii, toxicity
from likeness.sources.checkpoints import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_texts(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("packing", packed),
]
#: The trained toxicity stage and the packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
