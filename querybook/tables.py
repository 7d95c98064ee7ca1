"""Sources, sinks and unions, over tables that Spark writes from the given ones."""

import uuid

from pyspark.sql import functions as F

from likeness.functions.encode import encode_texts
from likeness.plans.ingest import ingest
from likeness.plans.records import pair_query_columns
from likeness.sources import readers
from likeness.sources.checkpoints import checkpoint_dir
from likeness.sources.master import scan_customers
from likeness.sources.sinks import CSV_OPTIONS, write_pairs
from likeness.sources.vector_cache import cached_vectors
from querybook.base import (
    applicants, customers, query, rounded, sql_cust, sql_fx, sql_vec, table)


def _new_path(spark, name):
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}/{name}"


_RAW = ["full_name", "dob", "phone", "email", "gov_id", "addr_line", "city", "state",
        "postal_code", "country"]
_RAW_SQL = "SELECT customer_id, " + ", ".join(
    f"coalesce({c}, '') AS {c}" for c in _RAW) + " FROM fx"


def _filled(df):
    return df.select(F.col("customer_id").cast("bigint").alias("customer_id"), *[
        F.coalesce(F.col(c), F.lit("")).alias(c) for c in _RAW])


@query("s1_csv_scan", sql_fx(_RAW_SQL))
def s1(spark, sf_dir):
    path = _new_path(spark, "applicants.csv")
    applicants(spark, sf_dir).write.options(**CSV_OPTIONS).csv(path)
    return _filled(readers.read_table(spark, path))


@query("s1_tsv_scan", sql_fx(_RAW_SQL))
def s1_tsv(spark, sf_dir):
    path = _new_path(spark, "applicants.tsv")
    applicants(spark, sf_dir).write.options(**CSV_OPTIONS, sep="\t").csv(path)
    return _filled(readers.read_table(spark, path))


@query("s2_parquet_scan", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def s2(spark, sf_dir):
    return readers.read_table(spark, f"{sf_dir}/customer.parquet").select(
        "c_custkey", "c_name", "c_mktsegment")


@query("s3_shard_folder", """
  SELECT c_custkey, c_name, NULL::VARCHAR AS segment FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal >= 0""")
def s3(spark, sf_dir):
    path = _new_path(spark, "shards")
    t = table(spark, sf_dir, "customer")
    owing = t.filter("c_acctbal < 0").select("c_custkey", "c_name")
    others = t.filter("c_acctbal >= 0").select(
        "c_custkey", "c_name", F.col("c_mktsegment").alias("segment"))
    owing.write.mode("append").parquet(f"{path}/data")
    others.write.mode("append").parquet(f"{path}/data")
    return readers.read_table(spark, path).select("c_custkey", "c_name", "segment")


@query("s4_train_split", "SELECT doc_id, lang FROM documents WHERE lang <> 'en'")
def s4(spark, sf_dir):
    path = _new_path(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    docs.filter("lang <> 'en'").write.parquet(f"{path}/train")
    docs.filter("lang = 'en'").write.parquet(f"{path}/test")
    return readers.read_table(spark, path)


@query("s4_all_splits", "SELECT doc_id, lang FROM documents")
def s4_all(spark, sf_dir):
    path = _new_path(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    docs.filter("lang <> 'en'").write.parquet(f"{path}/validation")
    docs.filter("lang = 'en'").write.parquet(f"{path}/test")
    return readers.read_table(spark, path)


@query("s6_master_scan", sql_cust("""
  SELECT customer_id, coalesce(dob, '') AS dob, full_name, phone_e164, email_norm, gov_id_norm,
         identity_text FROM cust"""))
def s6(spark, sf_dir):
    upper = customers(spark, sf_dir)
    upper = upper.toDF(*[c.upper() for c in upper.columns])
    return scan_customers(upper).select(
        "customer_id", F.coalesce(F.col("dob").cast("string"), F.lit("")).alias("dob"),
        "full_name", "phone_e164", "email_norm", "gov_id_norm", "identity_text")


@query("s7_lower_columns", "SELECT c_custkey AS customer_id, c_name AS full_name FROM customer")
def s7(spark, sf_dir):
    named = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("CUSTOMER_ID"), F.col("c_name").alias("Full_Name"))
    return readers.lower_columns(named)


_SOURCES = ["customer", "documents", "events"]


@query("s5_dispatch", " UNION ALL ".join(
    f"SELECT '{t}{e}' AS source, {'true' if ok else 'false'} AS accepted, "
    + (f"count(*) AS records FROM {t}" if ok else "0::BIGINT AS records")
    for t in _SOURCES for e, ok in ((".parquet", True), (".csv", True), (".xlsx", False))))
def s5(spark, sf_dir):
    """What each given table is read as, by its name."""
    outcomes = []
    for t in _SOURCES:
        copies = {".parquet": f"{sf_dir}/{t}.parquet", ".csv": _new_path(spark, f"{t}.csv"),
                  ".xlsx": f"{sf_dir}/{t}.xlsx"}
        table(spark, sf_dir, t).select(F.xxhash64("*").alias("row")).write.options(**CSV_OPTIONS).csv(copies[".csv"])
        for extension, path in copies.items():
            try:
                outcomes.append((t + extension, True, readers.read_table(spark, path).count()))
            except ValueError:
                outcomes.append((t + extension, False, 0))
    return spark.createDataFrame(outcomes, "source string, accepted boolean, records bigint")


@query("s8_required_columns", " UNION ALL ".join(
    f"SELECT '{t}' AS source, {'true' if t == 'documents' else 'false'} AS accepted, count(*) AS records FROM {t}"
    for t in _SOURCES))
def s8(spark, sf_dir):
    """Which of the given tables have the columns of a document."""
    def accepted(t):
        try:
            readers.require_columns(t, "doc_id", "text")
            return True
        except KeyError:
            return False
    rows = [(t, accepted(table(spark, sf_dir, t)), table(spark, sf_dir, t).count()) for t in _SOURCES]
    return spark.createDataFrame(rows, "source string, accepted boolean, records bigint")


@query("s9_vector_from_text", """
  SELECT vec_id, len(embedding) AS width, round(list_sum(embedding::DOUBLE[]), 4) AS total
  FROM embeddings""")
def s9(spark, sf_dir):
    as_text = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.to_json("embedding").alias("identity_vec"))
    total = F.aggregate("identity_vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return readers.vectors_from_text(as_text).select(
        "vec_id", F.size("identity_vec").cast("bigint").alias("width"),
        F.round(total, 4).alias("total"))


@query("s10_payloads", sql_fx(
    "SELECT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in _RAW) + " FROM fx"))
def s10(spark, sf_dir):
    path = _new_path(spark, "payloads")
    applicants(spark, sf_dir).select(*_RAW).withColumnsRenamed({
        "dob": "date_of_birth", "gov_id": "government_id", "addr_line": "address_line",
    }).write.json(path)
    read = readers.read_payloads(spark, path, lines=True)
    return read.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in _RAW])


@query("s11_append", sql_cust("""
  SELECT (b - 1) * (SELECT count(*) FROM cust)
           + row_number() OVER (PARTITION BY b ORDER BY customer_id) AS customer_id,
         identity_text, CAST(created_on AS VARCHAR) AS created_on, 'load-' || b AS batch_id
  FROM cust CROSS JOIN (SELECT unnest([1, 2]) AS b) t"""))
def s11(spark, sf_dir):
    path = _new_path(spark, "master")
    raw = applicants(spark, sf_dir).select(
        "*", F.col("created_on").cast("timestamp").alias("created_at")).drop("created_on")
    now = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    first, _ = ingest(raw, path, "load-1", now, order=["customer_id"])
    second, _ = ingest(raw, path, "load-2", now, order=["customer_id"])
    return first.unionByName(second).select(
        "customer_id", "identity_text", F.col("created_on").cast("string").alias("created_on"),
        "batch_id")


def _pair_rows(spark, sf_dir):
    return pair_query_columns(customers(spark, sf_dir), "customer_id").select(
        *[F.col(c) for c in ("query_full_name", "query_dob", "query_phone", "query_addr")],
        F.col("customer_id").alias("cand_customer_id"), F.lit(1).alias("label"))


_PAIR_SQL = sql_cust("""
  SELECT full_name AS query_full_name, coalesce(dob, '') AS query_dob, phone_e164 AS query_phone,
         addr_line AS query_addr, customer_id AS cand_customer_id, 1 AS label FROM cust""")


@query("s12_pair_sink_csv", _PAIR_SQL)
def s12_csv(spark, sf_dir):
    path = _new_path(spark, "pairs.csv")
    write_pairs(_pair_rows(spark, sf_dir), path)
    return readers.read_table(spark, path).select(
        "query_full_name", F.coalesce("query_dob", F.lit("")).alias("query_dob"), "query_phone",
        "query_addr", F.col("cand_customer_id").cast("bigint").alias("cand_customer_id"),
        F.col("label").cast("int").alias("label"))


@query("s12_pair_sink_parquet", _PAIR_SQL)
def s12_parquet(spark, sf_dir):
    path = _new_path(spark, "pairs.parquet")
    write_pairs(_pair_rows(spark, sf_dir), path)
    return readers.read_table(spark, path).fillna("", ["query_dob"])


@query("s14_vector_cache", sql_vec("""
  SELECT identity_text, round(list_sum(any_value(vec)), 6) AS vec_sum
  FROM cust c JOIN vecs v ON v.customer_id = c.customer_id GROUP BY identity_text"""))
def s14(spark, sf_dir):
    path = _new_path(spark, "vectors")
    texts = customers(spark, sf_dir).select("identity_text", "gov_id_norm")
    cached_vectors(texts.filter("gov_id_norm = ''"), path, encode_texts, "trigrams:512")
    total = F.aggregate("identity_vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return cached_vectors(texts, path, encode_texts, "trigrams:512").select(
        "identity_text", rounded(total).alias("vec_sum"))


@query("u1_concat", """
  SELECT c_custkey AS id, c_name AS name, NULL::VARCHAR AS url FROM customer
  UNION ALL SELECT page_id, NULL, url FROM pages""")
def u1(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return readers.concat([people, pages])
