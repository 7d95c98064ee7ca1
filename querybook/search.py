"""Similarity joins, duplicate pairs, shared keys and hard negatives."""

import uuid

from pyspark.sql import functions as F

from likeness.operators.clusters import (
    add_to_clusters, duplicate_pairs, duplicates_only, identity_clusters, kept_clusters)
from likeness.operators.keys import shared_key_pairs
from likeness.operators.neighbours import approximate_nearest, nearest
from likeness.plans.pairs import hard_negatives
from likeness.plans.records import pair_query_columns
from likeness.plans.train import pair_distances, pair_queries, unresolved_pairs
from likeness.sources.checkpoints import checkpoint_dir
from likeness.functions.encode import encode_texts
from likeness.sources.checkpoints import written
from querybook.base import applicants, customers, query, rounded, sql_cust, sql_fx, sql_vec, table


def stored_customers(spark, sf_dir):
    """The customers as a stored master, vectors computed once."""
    return written(customers(spark, sf_dir), "master")


def _embedding_sides(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    return (
        t.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")),
        t.select(F.col("vec_id").alias("customer_id"), F.col("embedding").alias("vec")))


def _rounded(found):
    return found.select(
        "query_id", "customer_id", F.col("rank").cast("bigint").alias("rank"),
        rounded("vdist").alias("vdist"))


def _topk_sql(k, distance):
    return f"""
  WITH d AS (
    SELECT q.vec_id AS query_id, c.vec_id AS customer_id,
           {distance}(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS vdist
    FROM embeddings q CROSS JOIN embeddings c)
  SELECT query_id, customer_id, round(vdist, 6) AS vdist,
         row_number() OVER (PARTITION BY query_id ORDER BY round(vdist, 9), customer_id) AS rank
  FROM d QUALIFY rank <= {k}"""


@query("j1_topk_exact", _topk_sql(10, "list_cosine_distance"))
def j1(spark, sf_dir):
    return _rounded(nearest(*_embedding_sides(spark, sf_dir), 10))


@query("j1_topk_exact_cells", _topk_sql(10, "list_cosine_distance"))
def j1_cells(spark, sf_dir):
    return _rounded(nearest(
        *_embedding_sides(spark, sf_dir), 10, broadcast_rows=0, block_rows=256))


@query("w7_nearest_euclidean", _topk_sql(2, "list_distance"))
def w7(spark, sf_dir):
    return _rounded(nearest(
        *_embedding_sides(spark, sf_dir), 2, "euclidean", broadcast_rows=0, block_rows=256))


def _identity_sides(master):
    return (
        master.select(F.col("customer_id").alias("query_id"), F.col("identity_vec").alias("vec")),
        master.select("customer_id", F.col("identity_vec").alias("vec")))


_NEAR = """
near AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(vdist, 9), customer_id) AS rank
  FROM dist QUALIFY rank <= 200)
"""


@query("w1_topk_identities", sql_vec(
    "SELECT query_id, customer_id, rank, round(vdist, 6) AS vdist FROM near", _NEAR))
def w1(spark, sf_dir):
    return _rounded(nearest(*_identity_sides(stored_customers(spark, sf_dir)), 200))


@query("j2_pair_distance", sql_vec("""
  SELECT p.customer_id AS query_id, b.customer_id AS cand_customer_id,
         round(list_cosine_distance(p.vec, b.vec), 6) AS vdist
  FROM vecs p JOIN vecs b ON b.customer_id = p.customer_id - p.customer_id % 5"""))
def j2(spark, sf_dir):
    master = stored_customers(spark, sf_dir)
    pairs = pair_query_columns(master, "customer_id").select(
        "*", (F.col("customer_id") - F.col("customer_id") % 5).alias("cand_customer_id"),
        F.col("customer_id").cast("int").alias("label"))
    encoded = encode_texts(pair_queries(pairs)).withColumnRenamed("identity_vec", "vec")
    return pair_distances(encoded, master).select(
        F.col("label").cast("bigint").alias("query_id"), "cand_customer_id",
        rounded("vdist").alias("vdist"))


@query("j2_unresolved", """
  SELECT o_orderkey AS cand_customer_id, count(*) AS pairs FROM orders
  WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_orderkey""")
def j2_unresolved(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cand_customer_id"))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    return unresolved_pairs(pairs, ids)


@query("a7_identity_clusters", sql_cust("""
  SELECT identity_text, min(customer_id) AS cluster_id, count(*) AS cluster_size
  FROM cust GROUP BY identity_text"""))
def a7(spark, sf_dir):
    return identity_clusters(customers(spark, sf_dir))


@query("a7_clusters_kept", sql_cust("""
  SELECT identity_text, min(customer_id) AS cluster_id, count(*) AS cluster_size
  FROM cust GROUP BY identity_text"""))
def a7_kept(spark, sf_dir):
    """The same, from batches added one after another."""
    path = f"{checkpoint_dir(spark)}/clusters-{uuid.uuid4().hex}"
    rows = customers(spark, sf_dir)
    for i in range(3):
        add_to_clusters(rows.filter(F.col("customer_id") % 3 == i), path, i)
    return kept_clusters(spark, path)


@query("f2_duplicates_only", sql_cust("""
  SELECT customer_id, min(customer_id) OVER (PARTITION BY identity_text) AS cluster_id,
         count(*) OVER (PARTITION BY identity_text) AS cluster_size
  FROM cust QUALIFY cluster_size > 1"""))
def f2(spark, sf_dir):
    return duplicates_only(customers(spark, sf_dir)).select(
        "customer_id", "cluster_id", "cluster_size")


_RING = """
  SELECT a.customer_id, b.customer_id AS cand_customer_id FROM ring a JOIN ring b
  ON a.key = b.key AND (b.place - a.place + a.n) % a.n BETWEEN 1 AND least(5, a.n - 1)"""


def _ring_cte(key, source):
    return f"""ring AS (
      SELECT customer_id, {key} AS key, count(*) OVER (PARTITION BY {key}) AS n,
             row_number() OVER (PARTITION BY {key}
                                ORDER BY md5(CAST(customer_id AS VARCHAR)), customer_id) AS place
      FROM {source})"""


@query("j3_duplicate_pairs", sql_cust("""
  SELECT a.customer_id, b.customer_id AS cand_customer_id FROM cust a JOIN cust b
  ON a.identity_text = b.identity_text AND a.customer_id <> b.customer_id"""))
def j3(spark, sf_dir):
    return duplicate_pairs(duplicates_only(customers(spark, sf_dir)), 5).select(
        "customer_id", "cand_customer_id")


@query("w3_capped_pairs", sql_fx(_RING, _ring_cte("addr_line", "fx")))
def w3(spark, sf_dir):
    members = duplicates_only(applicants(spark, sf_dir), "addr_line")
    return duplicate_pairs(members, 5, "addr_line").select("customer_id", "cand_customer_id")


@query("j3_document_copies",
       "WITH " + _ring_cte("text", "(SELECT doc_id AS customer_id, text FROM documents)") + _RING)
def j3_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("customer_id"), "text")
    return duplicate_pairs(duplicates_only(docs, "text"), 5, "text").select(
        "customer_id", "cand_customer_id")


NEGATIVES = """
members AS (SELECT *, count(*) OVER (PARTITION BY identity_text) AS n FROM cust),
negatives AS (
  SELECT q.customer_id, arg_min(c.customer_id, struct_pack(
           gap := round(list_distance(qv.vec, cv.vec), 9), id := c.customer_id)) AS cand_customer_id
  FROM members q JOIN vecs qv ON qv.customer_id = q.customer_id
  JOIN cust c ON c.identity_text <> q.identity_text
  JOIN vecs cv ON cv.customer_id = c.customer_id
  WHERE q.n > 1 GROUP BY q.customer_id)
"""


@query("j4_hard_negative", sql_vec(
    "SELECT customer_id, cand_customer_id FROM negatives", NEGATIVES))
def j4(spark, sf_dir):
    master = stored_customers(spark, sf_dir)
    return hard_negatives(duplicates_only(master), master)


@query("f5_hard_negative_cells", sql_vec(
    "SELECT customer_id, cand_customer_id FROM negatives", NEGATIVES))
def f5(spark, sf_dir):
    master = stored_customers(spark, sf_dir)
    return hard_negatives(
        duplicates_only(master), master, broadcast_rows=0, block_rows=256)


_KEYS = """
keys AS (
  SELECT customer_id, 'p:' || phone_e164 AS key FROM cust WHERE phone_e164 <> ''
  UNION ALL SELECT customer_id, 'e:' || email_norm FROM cust WHERE email_norm <> ''
  UNION ALL SELECT customer_id, 'g:' || gov_id_norm FROM cust WHERE gov_id_norm <> ''),
sized AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM keys)
"""


@query("j5_shared_keys", sql_cust("""
  SELECT DISTINCT a.customer_id AS query_id, b.customer_id FROM keys a JOIN keys b
  ON a.key = b.key""", _KEYS))
def j5(spark, sf_dir):
    return keyed(stored_customers(spark, sf_dir))


def keyed(master):
    return shared_key_pairs(master.withColumnRenamed("customer_id", "query_id"), master)


# Which side of planes through the mean a vector lies on; the planes are an md5's. Queries visit the
# buckets that they reach across the planes nearest to them.
BUCKETS = """
size AS (SELECT greatest(0, CAST(ceil(log2(count(*) / 128)) AS INT)) AS bits, count(*) AS n FROM cust),
planes AS (
  SELECT t, i, d, CASE WHEN substr(md5(t || ':' || i || ':' || d), 1, 1) < '8' THEN 1.0 ELSE -1.0 END::DOUBLE AS s
  FROM (SELECT t, d, unnest(range(bits)) AS i FROM size, range(8) a(t), range(512) b(d)) p),
means AS (SELECT b AS d, sum(x) / any_value(n) AS mean FROM sparse, size GROUP BY b),
shifts AS (SELECT t, i, sum(s * mean) AS shift FROM planes JOIN means USING (d) GROUP BY t, i),
margins AS (
  SELECT customer_id, t, i, round(p - shift, 9) AS margin
  FROM (SELECT customer_id, t, i, sum(x * s) AS p FROM sparse JOIN planes ON d = b
        GROUP BY customer_id, t, i) v JOIN shifts USING (t, i)),
buckets AS (
  SELECT customer_id, t, sum(CASE WHEN margin >= 0 THEN 1 << i ELSE 0 END)::BIGINT AS bucket
  FROM margins GROUP BY customer_id, t),
crossed AS (
  SELECT customer_id, t, mask, row_number() OVER (
    PARTITION BY customer_id, t ORDER BY round(cost, 9), mask) AS place
  FROM (SELECT customer_id, t, mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN margin * margin ELSE 0 END) AS cost
        FROM margins, (SELECT unnest(range(1 << bits)) AS mask FROM size) m GROUP BY customer_id, t, mask) c),
visited AS (
  SELECT customer_id, t, xor(bucket, mask) AS bucket
  FROM crossed JOIN buckets USING (customer_id, t), size WHERE place <= 1 + bits // 2),
meeting AS (
  SELECT DISTINCT a.customer_id AS query_id, b.customer_id FROM visited a JOIN buckets b
  ON a.t = b.t AND a.bucket = b.bucket)
"""


def hashed_near(k, name="near"):
    return f"""
{name} AS (
  SELECT query_id, customer_id, vdist, row_number() OVER (
           PARTITION BY query_id ORDER BY round(vdist, 9), customer_id) AS rank
  FROM dist JOIN meeting USING (query_id, customer_id) QUALIFY rank <= {k})"""


@query("j6_approximate_nearest", sql_vec(
    "SELECT query_id, customer_id, rank, round(vdist, 6) AS vdist FROM near",
    BUCKETS, hashed_near(10)))
def j6(spark, sf_dir):
    master = stored_customers(spark, sf_dir)
    return _rounded(approximate_nearest(*_identity_sides(master), 10))


@query("j6_recall", sql_vec("""
  SELECT count(*) AS neighbours, count(h.rank) AS found, count(h.rank) >= 0.95 * count(*) AS enough FROM (
    SELECT query_id, customer_id, row_number() OVER (
      PARTITION BY query_id ORDER BY round(vdist, 9), customer_id) AS rank
    FROM dist QUALIFY rank <= 2) e LEFT JOIN near h USING (query_id, customer_id)""",
    BUCKETS, hashed_near(2)))
def j6_recall(spark, sf_dir):
    sides = _identity_sides(stored_customers(spark, sf_dir))
    exact = nearest(*sides, 2).select("query_id", "customer_id")
    found = approximate_nearest(*sides, 2).select("query_id", "customer_id", "rank")
    return exact.join(found, ["query_id", "customer_id"], "left").agg(
        F.count("*").alias("neighbours"), F.count("rank").alias("found"),
        (F.count("rank") >= 0.95 * F.count("*")).alias("enough"))
