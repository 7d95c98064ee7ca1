"""Projections, predicates, pair features and vector arithmetic."""

from pyspark.sql import functions as F

from likeness.functions import normalize as nz
from likeness.functions import quality, similarity, vectors
from likeness.functions.encode import model_encoder, with_vectors
from likeness.functions.score import compared, feature_columns, rule_score
from likeness.plans import records
from likeness.plans.check import FIELDS
from likeness.plans.ingest import with_errors
from likeness.plans.loans import with_application_errors
from likeness.schemas import FEATURES
from likeness.sources.readers import resolve_aliases
from querybook.base import (
    DIGITS, applicants, as_of, customers, query, rounded, sql_cust, sql_fx, sql_vec, table)


def _normaliser(name, function, column, expression):
    @query(name, sql_fx(f"SELECT customer_id, {expression} AS value FROM fx"))
    def run(spark, sf_dir):
        return applicants(spark, sf_dir).select(
            "customer_id", function(F.col(column)).alias("value"))


_normaliser("p1_norm_name", nz.norm_name, "full_name", r"""
  trim(regexp_replace(regexp_replace(lower(coalesce(full_name, '')), '[^a-z\s]', ' ', 'g'),
       '\s+', ' ', 'g'))""")
_normaliser("p2_norm_email", nz.norm_email, "email", """
  CASE WHEN lower(trim(coalesce(email, ''))) LIKE '%@gmail.com'
       THEN replace(split_part(split_part(lower(trim(email)), '@', 1), '+', 1), '.', '')
            || '@gmail.com'
       ELSE lower(trim(coalesce(email, ''))) END""")
_normaliser("p3_norm_phone", nz.norm_phone_e164, "phone", r"""
  CASE WHEN length(regexp_replace(coalesce(phone, ''), '\D', '', 'g')) >= 10
       THEN '+' || regexp_replace(phone, '\D', '', 'g')
       ELSE regexp_replace(coalesce(phone, ''), '\D', '', 'g') END""")
_normaliser("p4_norm_govid", nz.norm_govid, "gov_id", "upper(trim(coalesce(gov_id, '')))")
_normaliser("p5_norm_postal_code", nz.norm_postal_code, "postal_code", """
  CASE WHEN regexp_full_match(replace(trim(postal_code), ' ', ''), '[1-9][0-9]{5}')
       THEN replace(trim(postal_code), ' ', '') ELSE '' END""")


@query("p6_identity_text", sql_cust("SELECT customer_id, identity_text FROM cust"))
def p6(spark, sf_dir):
    raw = applicants(spark, sf_dir)
    return raw.select("customer_id", nz.canonical_identity_text(
        *[F.col(c) for c in ("full_name", "dob", "phone", "email", "gov_id",
                             "addr_line", "city", "state", "postal_code")],
        nz.norm_country(F.col("country"))).alias("identity_text"))


@query("p7_query_object", sql_cust("""
  SELECT customer_id AS query_id, full_name, coalesce(dob, '') AS dob, phone_e164, email_norm,
         gov_id_norm, addr_line, city, state, postal_code, country FROM cust"""))
def p7(spark, sf_dir):
    raw = applicants(spark, sf_dir).withColumnRenamed("customer_id", "query_id")
    return records.query_object(raw, "query_id").fillna("", ["dob"])


@query("p8_customer_row", sql_vec(f"""
  SELECT c.customer_id, phone_e164, email_norm, gov_id_norm, postal_code, country,
         identity_text, round(list_sum(vec), {DIGITS}) AS vec_sum, len(vec) AS vec_width
  FROM cust c JOIN vecs v ON v.customer_id = c.customer_id"""))
def p8(spark, sf_dir):
    total = F.aggregate(
        "identity_vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return customers(spark, sf_dir).select(
        "customer_id", "phone_e164", "email_norm", "gov_id_norm", "postal_code", "country",
        "identity_text", rounded(total).alias("vec_sum"),
        F.size("identity_vec").cast("bigint").alias("vec_width"))


@query("p9_candidate_row", sql_cust("""
  SELECT customer_id, full_name, coalesce(dob, '') AS dob, phone_e164, email_norm, gov_id_norm,
         addr_line, city, state, postal_code FROM cust"""))
def p9(spark, sf_dir):
    return records.candidate_rows(customers(spark, sf_dir)).fillna("", ["dob"])


@query("p11_pair_query_columns", sql_cust("""
  SELECT customer_id, full_name AS query_full_name, coalesce(dob, '') AS query_dob,
         phone_e164 AS query_phone, email_norm AS query_email, gov_id_norm AS query_gov_id,
         addr_line AS query_addr, city AS query_city, state AS query_state,
         postal_code AS query_pc, country AS query_ctry FROM cust"""))
def p11(spark, sf_dir):
    return records.pair_query_columns(
        customers(spark, sf_dir), "customer_id").fillna("", ["query_dob"])


@query("p12_identity_text_backfill", sql_cust("SELECT customer_id, identity_text FROM cust"))
def p12(spark, sf_dir):
    without = customers(spark, sf_dir).drop("identity_text", "identity_vec")
    return records.with_identity_text(without).select("customer_id", "identity_text")


@query("p13_pair_query_object", sql_cust("""
  SELECT customer_id, coalesce(dob, '') AS dob, phone_e164, email_norm, gov_id_norm, postal_code,
         identity_text FROM cust"""))
def p13(spark, sf_dir):
    pairs = records.pair_query_columns(customers(spark, sf_dir), "customer_id")
    queries = records.pair_query_object(pairs, "customer_id")
    return queries.withColumn(
        "identity_text", records.identity_text(queries, normalised=False)
    ).fillna("", ["dob"]).select(
        "customer_id", "dob", "phone_e164", "email_norm", "gov_id_norm", "postal_code",
        "identity_text")


@query("p16_aliases", sql_fx("""
  SELECT customer_id, full_name, coalesce(dob, '') AS dob, gov_id, addr_line FROM fx"""))
def p16(spark, sf_dir):
    renamed = applicants(spark, sf_dir).withColumnsRenamed(
        {"dob": "date_of_birth", "gov_id": "government_id", "addr_line": "address_line"})
    return resolve_aliases(renamed).fillna("", ["dob"]).select(
        "customer_id", "full_name", "dob", "gov_id", "addr_line")


# -- predicates -------------------------------------------------------------------

def _check(name, condition, expression, view="fx"):
    @query(name, sql_fx(f"SELECT customer_id, {expression} AS ok FROM fx"))
    def run(spark, sf_dir):
        return applicants(spark, sf_dir).select("customer_id", condition().alias("ok"))


_check("f7_email_format", lambda: quality.valid_email(F.col("email")),
       r"coalesce(regexp_full_match(email, '[^\s@]+@[^\s@]+\.[^\s@]+'), false)")
_check("f8_phone_format", lambda: quality.valid_phone(F.regexp_replace("phone", "[- ]", "")),
       r"coalesce(regexp_full_match(regexp_replace(phone, '[- ]', '', 'g'), '\+[1-9]\d{1,14}'), false)")
_check("f9_postal_format", lambda: quality.valid_postal_code(F.col("postal_code")),
       r"coalesce(regexp_full_match(postal_code, '\d{6}'), false)")
_check("f10_date", lambda: quality.valid_date(F.col("dob")),
       "try_cast(dob AS DATE) IS NOT NULL")
_check("f11_birth_date", lambda: quality.valid_birth_date(F.col("dob"), F.to_date(F.lit("1990-06-30"))),
       "coalesce(try_cast(dob AS DATE) <= DATE '1990-06-30' AND year(try_cast(dob AS DATE)) > 1900, false)")


@query("f6_required_fields", sql_fx("""
  SELECT customer_id, concat_ws('; ',
    CASE WHEN trim(coalesce(dob, '')) = '' THEN 'Date of birth is required' END,
    CASE WHEN trim(coalesce(email, '')) = '' THEN 'Email is required' END,
    CASE WHEN trim(coalesce(gov_id, '')) = '' THEN 'Government ID is required' END,
    CASE WHEN NOT regexp_full_match(phone, '\\+[1-9]\\d{1,14}')
         THEN 'Please enter a valid E.164 phone number (e.g., +911234567890)' END,
    CASE WHEN NOT regexp_full_match(postal_code, '\\d{6}')
         THEN 'Please enter a valid 6-digit postal code' END
  ) AS errors FROM fx"""))
def f6(spark, sf_dir):
    return with_errors(applicants(spark, sf_dir)).select(
        "customer_id", F.array_join("dq_errors", "; ").alias("errors"))


@query("f12_amount", """
  SELECT o_orderkey, regexp_full_match(CAST(o_totalprice AS VARCHAR), '\\d+(\\.\\d{1,2})?')
         AND o_totalprice > 0 AS ok FROM orders""")
def f12(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", quality.valid_amount(
            F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("ok"))


@query("f13_domains", """
  SELECT o_orderkey, (CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved'
                      ELSE 'unknown' END) IN ('pending', 'approved', 'rejected') AS decision_ok,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'Gold Loan' ELSE o_orderpriority END IN (
           'Personal Loan', 'Home Loan', 'Car Loan', 'Business Loan', 'Education Loan',
           'Gold Loan') AS loan_type_ok
  FROM orders""")
def f13(spark, sf_dir):
    decision = (
        F.when(F.col("o_orderstatus") == "O", "pending")
        .when(F.col("o_orderstatus") == "F", "approved").otherwise("unknown"))
    loan_type = F.when(
        F.col("o_orderpriority") == "1-URGENT", "Gold Loan").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        quality.one_of(decision, quality.DECISIONS).alias("decision_ok"),
        quality.one_of(loan_type, quality.LOAN_TYPES).alias("loan_type_ok"))


@query("f14_vector_width", """
  SELECT vec_id, len(embedding) = 64 AS ok, len(embedding) = 512 AS ok_512 FROM embeddings""")
def f14(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", vectors.has_width(F.col("embedding"), 64).alias("ok"),
        vectors.has_width(F.col("embedding")).alias("ok_512"))


# -- pair features ----------------------------------------------------------------
# Each customer against the first of its group of five ids: the same person in two
# of five cases.

_SIDES = ["full_name", "dob", "phone_e164", "email_norm", "gov_id_norm",
          "addr_line", "city", "state", "postal_code", "identity_vec"]


def person_pairs(spark, sf_dir):
    table_ = customers(spark, sf_dir)
    q = table_.select(
        F.col("customer_id").alias("query_id"),
        (F.col("customer_id") - F.col("customer_id") % 5).alias("customer_id"),
        *[F.col(c).alias(f"q_{c}") for c in _SIDES])
    # Merged: by Spark's estimate of their size, vectors would be sent to every task.
    return q.join(table_.select("customer_id", *_SIDES).hint("merge"), "customer_id")


_PAIRS = """
pairs AS (
  SELECT q.customer_id AS query_id, c.customer_id, q.full_name AS q_name, c.full_name AS c_name,
         q.dob AS q_dob, c.dob AS c_dob, q.phone_e164 AS q_phone, c.phone_e164 AS c_phone,
         q.email_norm AS q_email, c.email_norm AS c_email, q.gov_id_norm AS q_gov,
         c.gov_id_norm AS c_gov, q.addr_line AS q_addr, c.addr_line AS c_addr,
         q.city AS q_city, c.city AS c_city, q.state AS q_state, c.state AS c_state,
         q.postal_code AS q_pc, c.postal_code AS c_pc
  FROM cust q JOIN cust c ON c.customer_id = q.customer_id - q.customer_id % 5)
"""

_FEATURES = """
feats AS (
  SELECT p.query_id, p.customer_id, vdist, 1 / (1 + vdist) AS vsim,
    CASE WHEN trim(q_name) = '' OR trim(c_name) = '' THEN 0.0
         ELSE jaro_winkler_similarity(trim(lower(q_name)), trim(lower(c_name))) END AS name_sim,
    CASE WHEN q_phone = c_phone AND q_phone <> '' THEN 1.0 ELSE 0.0 END AS phone_match,
    CASE WHEN q_email = c_email AND q_email <> '' THEN 1.0 ELSE 0.0 END AS email_match,
    CASE WHEN q_gov = c_gov AND q_gov <> '' THEN 1.0 ELSE 0.0 END AS govid_match,
    len(list_intersect(string_split_regex(trim(lower(q_addr)), '\\s+'),
                       string_split_regex(trim(lower(c_addr)), '\\s+')))
      / len(list_distinct(list_concat(string_split_regex(trim(lower(q_addr)), '\\s+'),
                                      string_split_regex(trim(lower(c_addr)), '\\s+')))) AS addr_overlap,
    jaro_winkler_similarity(lower(q_city), lower(c_city)) AS city_sim,
    jaro_winkler_similarity(lower(q_state), lower(c_state)) AS state_sim,
    CASE WHEN q_pc = '' OR c_pc = '' THEN 0.0 WHEN q_pc = c_pc THEN 1.0
         WHEN left(q_pc, 5) = left(c_pc, 5) THEN 0.5 ELSE 0.0 END AS pincode_match,
    coalesce(abs(date_diff('day', CAST(q_dob AS DATE), CAST(c_dob AS DATE)))::DOUBLE, 9999.0)
      AS dob_delta
  FROM pairs p JOIN {gaps} g ON g.query_id = p.query_id AND g.customer_id = p.customer_id)
"""

_GAPS = """
gaps AS (
  SELECT p.query_id, p.customer_id,
         greatest(list_cosine_distance(qv.vec, cv.vec), 0) AS vdist
  FROM pairs p JOIN vecs qv ON qv.customer_id = p.query_id
               JOIN vecs cv ON cv.customer_id = p.customer_id)
"""

_SCORED = """
scored AS (
  SELECT *, CASE WHEN govid_match >= 1 THEN 0.99::DOUBLE ELSE least(
      (0.4 * phone_match + 0.4 * email_match)::DOUBLE + 0.1::DOUBLE * vsim + 0.1::DOUBLE * name_sim
      + 0.05::DOUBLE * addr_overlap + 0.05::DOUBLE * city_sim + 0.03::DOUBLE * state_sim
      + (0.05 * pincode_match)::DOUBLE
      + CASE WHEN phone_match > 0 OR email_match > 0 OR name_sim > 0
             THEN CASE WHEN dob_delta < 30 THEN 0.1 WHEN dob_delta < 365 THEN 0.05 ELSE 0 END
             ELSE 0 END::DOUBLE, 0.99::DOUBLE) END AS score
  FROM feats)
"""


def features_sql(select, *more):
    return sql_vec(select, _PAIRS, _GAPS, feats_cte("gaps"), _SCORED, *more)


def feats_cte(gaps):
    return _FEATURES.format(gaps=gaps)


def _pair_feature(name, column, expression, alias=None):
    @query(name, sql_cust(f"SELECT query_id, customer_id, round(({expression})::DOUBLE, 6) AS value "
                          "FROM pairs", _PAIRS))
    def run(spark, sf_dir):
        return person_pairs(spark, sf_dir).select(
            "query_id", "customer_id", rounded(column()).alias("value"))


_pair_feature(
    "x2_jaro_winkler", lambda: similarity.jaro_winkler(F.col("q_full_name"), F.col("full_name")),
    "jaro_winkler_similarity(trim(lower(q_name)), trim(lower(c_name)))")
_pair_feature(
    "x3_exact_match", lambda: (
        similarity.exact_match(F.col("q_phone_e164"), F.col("phone_e164"))
        + 2 * similarity.exact_match(F.col("q_email_norm"), F.col("email_norm"))
        + 4 * similarity.exact_match(F.col("q_gov_id_norm"), F.col("gov_id_norm"))),
    """CASE WHEN q_phone = c_phone AND q_phone <> '' THEN 1 ELSE 0 END
       + CASE WHEN q_email = c_email AND q_email <> '' THEN 2 ELSE 0 END
       + CASE WHEN q_gov = c_gov AND q_gov <> '' THEN 4 ELSE 0 END""")
_pair_feature(
    "x4_addr_overlap", lambda: similarity.addr_overlap(F.col("q_addr_line"), F.col("addr_line")),
    r"""len(list_intersect(string_split_regex(lower(q_addr), '\s+'),
                           string_split_regex(lower(c_addr), '\s+')))
        / len(list_distinct(list_concat(string_split_regex(lower(q_addr), '\s+'),
                                        string_split_regex(lower(c_addr), '\s+'))))""")
_pair_feature(
    "x5_pincode_match",
    lambda: similarity.pincode_match(F.col("q_postal_code"), F.col("postal_code")),
    """CASE WHEN q_pc = '' OR c_pc = '' THEN 0 WHEN q_pc = c_pc THEN 1
            WHEN left(q_pc, 5) = left(c_pc, 5) THEN 0.5 ELSE 0 END""")
_pair_feature(
    "x6_dob_delta", lambda: similarity.dob_delta_days(F.col("q_dob"), F.col("dob")),
    "coalesce(abs(date_diff('day', CAST(q_dob AS DATE), CAST(c_dob AS DATE))), 9999)")


@query("u3_token_sets", sql_cust(r"""
  SELECT query_id, customer_id,
    len(list_intersect(string_split_regex(lower(q_addr), '\s+'),
                       string_split_regex(lower(c_addr), '\s+'))) AS shared,
    len(list_distinct(list_concat(string_split_regex(lower(q_addr), '\s+'),
                                  string_split_regex(lower(c_addr), '\s+')))) AS either
  FROM pairs""", _PAIRS))
def u3(spark, sf_dir):
    a, b = similarity.tokens(F.col("q_addr_line")), similarity.tokens(F.col("addr_line"))
    return person_pairs(spark, sf_dir).select(
        "query_id", "customer_id",
        F.size(F.array_intersect(a, b)).cast("bigint").alias("shared"),
        F.size(F.array_union(a, b)).cast("bigint").alias("either"))


@query("x4_document_overlap", r"""
  WITH t AS (SELECT doc_id, list_distinct(string_split_regex(
               regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+')) AS words
             FROM documents)
  SELECT a.doc_id, round(len(list_intersect(a.words, b.words))
         / len(list_distinct(list_concat(a.words, b.words))), 6) AS overlap
  FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def x4_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return docs.join(following, "doc_id").select(
        "doc_id", rounded(similarity.addr_overlap(F.col("text"), F.col("next"))).alias("overlap"))


def with_features(pairs, batched=False):
    vdist = vectors.cosine_distance(F.col("q_identity_vec"), F.col("identity_vec"))
    sides = pairs.select(
        "query_id", "customer_id", vdist.alias("vdist"),
        *compared({c: F.col(f"q_{c}") for c in FIELDS}, "q_"),
        *compared({c: F.col(c) for c in FIELDS}, "c_"))
    return sides.select(
        "query_id", "customer_id", "vdist",
        *feature_columns("q_", "c_", F.col("vdist"), batched))


@query("x1_vsim", features_sql("SELECT query_id, customer_id, round(vsim, 6) AS vsim FROM feats"))
def x1(spark, sf_dir):
    return with_features(person_pairs(spark, sf_dir)).select(
        "query_id", "customer_id", rounded("vsim").alias("vsim"))


_ROUNDED = ", ".join(f"round({f}::DOUBLE, 6) AS {f}" for f in FEATURES)


@query("x7_feature_row", features_sql(f"SELECT query_id, customer_id, {_ROUNDED} FROM feats"))
def x7(spark, sf_dir):
    return with_features(person_pairs(spark, sf_dir)).select(
        "query_id", "customer_id", *[rounded(f).alias(f) for f in FEATURES])


@query("x7_feature_row_batched", features_sql(
    f"SELECT query_id, customer_id, {_ROUNDED} FROM feats"))
def x7_batched(spark, sf_dir):
    return with_features(person_pairs(spark, sf_dir), batched=True).select(
        "query_id", "customer_id", *[rounded(f).alias(f) for f in FEATURES])


@query("m7_rule_score", features_sql(
    "SELECT query_id, customer_id, round(score, 6) AS score FROM scored"))
def m7(spark, sf_dir):
    return with_features(person_pairs(spark, sf_dir)).select(
        "query_id", "customer_id", rounded(rule_score()).alias("score"))


# -- vectors ----------------------------------------------------------------------

_HASHED = sql_vec("""
  SELECT customer_id, CAST(i - 1 AS INT) AS place, round(vec[i], 6) AS value
  FROM (SELECT customer_id, vec, unnest(range(1, 513)) AS i FROM vecs) v WHERE vec[i] > 0""")


def _places(encoded):
    # Outer: of a plain one Spark infers a filter by the size of the vectors, which it
    # computes in full for that where the table is read, in as many tasks as it has files.
    return encoded.select(
        "customer_id", F.posexplode_outer("identity_vec").alias("place", "value")
    ).filter(F.col("value") > 0).select(
        "customer_id", "place", rounded(F.col("value").cast("double")).alias("value"))


@query("m1_hashed_vector", _HASHED)
def m1(spark, sf_dir):
    texts = customers(spark, sf_dir).select("customer_id", "identity_text")
    return _places(texts.withColumn(
        "identity_vec", vectors.hashed_trigram_vector(F.col("identity_text"))))


@query("m1_hashed_vector_batched", _HASHED)
def m1_batched(spark, sf_dir):
    return _places(customers(spark, sf_dir))


@query("m2_fit_width", """
  SELECT vec_id, 96 AS wide, 32 AS narrow,
         round(list_sum(embedding::DOUBLE[]), 6) AS wide_sum,
         round(list_sum(embedding[1:32]::DOUBLE[]), 6) AS narrow_sum FROM embeddings""")
def m2(spark, sf_dir):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
    fitted = table(spark, sf_dir, "embeddings").select(
        "vec_id", vectors.fit_width(F.col("embedding"), 96).alias("w"),
        vectors.fit_width(F.col("embedding"), 32).alias("n"))
    return fitted.select(
        "vec_id", F.size("w").alias("wide"), F.size("n").alias("narrow"),
        rounded(total("w")).alias("wide_sum"), rounded(total("n")).alias("narrow_sum"))


@query("m3_l2_normalise", """
  SELECT vec_id, 1.0::DOUBLE AS length, round(CAST(embedding[1]::DOUBLE * 3
         / (3 * sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS DOUBLE), 5) AS first
  FROM embeddings""")
def m3(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: (x * 3).cast("float"))
    unit = table(spark, sf_dir, "embeddings").select(
        "vec_id", vectors.l2_normalise(scaled).alias("u"))
    return unit.select(
        "vec_id", F.round(vectors.norm(F.col("u")), 5).alias("length"),
        F.round(F.col("u")[0].cast("double"), 5).alias("first"))


@query("m4_stored_or_encoded", sql_vec("""
  SELECT v.customer_id, round(CASE WHEN c.gov_id_norm = '' THEN 1.0 ELSE list_sum(vec) END, 6)
         AS vec_sum FROM vecs v JOIN cust c ON c.customer_id = v.customer_id"""))
def m4(spark, sf_dir):
    first_axis = F.array(*[F.lit(1.0 if i == 0 else 0.0).cast("float") for i in range(512)])
    partly = customers(spark, sf_dir).withColumn(
        "identity_vec", F.when(F.col("gov_id_norm") == "", first_axis))
    total = F.aggregate("identity_vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return with_vectors(partly).select("customer_id", rounded(total).alias("vec_sum"))


def _neighbour_ids(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return t.join(after, "vec_id")


@query("m5_cosine_distance", """
  SELECT a.vec_id, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS gap
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def m5(spark, sf_dir):
    return _neighbour_ids(spark, sf_dir).select("vec_id", rounded(
        vectors.distance(F.col("embedding"), F.col("next"), "cosine")).alias("gap"))


@query("m6_euclidean_distance", """
  SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS gap
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def m6(spark, sf_dir):
    return _neighbour_ids(spark, sf_dir).select("vec_id", rounded(
        vectors.distance(F.col("embedding"), F.col("next"), "euclidean")).alias("gap"))


@query("v1_model_encoder", sql_cust("""
  SELECT customer_id, round(length(identity_text)::DOUBLE, 6) AS letters, 2 AS width FROM cust"""))
def v1(spark, sf_dir):
    def load():
        import numpy as np

        def encode(texts):
            lengths = np.array([len(t) for t in texts], dtype=np.float32)
            return np.stack([lengths, np.ones_like(lengths)], axis=1)
        return encode

    encoded = customers(spark, sf_dir).withColumn(
        "vec", model_encoder(load)(F.col("identity_text")))
    return encoded.select(
        "customer_id", rounded(F.col("vec")[0].cast("double")).alias("letters"),
        F.size("vec").alias("width"))


@query("f6_loan_fields", sql_fx("""
  SELECT CAST(o_orderkey AS VARCHAR) AS loan_application_id,
         concat_ws('; ',
           CASE WHEN trim(coalesce(dob, '')) = '' THEN 'Date of birth is required' END,
           CASE WHEN trim(coalesce(email, '')) = '' THEN 'Email is required' END,
           CASE WHEN trim(coalesce(gov_id, '')) = '' THEN 'Government ID is required' END,
           CASE WHEN NOT regexp_full_match(phone, '\\+[1-9]\\d{1,14}')
                THEN 'Please enter a valid E.164 phone number (e.g., +911234567890)' END,
           CASE WHEN NOT regexp_full_match(postal_code, '\\d{6}')
                THEN 'Please enter a valid 6-digit postal code' END,
           CASE WHEN o_orderstatus = 'P' THEN 'Branch code is required' END,
           CASE WHEN o_orderpriority <> '1-URGENT' THEN 'Please choose a listed loan type' END
         ) AS errors
  FROM orders JOIN fx ON fx.customer_id = o_custkey"""))
def f6_loans(spark, sf_dir):
    from querybook.jobs import applications
    return with_application_errors(applications(spark, sf_dir)).select(
        "loan_application_id", F.array_join("dq_errors", "; ").alias("errors"))
