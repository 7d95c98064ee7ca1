"""Statistics, ingest, pair generation, training, loans and notes."""

import uuid
from dataclasses import astuple

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from likeness.operators.notes import latest_notes, with_latest_note
from likeness.plans import stats as st
from likeness.plans.ingest import ingest
from likeness.plans.loans import check_loans, identity_part, loan_part, with_loan
from likeness.plans.pairs import labelled_pairs
from likeness.plans.records import pair_query_columns
from likeness.plans.train import accuracy, class_weights, fit_penalised, train_ranker, training_features
from likeness.schemas import FEATURES
from likeness.sources.checkpoints import checkpoint_dir, written
from likeness.sources.models import LinearRanker, load_scorer, save_ranker
from querybook.base import (
    AS_OF, applicants, as_of, customers, query, rounded, sql_cust, sql_fx, sql_vec, table)
from querybook.checks import RANKED, _SIDES
from querybook.scalars import (
    _GAPS, _SCORED, feats_cte, features_sql, person_pairs, with_features)
from querybook.search import NEGATIVES, stored_customers

# -- statistics -------------------------------------------------------------------

_IDS = "(SELECT gov_id_norm, count(*) AS n FROM cust WHERE gov_id_norm <> '' GROUP BY 1) g"


@query("a1_total_customers", sql_cust("SELECT count(*) AS total_applicants FROM cust"))
def a1(spark, sf_dir):
    return st.total_customers(customers(spark, sf_dir))


@query("a2_created_today", sql_cust(
    f"SELECT count(*) AS today_applicants FROM cust WHERE created_on = DATE '{AS_OF}'"))
def a2(spark, sf_dir):
    return st.created_today(customers(spark, sf_dir), as_of())


@query("a3_duplicate_alerts", sql_cust(
    f"SELECT count(*) AS duplicate_alerts FROM {_IDS} WHERE n > 1"))
def a3(spark, sf_dir):
    return st.stats(customers(spark, sf_dir), as_of()).select("duplicate_alerts")


@query("a4_high_risk", sql_cust(
    f"SELECT count(*) AS high_risk_duplicates FROM {_IDS} WHERE n >= 5"))
def a4(spark, sf_dir):
    return st.stats(customers(spark, sf_dir), as_of()).select("high_risk_duplicates")


@query("a5_processing_rate", sql_cust(f"""
  SELECT round(count(*) FILTER (created_on = DATE '{AS_OF}') / count(*) * 100, 1)
         AS processing_rate FROM cust"""))
def a5(spark, sf_dir):
    return st.daily_rate(customers(spark, sf_dir), as_of())


_STATS = f"""
  SELECT (SELECT count(*) FROM cust) AS total_applicants,
         (SELECT count(*) FROM cust WHERE created_on = DATE '{AS_OF}') AS today_applicants,
         (SELECT count(*) FROM {_IDS} WHERE n > 1) AS duplicate_alerts,
         (SELECT count(*) FROM {_IDS} WHERE n >= 5) AS high_risk_duplicates,
         (SELECT round(count(*) FILTER (created_on = DATE '{AS_OF}') / count(*) * 100, 1)
          FROM cust) AS processing_rate"""


@query("a6_stats_row", sql_cust(_STATS))
def a6(spark, sf_dir):
    return st.stats(customers(spark, sf_dir), as_of())


@query("e5_stats_report", sql_cust(_STATS))
def e5(spark, sf_dir):
    return st.stats(stored_customers(spark, sf_dir), as_of())


@query("f3_repeated_ids", sql_cust("""
  SELECT gov_id_norm, count(*) AS holders FROM cust WHERE gov_id_norm <> ''
  GROUP BY gov_id_norm HAVING count(*) > 1"""))
def f3(spark, sf_dir):
    return st.repeated_ids(customers(spark, sf_dir))


@query("f4_created_on_day", sql_cust(
    f"SELECT customer_id FROM cust WHERE created_on = DATE '{AS_OF}'"))
def f4(spark, sf_dir):
    return st.created_on_day(customers(spark, sf_dir), as_of()).select("customer_id")


# -- ingest -----------------------------------------------------------------------

def _new_path(spark, name):
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}/{name}"


@query("e2_ingest", sql_vec("""
  SELECT row_number() OVER (ORDER BY c.customer_id) AS customer_id, full_name,
         coalesce(dob, '') AS dob, phone_e164, email_norm, gov_id_norm, postal_code, country,
         identity_text, CAST(created_on AS VARCHAR) AS created_on,
         round(list_sum(vec), 6) AS vec_sum
  FROM cust c JOIN vecs v ON v.customer_id = c.customer_id"""))
def e2(spark, sf_dir):
    raw = applicants(spark, sf_dir).select(
        "*", F.col("created_on").cast("timestamp").alias("created_at")).drop("created_on")
    loaded, _ = ingest(
        raw, _new_path(spark, "master"), "bulk", F.to_timestamp(F.lit(AS_OF)),
        order=["customer_id"])
    total = F.aggregate("identity_vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return loaded.select(
        "customer_id", "full_name",
        F.coalesce(F.col("dob").cast("string"), F.lit("")).alias("dob"), "phone_e164",
        "email_norm", "gov_id_norm", "postal_code", "country", "identity_text",
        F.col("created_on").cast("string").alias("created_on"), rounded(total).alias("vec_sum"))


# -- training pairs ---------------------------------------------------------------

_RING = """
ring AS (
  SELECT customer_id, identity_text, count(*) OVER (PARTITION BY identity_text) AS n,
         row_number() OVER (PARTITION BY identity_text
                            ORDER BY md5(CAST(customer_id AS VARCHAR)), customer_id) AS place
  FROM cust),
labelled AS (
  SELECT a.customer_id, a.identity_text, b.customer_id AS cand_customer_id, 1 AS label
  FROM ring a JOIN ring b ON a.identity_text = b.identity_text
   AND (b.place - a.place + a.n) % a.n BETWEEN 1 AND least(5, a.n - 1)
  UNION ALL
  SELECT g.customer_id, c.identity_text, g.cand_customer_id, 0 AS label
  FROM negatives g JOIN cust c ON c.customer_id = g.customer_id)
"""

_PAIR_COLUMNS = """
  full_name AS query_full_name, coalesce(dob, '') AS query_dob, phone_e164 AS query_phone,
  email_norm AS query_email, gov_id_norm AS query_gov_id, addr_line AS query_addr,
  city AS query_city, state AS query_state, postal_code AS query_pc, country AS query_ctry,
  cand_customer_id, label FROM labelled l JOIN cust c ON c.customer_id = l.customer_id"""


@query("e3_labelled_pairs", sql_vec("SELECT" + _PAIR_COLUMNS, NEGATIVES, _RING))
def e3(spark, sf_dir):
    return labelled_pairs(stored_customers(spark, sf_dir)).fillna("", ["query_dob"])


@query("u2_positives_and_negatives", sql_vec(
    "SELECT label, count(*) AS pairs, count(DISTINCT cand_customer_id) AS candidates "
    "FROM labelled GROUP BY label", NEGATIVES, _RING))
def u2(spark, sf_dir):
    return labelled_pairs(stored_customers(spark, sf_dir)).groupBy("label").agg(
        F.count("*").alias("pairs"), F.countDistinct("cand_customer_id").alias("candidates"))


@query("w4_first_pairs", sql_vec(
    "SELECT" + _PAIR_COLUMNS + """
  ORDER BY l.identity_text, l.customer_id, label DESC, cand_customer_id LIMIT 500""",
    NEGATIVES, _RING))
def w4(spark, sf_dir):
    return labelled_pairs(
        stored_customers(spark, sf_dir), max_pairs=500).fillna("", ["query_dob"])


@query("e3_with_bad_vectors", sql_vec(
    "SELECT label, count(*) AS pairs FROM labelled GROUP BY label",
    NEGATIVES.replace("FROM cust),", "FROM good),").replace("JOIN cust c ON c.identity_text", "JOIN good c ON c.identity_text"),
    _RING.replace("FROM cust),", "FROM good),"),
).replace("members AS (", "good AS (SELECT * FROM cust WHERE customer_id % 7 <> 3),\nmembers AS ("))
def e3_bad(spark, sf_dir):
    """Customers with a vector of another width take no part, and stop nothing."""
    master = stored_customers(spark, sf_dir).withColumn("identity_vec", F.when(
        F.col("customer_id") % 7 == 3, F.slice("identity_vec", 1, 100)).otherwise(F.col("identity_vec")))
    return labelled_pairs(master).groupBy("label").agg(F.count("*").alias("pairs"))


# -- training ---------------------------------------------------------------------
# Every customer with the first of its group of five ids, labelled 1 when both are
# the same person.

_LABEL = "CASE WHEN query_id % 5 IN (0, 1, 2) THEN 1 ELSE 0 END"


def labelled_person_pairs(spark, sf_dir):
    master = stored_customers(spark, sf_dir)
    own = F.col("customer_id") % 5
    pairs = pair_query_columns(master, "customer_id").select(
        "*", (F.col("customer_id") - own).alias("cand_customer_id"),
        F.when(own.isin(0, 1, 2), 1).otherwise(0).alias("label"))
    return pairs, master


_ROUNDED = ", ".join(f"round({f}::DOUBLE, 6) AS {f}" for f in FEATURES)


@query("m10_training_features", features_sql(f"SELECT {_ROUNDED}, {_LABEL} AS label FROM feats"))
def m10(spark, sf_dir):
    return training_features(*labelled_person_pairs(spark, sf_dir)).select(
        *[rounded(f).alias(f) for f in FEATURES], "label")


@query("a8_class_weights", sql_fx("""
  SELECT label, count(*) AS pairs, round(sum(count(*)) OVER () / (2 * count(*)), 6) AS weight
  FROM (SELECT CASE WHEN customer_id % 5 IN (0, 1, 2) THEN 1 ELSE 0 END AS label FROM fx) p
  GROUP BY label"""))
def a8(spark, sf_dir):
    pairs, _ = labelled_person_pairs(spark, sf_dir)
    return class_weights(pairs).select("label", "pairs", rounded("weight").alias("weight"))


def _labelled_scores(spark, sf_dir):
    label = F.when((F.col("query_id") % 5).isin(0, 1, 2), 1).otherwise(0)
    return with_features(person_pairs(spark, sf_dir)).withColumn("label", label)


@query("a9_accuracy", features_sql(f"""
  SELECT count(*) AS pairs_processed,
         round(avg(CASE WHEN (score > 0.5) = ({_LABEL} = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
  FROM scored"""))
def a9(spark, sf_dir):
    scored = load_scorer(spark, _new_path(spark, "no-model"))(_labelled_scores(spark, sf_dir))
    return accuracy(scored).select("pairs_processed", rounded("accuracy").alias("accuracy"))


_WEIGHTS = [1.5, 2.0, 3.0, 2.5, 4.0, 0.5, 0.25, 0.125, 0.75, -0.001]


@query("m9_positive_probability", features_sql(
    "SELECT query_id, customer_id, round(1 / (1 + exp(-("
    + " + ".join(f"{w}::DOUBLE * {f}" for f, w in zip(FEATURES, _WEIGHTS))
    + " - 6.0::DOUBLE))), 6) AS score FROM feats"))
def m9(spark, sf_dir):
    model = LinearRanker(tuple(_WEIGHTS), -6.0)
    return model(_labelled_scores(spark, sf_dir)).select(
        "query_id", "customer_id", rounded("score").alias("score"))


def _trained(spark, sf_dir, fit):
    pairs, master = labelled_person_pairs(spark, sf_dir)
    pairs_path, model_path = _new_path(spark, "pairs.parquet"), _new_path(spark, "model")
    pairs.write.parquet(pairs_path)
    report = train_ranker(spark, model_path, master, pairs_path=pairs_path, fit=fit)
    return report, model_path


def _gap(scored, coefficients, intercept):
    """How far the gradient of the penalised loss is from zero, relative to its terms.

    ``intercept`` is what the penalty adds to the intercept's sum: itself or nothing.
    """
    pull = F.col("weight") * (F.col("score") - F.col("label"))
    x = [*map(F.col, FEATURES), F.lit(1.0)]
    sums = [F.sum(pull * c) + float(b) for c, b in zip(x, [*coefficients, intercept])]
    scale = [F.sum(F.abs(pull * c)) + 1 for c in x]
    return F.greatest(*[F.abs(s) / n for s, n in zip(sums, scale)])


def _weighted_scores(features, scorer):
    return scorer(features).join(class_weights(features).select("label", "weight"), "label")


def _fitted(spark, sf_dir, fit, of_model, tolerance):
    """Of a model trained, stored and read again: the pairs of each label, and whether it is the optimum."""
    report, path = _trained(spark, sf_dir, fit)
    features = written(training_features(*labelled_person_pairs(spark, sf_dir)), "features")
    scored = written(_weighted_scores(features, load_scorer(spark, path)), "scored")
    coefficients, intercept = of_model(path)
    whole = scored.agg(_gap(scored, coefficients, intercept).alias("gap")).first()
    counted = accuracy(scored).first()["accuracy"]
    mean = F.avg("score")
    return scored.groupBy("label").agg(
        F.count("*").alias("pairs"), F.bool_and(F.col("score").between(0, 1)).alias("in_range"),
        F.lit(whole["gap"] < tolerance).alias("at_optimum"),
        F.lit(abs(report["details"]["accuracy"] - counted) < 1e-9).alias("accuracy_reported"),
        F.when(F.col("label") == 1, mean > 0.5).otherwise(mean < 0.5).alias("on_its_side"))


_BY_LABEL = f"""
  SELECT {_LABEL} AS label, count(*) AS pairs, true AS in_range, true AS at_optimum,
         true AS accuracy_reported, true AS on_its_side FROM feats GROUP BY 1"""


@query("m8_trained_scores_mllib", features_sql(_BY_LABEL))
def m8(spark, sf_dir):
    # The intercept is not penalised.
    return _fitted(spark, sf_dir, "mllib", lambda path: (PipelineModel.load(path).stages[-1].coefficients, 0.0), 1e-3)


@query("m8_trained_scores", features_sql(_BY_LABEL))
def m8_penalised(spark, sf_dir):
    return _fitted(spark, sf_dir, "penalised", lambda path: astuple(load_scorer(spark, path))[:2], 1e-5)


@query("m8_optimum", features_sql(f"""
  SELECT count(*) AS pairs, count(*) FILTER ({_LABEL} = 1) AS positives, true AS converged,
         true AS at_optimum FROM feats"""))
def m8_optimum(spark, sf_dir):
    """The gradient at the fitted weights, summed by SQL apart from the fit, is zero."""
    features = written(training_features(*labelled_person_pairs(spark, sf_dir)), "features")
    model = fit_penalised(features)
    at = _weighted_scores(features, model)
    return at.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("label") == 1).alias("positives"),
        F.lit(model.converged).alias("converged"),
        _gap(at, model.coefficients, model.intercept).alias("gap")).select(
            "pairs", "positives", "converged", (F.col("gap") < 1e-5).alias("at_optimum"))


@query("e4_train_report", sql_vec(
    "SELECT true AS success, 'Model trained successfully' AS message, "
    "least(count(*), 3000) AS pairs_processed, true AS accuracy_reported, true AS accurate FROM labelled",
    NEGATIVES, _RING))
def e4(spark, sf_dir):
    """With the accuracy, counted again from the stored model over the pairs made anew, and its floor."""
    path, master = _new_path(spark, "model"), stored_customers(spark, sf_dir)
    report = train_ranker(spark, path, master, max_pairs=3000)
    details = report["details"]
    features = training_features(labelled_pairs(master, max_pairs=3000), master)
    counted = accuracy(load_scorer(spark, path)(features)).first()["accuracy"]
    return spark.createDataFrame(
        [(report["success"], report["message"], details["pairs_processed"],
          abs(details["accuracy"] - counted) < 1e-9, details["accuracy"] >= 0.95)],
        "success boolean, message string, pairs_processed bigint, accuracy_reported boolean, accurate boolean")


@query("s15_missing_training_data", """
  SELECT false AS success, 'Training data not found' AS message, count(*) AS customers FROM customer""")
def s15(spark, sf_dir):
    master = stored_customers(spark, sf_dir)
    report = train_ranker(
        spark, _new_path(spark, "model"), master, pairs_path=_new_path(spark, "no-pairs.csv"))
    return master.agg(F.count("*").alias("customers")).select(
        F.lit(report["success"]).alias("success"),
        F.lit(report["message"].split(":")[0]).alias("message"), "customers")


@query("s13_stored_model", features_sql(
    "SELECT query_id, customer_id, round(1 / (1 + exp(-("
    + " + ".join(f"{w}::DOUBLE * {f}" for f, w in zip(FEATURES, _WEIGHTS))
    + " - 6.0::DOUBLE))), 6) AS score FROM feats"))
def s13(spark, sf_dir):
    path = _new_path(spark, "ranker")
    save_ranker(spark, LinearRanker(tuple(_WEIGHTS), -6.0), path)
    return load_scorer(spark, path)(_labelled_scores(spark, sf_dir)).select(
        "query_id", "customer_id", rounded("score").alias("score"))


# -- loans and notes --------------------------------------------------------------

def applications(spark, sf_dir):
    """Orders as loan applications of their customer."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("ACC"), F.col("o_custkey").cast("string")).alias("account_number"),
        F.col("o_orderkey").cast("string").alias("loan_application_id"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("requested_amount"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Gold Loan")
        .otherwise(F.col("o_orderpriority")).alias("loan_type"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
        .alias("branch_code"),
    ).join(applicants(spark, sf_dir).drop("created_on"), "customer_id").drop("customer_id")


@query("p14_identity_part", sql_fx("""
  SELECT CAST(o_orderkey AS VARCHAR) AS query_id, full_name, coalesce(dob, '') AS dob, phone,
         gov_id, addr_line, city FROM orders JOIN fx ON fx.customer_id = o_custkey"""))
def p14(spark, sf_dir):
    return identity_part(applications(spark, sf_dir)).fillna("", ["dob"]).select(
        "query_id", "full_name", "dob", "phone", "gov_id", "addr_line", "city")


@query("p14_loan_part", sql_fx("""
  SELECT CAST(o_orderkey AS VARCHAR) AS loan_application_id, 'ACC' || o_custkey AS account_number,
         CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS requested_amount,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'Gold Loan' ELSE o_orderpriority END
           AS loan_type,
         CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS branch_code
  FROM orders JOIN fx ON fx.customer_id = o_custkey"""))
def p14_loan(spark, sf_dir):
    return loan_part(applications(spark, sf_dir))


def compliance_notes(spark, sf_dir):
    """Events as compliance notes on the application of their user's number."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("applicant_id"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("note"),
        F.col("event_type").alias("officer"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(F.col("value") > 20, "approved").when(F.col("value") > 10, "rejected")
        .otherwise("pending").alias("decision"))


_NOTES = """
notes AS (
  SELECT CAST(user_id AS VARCHAR) AS applicant_id, 'event ' || event_id AS note,
         event_type AS officer, epoch_us(ts) AS at,
         CASE WHEN value > 20 THEN 'approved' WHEN value > 10 THEN 'rejected'
              ELSE 'pending' END AS decision
  FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id
    ORDER BY ts DESC, decision DESC, note DESC, officer DESC) = 1)"""


@query("w5_latest_notes", f"WITH {_NOTES} SELECT * FROM notes")
def w5(spark, sf_dir):
    return latest_notes(compliance_notes(spark, sf_dir)).select(
        "applicant_id", "note", "officer", F.unix_micros("timestamp").alias("at"), "decision")


@query("j8_note_lookup", f"""WITH {_NOTES}
  SELECT CAST(o_orderkey AS VARCHAR) AS loan_application_id,
         coalesce(note, 'none') AS note, coalesce(decision, 'none') AS decision
  FROM orders LEFT JOIN notes ON applicant_id = CAST(o_orderkey AS VARCHAR)""")
def j8(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("loan_application_id"))
    return with_latest_note(asked, compliance_notes(spark, sf_dir)).select(
        "loan_application_id", F.coalesce("note", F.lit("none")).alias("note"),
        F.coalesce("decision", F.lit("none")).alias("decision"))


@query("j7_verdict_with_loan", sql_cust("""
  SELECT CAST(o_orderkey AS VARCHAR) AS loan_application_id, gov_id_norm <> '' AS is_duplicate,
         CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS requested_amount
  FROM orders JOIN cust ON customer_id = o_custkey"""))
def j7(spark, sf_dir):
    verdicts = applications(spark, sf_dir).select(
        F.col("loan_application_id").alias("query_id"),
        (F.col("gov_id") != "").alias("is_duplicate"))
    return with_loan(verdicts, loan_part(applications(spark, sf_dir))).select(
        "loan_application_id", "is_duplicate", "requested_amount")


_LOAN_NEAR = """
near AS (
  SELECT DISTINCT a.customer_id AS query_id, b.customer_id FROM cust a JOIN cust b
  ON (a.phone_e164 = b.phone_e164 AND a.phone_e164 <> '')
  OR (a.email_norm = b.email_norm AND a.email_norm <> '')
  OR (a.gov_id_norm = b.gov_id_norm AND a.gov_id_norm <> '')),
""" + "pairs AS (" + _SIDES.format(near="near") + ")"


@query("e6_loan_check", sql_vec("""
  SELECT CAST(o_orderkey AS VARCHAR) AS loan_application_id, r.score >= 0.82 AS is_duplicate,
         printf('%.1f%%', r.score * 100) AS score_text,
         CASE WHEN r.score >= 0.82 THEN 'high' ELSE 'low' END AS risk,
         r.customer_id AS best_customer_id,
         CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS requested_amount,
         coalesce(decision, 'none') AS decision
  FROM orders JOIN ranked r ON r.query_id = o_custkey AND r.position = 1
  LEFT JOIN notes ON applicant_id = CAST(o_orderkey AS VARCHAR)""",
    _LOAN_NEAR, _GAPS, feats_cte("gaps"), _SCORED, RANKED, _NOTES))
def e6(spark, sf_dir):
    checked = check_loans(
        applications(spark, sf_dir), stored_customers(spark, sf_dir),
        compliance_notes(spark, sf_dir), method="keys")
    return checked.select(
        "loan_application_id", "is_duplicate", "score_text", "risk",
        F.col("best_match.customer_id").alias("best_customer_id"), "requested_amount",
        F.coalesce("decision", F.lit("none")).alias("decision"))
