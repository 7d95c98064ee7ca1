"""The batch duplicate check: applicants against the customer master."""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions.score import compared, feature_columns, with_rule_score
from likeness.functions.vectors import has_width
from likeness.operators.blocks import BLOCK_ROWS, row_distances
from likeness.operators.keys import HOT_ROWS, KEYS, best_of_hot_keys, hot_keys, shared_key_pairs
from likeness.operators.neighbours import approximate_nearest, nearest
from likeness.operators.ranking import top_evidence, verdicts
from likeness.operators.rounds import numbered
from likeness.plans.records import candidate_rows, query_object, with_query_vectors
from likeness.schemas import EVIDENCE, RAW_FIELDS, THRESHOLD, TOP_K, VECTOR_DIM
from likeness.sources.checkpoints import checkpoint_dir, read_written, shuffles_dropped, written

Scorer = Callable[[DataFrame], DataFrame]

FIELDS = [
    "full_name", "dob", "phone_e164", "email_norm", "gov_id_norm",
    "addr_line", "city", "state", "postal_code",
]


# About how many of the nearest are joined with both sides' columns, scored and ranked at a time.
SCORED_PAIRS = 1 << 23


def split_by_width(
    df: DataFrame, dim: int = VECTOR_DIM, column: str = "identity_vec"
) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has the right width, and the others for quarantine."""
    good = has_width(F.col(column), dim)
    return df.filter(good), df.filter(~good)


METHODS = ("default", "keys", "exact")


def nearest_pairs(
    queries: DataFrame,
    master: DataFrame,
    method: str,
    k: int = TOP_K,
    metric: str = "cosine",
    exclude_self: bool = False,
    dim: int = VECTOR_DIM,
    **options,
) -> DataFrame:
    """(query_id, customer_id, vdist) of the ``k`` nearest customers of each query.

    ``exact`` compares all vectors, ``default`` those that share a hash bucket.
    """
    q = queries.withColumnRenamed("identity_vec", "vec")
    m = master.withColumnRenamed("identity_vec", "vec")
    own = ["cluster", "cluster_size"] if exclude_self else []
    if exclude_self:
        q = q.withColumn("cluster", F.col("query_id")).withColumn(
            "cluster_size", F.lit(1).cast("bigint"))
        m = m.withColumn("cluster", F.col("customer_id"))
    search = nearest if method == "exact" else approximate_nearest
    return search(
        q.select("query_id", "vec", *own), m.select("customer_id", "vec", *own[:1]),
        k, metric, dim=dim, **options).select("query_id", "customer_id", "vdist")


def with_distances(
    pairs: DataFrame, queries: DataFrame, master: DataFrame, metric: str = "cosine"
) -> DataFrame:
    """Pairs of ids with the distance of their vectors.

    Merged: by Spark's estimate of their size, vectors would be sent to every task.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    return (
        pairs.join(master.select("customer_id", F.col("identity_vec").alias("m_vec")).hint("merge"), "customer_id")
        .join(queries.select("query_id", F.col("identity_vec").alias("q_vec")).hint("merge"), "query_id")
        .select("query_id", "customer_id", "q_vec", "m_vec")
        .mapInArrow(row_distances(metric), f"query_id {kind}, customer_id bigint, vdist double"))


def _fields():
    return {c: F.col(c) for c in FIELDS}


def side_columns(df: DataFrame, id_column: str, prefix: str) -> DataFrame:
    """A record's id and what the features compare of it."""
    return df.select(id_column, *compared(_fields(), prefix))


def pair_features(
    pairs: DataFrame, queries: DataFrame, candidates: DataFrame, batched: bool = True
) -> DataFrame:
    """Pairs of ids with their ten features.

    The candidate's side joins first, so that the join by query leaves the pairs
    where the ranking by query needs them.
    """
    joined = (
        pairs.join(side_columns(candidates, "customer_id", "c_"), "customer_id")
        .join(side_columns(queries, "query_id", "q_"), "query_id"))
    return joined.select(
        *pairs.columns, *feature_columns("q_", "c_", F.col("vdist"), batched))


def scored_pairs(
    queries: DataFrame,
    master: DataFrame,
    scorer: Scorer = with_rule_score,
    *,
    method: str = "default",
    k: int = TOP_K,
    metric: str = "cosine",
    exclude_self: bool = False,
    evidence: int = EVIDENCE,
    dim: int = VECTOR_DIM,
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
    **options,
) -> DataFrame:
    """(query_id, customer_id, vdist, score) of all that can be among a query's best.

    ``keys``: customers that share a phone, e-mail address or government id; of a key that
    more than ``hot_rows`` hold, the ``evidence`` best by score. ``default``: these, and
    the ``k`` nearest by shared hash buckets. ``exact``: the ``k`` nearest customers.
    ``exclude_self`` is for a master checked against itself, where a query's id is its
    customer id.

    Customers with a vector of another width are no candidates; the queries have
    theirs from the encoder, at the right width.
    """
    found = _candidate_pairs(
        queries, master, scorer, method, k, metric, exclude_self, evidence, dim, hot_rows, block_rows, **options)
    return _score(*found, queries, candidate_rows(master), scorer)


def _candidate_pairs(
    queries, master, scorer, method, k, metric, exclude_self, evidence, dim, hot_rows, block_rows, **options,
):
    """Pairs that share a key, the nearest, and the scored pairs of hot keys; nothing for those that are not asked for."""
    if method not in METHODS:
        raise ValueError(f"unknown method '{method}'")
    master = master.filter(has_width(F.col("identity_vec"), dim))
    listed = near = hot_scored = None
    if method != "exact":
        hot = hot_keys(queries, master, hot_rows)
        crowded = not hot.isEmpty()
        listed = shared_key_pairs(queries, master, hot if crowded else None)
        if exclude_self:
            listed = listed.filter(F.col("query_id") != F.col("customer_id"))
        listed = with_distances(listed, queries, master, metric)
        if crowded:
            vec = F.col("identity_vec").alias("vec")
            keys = list(KEYS.values())
            hot_scored = best_of_hot_keys(
                queries.select("query_id", vec, *keys, *compared(_fields(), "q_")),
                candidate_rows(master, "identity_vec").select(
                    "customer_id", vec, *keys, *compared(_fields(), "c_")),
                hot, scorer, evidence, metric, exclude_self, block_rows)
    if method != "keys":
        near = nearest_pairs(
            queries, master, method, k, metric, exclude_self, dim, block_rows=block_rows, **options)
    return listed, near, hot_scored


def _score(listed, near, hot_scored, queries, candidates, scorer):
    ids = ["query_id", "customer_id"]
    pairs = listed if near is None else near
    if listed is not None and near is not None:
        pairs = listed.unionByName(near).groupBy(*ids).agg(F.min("vdist").alias("vdist"))
    scored = scorer(pair_features(pairs, queries, candidates)).select(
        *ids, "vdist", "score")
    if hot_scored is None:
        return scored
    # A pair may share a hot key and another one, or several parts of one.
    return scored.unionByName(hot_scored).groupBy(*ids).agg(
        F.min("vdist").alias("vdist"), F.max("score").alias("score"))


def best_scored(
    queries: DataFrame, master: DataFrame, scorer: Scorer = with_rule_score, *, evidence: int = EVIDENCE,
    method: str = "default", k: int = TOP_K, metric: str = "cosine", exclude_self: bool = False,
    dim: int = VECTOR_DIM, hot_rows: int = HOT_ROWS, block_rows: int = BLOCK_ROWS, **options,
) -> DataFrame:
    """Each query's ``evidence`` best of :func:`scored_pairs`, with their ``position``.

    More pairs than ``SCORED_PAIRS`` are scored some queries at a time, as every pair is
    shuffled with the columns of a customer; all pairs are scored either way.
    """
    search = (scorer, method, k, metric, exclude_self, evidence, dim, hot_rows, block_rows)
    rounds = 1 if method == "keys" else max(1, -(-queries.select("query_id").count() * k // SCORED_PAIRS))
    if rounds == 1:
        found = _candidate_pairs(queries, master, *search, **options)
        return top_evidence(_score(*found, queries, candidate_rows(master), scorer), evidence)
    spark = queries.sparkSession
    listed, near, hot_scored = _candidate_pairs(queries, master, *search, **options, stored=True)
    sides = [listed if listed is None else written(listed, "listed"), near,
             hot_scored if hot_scored is None else written(hot_scored, "hot_scored"), queries]
    folder, paths = f"{checkpoint_dir(spark)}/scored-{uuid.uuid4().hex}", []
    for number in range(rounds):
        def of_round(df):
            return df if df is None else numbered(df, rounds).filter(F.col("round") == number).drop("round")
        top = top_evidence(_score(*map(of_round, sides), candidate_rows(master), scorer), evidence)
        paths.append(f"{folder}/{number}")
        with shuffles_dropped(spark):
            top.write.parquet(paths[-1])
    return read_written(spark, paths, top.schema)


def evidence_rows(
    scored: DataFrame, master: DataFrame, evidence: int = EVIDENCE
) -> DataFrame:
    """Each query's best candidates with their customers' columns.

    These join last, for the few candidates that are shown.
    """
    top = top_evidence(scored.select("query_id", "customer_id", "vdist", "score"), evidence)
    return with_candidate_columns(top, master)


def with_candidate_columns(top: DataFrame, master: DataFrame) -> DataFrame:
    return top.join(candidate_rows(master), "customer_id")


def check_duplicates(
    applicants: DataFrame,
    master: DataFrame,
    scorer: Scorer = with_rule_score,
    *,
    threshold: float = THRESHOLD,
    evidence: int = EVIDENCE,
    dim: int = VECTOR_DIM,
    model: Callable[[Column], Column] | None = None,
    **search,
) -> DataFrame:
    """Raw applicants with ``query_id`` against the master: one verdict each.

    Equal applicants are checked once and share the verdict, so that copies cost
    no more than a join.
    """
    def prepared(asked, *keep):
        # Several steps read the queries; they are normalised and encoded once.
        return written(with_query_vectors(
            query_object(asked, "query_id", *keep), dim, model), "queries")

    def verdicts_of(queries):
        top = best_scored(queries, master, scorer, evidence=evidence, dim=dim, **search)
        return verdicts(queries, with_candidate_columns(top, master), threshold)

    if search.get("exclude_self"):
        return verdicts_of(prepared(applicants))
    record = F.md5(F.to_json(
        F.struct(*RAW_FIELDS), {"ignoreNullFields": "false"}).cast("binary"))
    asked = applicants.select("query_id", record.alias("record"), *RAW_FIELDS)
    # One shuffle, spread by number, not by size: a text is small, its vector is not.
    parts = int(applicants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = asked.select("record", *RAW_FIELDS).repartition(parts, "record").dropDuplicates(["record"])
    # Short ids for the pairs; they are fixed by the table they are written to.
    queries = prepared(
        once.withColumn("query_id", F.monotonically_increasing_id()), "record")
    found = queries.select("query_id", "record").join(verdicts_of(queries), "query_id")
    return asked.select("query_id", "record").join(found.drop("query_id"), "record").drop("record")
