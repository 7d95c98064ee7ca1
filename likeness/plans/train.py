"""Training the ranker: features of labelled pairs, and a logistic fit."""

import time
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.functions.encode import encode_texts
from likeness.functions.score import compared, feature_columns
from likeness.functions.vectors import distance, has_width
from likeness.plans.check import FIELDS
from likeness.plans.pairs import labelled_pairs, pair_source
from likeness.plans.records import candidate_rows, identity_text, pair_query_object
from likeness.schemas import FEATURES, MAX_PAIRS, NO_TRAINING_DATA, TRAINED, VECTOR_DIM
from likeness.sources.checkpoints import written
from likeness.sources.models import LinearRanker, Scorer, pipeline_scorer, save_ranker
from likeness.sources.readers import path_exists, read_table
from likeness.sources.vector_cache import cached_vectors

MAX_ITERATIONS = 1000


def pair_queries(pairs: DataFrame) -> DataFrame:
    """The query side of pairs, with its canonical text."""
    queries = pair_query_object(
        pairs, F.col("cand_customer_id").cast("bigint").alias("cand_customer_id"),
        F.col("label").cast("int").alias("label"))
    return queries.withColumn("identity_text", identity_text(queries, normalised=False))


def pair_distances(
    queries: DataFrame, customers: DataFrame, metric: str = "cosine"
) -> DataFrame:
    """Each pair with its distance and both sides' compared columns.

    ``queries`` have ``cand_customer_id`` and ``vec``. One equi-join takes the
    place of a lookup per pair; pairs whose candidate is unknown are left to
    :func:`unresolved_pairs`.
    """
    q = queries.select(
        "cand_customer_id", F.col("vec").alias("q_vec"),
        *compared({c: F.col(c) for c in FIELDS}, "q_"),
        *[c for c in ("label",) if c in queries.columns])
    candidates = candidate_rows(customers, "identity_vec")
    c = candidates.select(
        F.col("customer_id").alias("cand_customer_id"), "identity_vec",
        *compared({c: F.col(c) for c in FIELDS}, "c_"))
    return (
        q.join(c, "cand_customer_id")
        .withColumn("vdist", distance(F.col("q_vec"), F.col("identity_vec"), metric))
        .drop("q_vec", "identity_vec"))


def unresolved_pairs(pairs: DataFrame, customers: DataFrame) -> DataFrame:
    """Candidate ids of pairs that no customer has, with how often."""
    ids = customers.select(F.col("customer_id").alias("cand_customer_id"))
    return (
        pairs.select(F.col("cand_customer_id").cast("bigint").alias("cand_customer_id"))
        .join(ids, "cand_customer_id", "left_anti")
        .groupBy("cand_customer_id").agg(F.count("*").alias("pairs")))


def training_features(
    pairs: DataFrame,
    customers: DataFrame,
    *,
    metric: str = "cosine",
    dim: int = VECTOR_DIM,
    model: Callable[[Column], Column] | None = None,
    cache_path: str | None = None,
    model_name: str | None = None,
) -> DataFrame:
    """The ten features and the label of every pair, in one plan.

    Candidates with a vector of another width are no candidates. With a cache a model
    needs ``model_name``, under which its vectors are kept.
    """
    # Two steps read the pairs. Customers that no pair names go before their columns are made and shuffled.
    queries = written(pair_queries(pairs), "pairs")
    customers = customers.filter(has_width(F.col("identity_vec"), dim)).join(
        queries.select(F.col("cand_customer_id").alias("customer_id")).distinct(), "customer_id", "left_semi")
    if cache_path is None:
        encoded = encode_texts(queries, dim, model)
    else:
        if model is not None and model_name is None:
            raise ValueError("a cache of a model's vectors needs model_name")
        vectors = cached_vectors(
            queries, cache_path, lambda texts: encode_texts(texts, dim, model),
            f"{model_name or 'trigrams'}:{dim}")
        encoded = queries.join(vectors, "identity_text")
    joined = pair_distances(
        encoded.withColumnRenamed("identity_vec", "vec"), customers, metric)
    columns = feature_columns("q_", "c_", F.col("vdist"), batched=True)
    return joined.select(*columns, F.col("label").cast("int").alias("label"))


def class_weights(features: DataFrame) -> DataFrame:
    """Rows per label and the weight that balances the labels."""
    counts = features.groupBy("label").agg(F.count("*").alias("pairs"))
    total = counts.agg(F.sum("pairs").alias("total"), F.count("*").alias("classes")).first()
    return counts.withColumn("weight", F.lit(
        float(total["total"] or 0)) / (F.lit(total["classes"]) * F.col("pairs")))


def _weighted(features: DataFrame) -> tuple[DataFrame, dict[int, float], int]:
    # One row per label.
    rows = class_weights(features).collect()
    weights = {r["label"]: r["weight"] for r in rows}
    weight = F.lit(0.0)
    for label, w in weights.items():
        weight = F.when(F.col("label") == label, w).otherwise(weight)
    return (
        features.withColumn("weight", weight), weights, sum(r["pairs"] for r in rows))


def fit_mllib(features: DataFrame) -> PipelineModel | LinearRanker:
    """Balanced logistic regression by MLlib, its intercept not penalised."""
    weighted, weights, n = _weighted(features)
    if len(weights) < 2:
        return LinearRanker((0.0,) * len(FEATURES), 0.0, tuple(weights))
    # The balanced weights add up to the number of pairs.
    learner = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight",
        maxIter=MAX_ITERATIONS, regParam=1.0 / n, elasticNetParam=0.0,
        standardization=False)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return Pipeline(stages=[assembler, learner]).fit(weighted)


def fit_penalised(
    features: DataFrame, tolerance: float = 1e-8, max_steps: int = MAX_ITERATIONS
) -> LinearRanker:
    """The same fit with the intercept penalised like the other coefficients.

    Minimises half the squared length of all eleven coefficients plus the
    weighted log loss. Every Newton step is one aggregate of 78 sums over the
    features, which are all that reaches the driver. ``converged`` tells whether the
    gradient vanished, or no step improved the value within rounding.
    """
    weighted, weights, _ = _weighted(features)
    if len(weights) < 2:
        return LinearRanker((0.0,) * len(FEATURES), 0.0, tuple(weights))
    x = [*[F.col(c) for c in FEATURES], F.lit(1.0)]
    d = len(x)

    def sums(w):
        # As an array the coefficients stay out of the generated code, which is
        # then compiled for the first step only.
        products = F.zip_with(F.array(*x), F.lit([float(v) for v in w]), lambda a, b: a * b)
        margin = F.aggregate(products, F.lit(0.0), lambda total, p: total + p)
        at = weighted.withColumn("m", margin)
        # log(1 + exp(m)) and its derivatives, safe for margins of any size.
        tail = F.exp(-F.abs("m"))
        at = at.select(
            "*",
            (1.0 / (1.0 + F.exp(-F.col("m")))).alias("p"),
            (F.greatest("m", F.lit(0.0)) + F.log1p(tail)
             - F.col("label") * F.col("m")).alias("loss"))
        pull = F.col("weight") * (F.col("p") - F.col("label"))
        bend = F.col("weight") * F.col("p") * (1 - F.col("p"))
        row = at.agg(
            F.sum(F.col("weight") * F.col("loss")),
            *[F.sum(pull * c) for c in x],
            *[F.sum(bend * x[i] * x[j]) for i in range(d) for j in range(i + 1)]).first()
        gradient = np.array(row[1:d + 1]) + w
        hessian = np.zeros((d, d))
        hessian[np.tril_indices(d)] = row[d + 1:]
        hessian = hessian + np.tril(hessian, -1).T + np.eye(d)
        return row[0] + w @ w / 2, gradient, hessian

    w = np.zeros(d)
    value, gradient, hessian = sums(w)
    converged = False
    for _ in range(max_steps):
        if np.abs(gradient).max() <= tolerance * max(1.0, abs(value)):
            converged = True
            break
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while True:
            trial = w - size * step
            new_value, new_gradient, new_hessian = sums(trial)
            if new_value <= value or size < 1e-6:
                break
            size /= 2
        if new_value > value:
            break  # no step along this direction is better: the point stays
        stalled = value - new_value <= 1e-14 * abs(value)
        w, value, gradient, hessian = trial, new_value, new_gradient, new_hessian
        if stalled:
            converged = True
            break
    return LinearRanker(tuple(w[:-1]), float(w[-1]), converged=converged)


FITS = {"mllib": fit_mllib, "penalised": fit_penalised}


def as_scorer(model: PipelineModel | LinearRanker) -> Scorer:
    return pipeline_scorer(model) if isinstance(model, PipelineModel) else model


def accuracy(scored: DataFrame) -> DataFrame:
    """Pairs, and the share whose score falls on the side of their label."""
    right = (F.col("score") > 0.5).cast("int") == F.col("label")
    return scored.agg(
        F.count("*").alias("pairs_processed"),
        F.coalesce(F.avg(right.cast("double")), F.lit(0.0)).alias("accuracy"))


def train_ranker(
    spark: SparkSession,
    model_path: str,
    customers: DataFrame,
    *,
    pairs_path: str | None = None,
    max_pairs: int | None = MAX_PAIRS,
    fit: str = "penalised",
    metric: str = "cosine",
    dim: int = VECTOR_DIM,
    model: Callable[[Column], Column] | None = None,
    cache_path: str | None = None,
    model_name: str | None = None,
    **pair_options,
) -> dict:
    """Train on labelled pairs, or on pairs made from the customers; a report.

    A ``pairs_path`` that does not exist is reported, not raised.
    """
    start = time.monotonic()
    table = pair_source(customers, dim, model)
    if pairs_path is not None:
        if not path_exists(spark, pairs_path):
            return {"success": False, "message": f"{NO_TRAINING_DATA}: {pairs_path}"}
        pairs = read_table(spark, pairs_path)
    else:
        pairs = labelled_pairs(
            table, max_pairs=max_pairs, dim=dim, model=model, **pair_options)
    features = written(
        training_features(
            pairs, table, metric=metric, dim=dim, model=model, cache_path=cache_path,
            model_name=model_name),
        "features")
    fitted = FITS[fit](features)
    save_ranker(spark, fitted, model_path)
    result = accuracy(as_scorer(fitted)(features)).first()
    return {
        "success": True,
        "message": TRAINED,
        "training_id": f"{model_path.rstrip('/').rpartition('/')[2]}-{time.time_ns()}",
        "details": {
            "pairs_processed": result["pairs_processed"],
            "accuracy": result["accuracy"],
            "training_time": time.monotonic() - start,
        },
    }
