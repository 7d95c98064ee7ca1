"""Pair features assembled in order, and the scores over them."""

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions import similarity as sim
from likeness.schemas import FEATURES


def compared(side: Mapping[str, Column], prefix: str) -> list[Column]:
    """What the features compare of one record, computed once per record.

    Texts are folded, addresses split and dates parsed before records are paired,
    not again for each pair.
    """
    values = {
        "name": sim.text_key(side["full_name"]),
        "phone": side["phone_e164"],
        "email": side["email_norm"],
        "govid": side["gov_id_norm"],
        "tokens": sim.tokens(side["addr_line"]),
        "city": sim.text_key(side["city"]),
        "state": sim.text_key(side["state"]),
        "pin": sim.strip(sim.text(side["postal_code"])),
        "day": sim.parse_date(side["dob"]),
    }
    return [value.alias(f"{prefix}{name}") for name, value in values.items()]


def feature_columns(a: str, b: str, vdist: Column, batched: bool = False) -> list[Column]:
    """The ten features of a pair, named and in order.

    ``a`` and ``b`` are the prefixes of the two sides' :func:`compared` columns.
    ``batched`` computes the text similarities over Arrow batches.
    """
    text_sim = sim.key_similarity_batch if batched else sim.key_similarity

    def sides(name):
        return F.col(f"{a}{name}"), F.col(f"{b}{name}")

    values = {
        "vsim": 1.0 / (1.0 + vdist),
        "name_sim": text_sim(*sides("name")),
        "phone_match": sim.exact_match(*sides("phone")),
        "email_match": sim.exact_match(*sides("email")),
        "govid_match": sim.exact_match(*sides("govid")),
        "addr_overlap": sim.token_overlap(*sides("tokens")),
        "city_sim": text_sim(*sides("city")),
        "state_sim": text_sim(*sides("state")),
        "pincode_match": sim.same_area(*sides("pin")),
        "dob_delta": sim.day_gap(*sides("day")),
    }
    return [values[name].cast("double").alias(name) for name in FEATURES]


# Fixed values of the rule score: what a government id match gives, the most any
# score can be, the weight of each signal and the date bonuses.
GOVID_SCORE = 0.99
MAX_SCORE = 0.99
RULE_WEIGHTS = {
    "phone_match": 0.4,
    "email_match": 0.4,
    "vsim": 0.1,
    "name_sim": 0.1,
    "addr_overlap": 0.05,
    "city_sim": 0.05,
    "state_sim": 0.03,
    "pincode_match": 0.05,
}
DATE_BONUSES = [(30, 0.1), (365, 0.05)]


def rule_score() -> Column:
    """The score by rules over the feature columns."""
    weighted = sum(
        (F.col(name) * weight for name, weight in RULE_WEIGHTS.items()), F.lit(0.0))
    (near, near_bonus), (far, far_bonus) = DATE_BONUSES
    delta = F.col("dob_delta")
    named = (
        (F.col("phone_match") > 0) | (F.col("email_match") > 0) | (F.col("name_sim") > 0))
    bonus = (
        F.when(named & (delta < near), near_bonus)
        .when(named & (delta < far), far_bonus)
        .otherwise(0.0))
    return F.when(F.col("govid_match") >= 1, GOVID_SCORE).otherwise(
        F.least(weighted + bonus, F.lit(MAX_SCORE)))


def logistic_score(coefficients: Sequence[float], intercept: float) -> Column:
    """The positive-class probability of a linear model over the features."""
    margin = sum(
        (F.col(name) * float(w) for name, w in zip(FEATURES, coefficients)),
        F.lit(float(intercept)))
    return 1.0 / (1.0 + F.exp(-margin))


def rule_score_arrays(x: Mapping[str, np.ndarray]) -> np.ndarray:
    """The score by rules over arrays of the features."""
    total = sum(x[name] * weight for name, weight in RULE_WEIGHTS.items())
    named = (x["phone_match"] > 0) | (x["email_match"] > 0) | (x["name_sim"] > 0)
    (near, near_bonus), (far, far_bonus) = DATE_BONUSES
    bonus = np.where(x["dob_delta"] < near, near_bonus, np.where(x["dob_delta"] < far, far_bonus, 0.0))
    scored = np.minimum(total + np.where(named, bonus, 0.0), MAX_SCORE)
    return np.where(x["govid_match"] >= 1, GOVID_SCORE, scored)


def with_rule_score(features: DataFrame) -> DataFrame:
    """The scorer used when no trained model is at hand."""
    return features.withColumn("score", rule_score())


with_rule_score.arrays = rule_score_arrays
