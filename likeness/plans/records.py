"""Raw applicants to query objects and to customer rows."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions import normalize as nz
from likeness.functions.encode import with_vectors
from likeness.schemas import PAIR_QUERY_FIELDS, VECTOR_DIM

# Columns of a normalised identity, in the order of the canonical text.
IDENTITY = list(PAIR_QUERY_FIELDS)


def query_object(applicants: DataFrame, *keep: str) -> DataFrame:
    """Normalised applicants, the date as ISO text; ``keep`` passes through."""
    return applicants.select(
        *keep,
        "full_name",
        F.col("dob").cast("string").alias("dob"),
        nz.norm_phone_e164(F.col("phone")).alias("phone_e164"),
        nz.norm_email(F.col("email")).alias("email_norm"),
        nz.norm_govid(F.col("gov_id")).alias("gov_id_norm"),
        "addr_line", "city", "state",
        nz.norm_postal_code(F.col("postal_code")).alias("postal_code"),
        nz.norm_country(F.col("country")).alias("country"))


def identity_text(df: DataFrame, normalised: bool = True) -> Column:
    """The canonical text of rows with the columns of a query object."""
    return nz.canonical_identity_text(
        *[F.col(c) if c in df.columns else F.lit(None).cast("string") for c in IDENTITY],
        normalised=normalised)


def with_identity_text(df: DataFrame) -> DataFrame:
    """Fill the canonical text where it is absent, dates as ISO text."""
    made = identity_text(
        df.withColumn("dob", nz.iso_date(F.col("dob"))) if "dob" in df.columns else df,
        normalised=False)
    if "identity_text" in df.columns:
        return df.withColumn("identity_text", F.coalesce(F.col("identity_text"), made))
    return df.withColumn("identity_text", made)


def with_query_vectors(
    queries: DataFrame,
    dim: int = VECTOR_DIM,
    model: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Query objects with their canonical text and vector."""
    return with_vectors(
        queries.withColumn("identity_text", identity_text(queries)), dim, model)


def customer_rows(
    applicants: DataFrame,
    *keep: str,
    dim: int = VECTOR_DIM,
    model: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Master rows of raw applicants: normalised, with text, vector and date."""
    rows = with_query_vectors(query_object(applicants, *keep), dim, model)
    return rows.withColumn("dob", nz.parse_date(F.col("dob")))


def candidate_rows(customers: DataFrame, *keep: str) -> DataFrame:
    """The candidate view of customers: ISO date, postal code normalised again."""
    return customers.select(
        "customer_id", *keep, "full_name",
        nz.iso_date(F.col("dob")).alias("dob"),
        "phone_e164", "email_norm", "gov_id_norm", "addr_line", "city", "state",
        nz.norm_postal_code(F.col("postal_code")).alias("postal_code"))


def pair_query_columns(customers: DataFrame, *keep: str) -> DataFrame:
    """Customer columns as the query side of labelled pairs, all text."""
    def value(c):
        return nz.iso_date(F.col(c)) if c == "dob" else F.col(c).cast("string")
    return customers.select(*keep, *[
        value(c).alias(name) for c, name in PAIR_QUERY_FIELDS.items()
        if c in customers.columns])


def pair_query_object(pairs: DataFrame, *keep: str) -> DataFrame:
    """The query side of labelled pairs back under its field names."""
    def value(c, name):
        if name not in pairs.columns:
            return F.lit(None).cast("string")
        return nz.norm_postal_code(F.col(name)) if c == "postal_code" else F.col(name)
    return pairs.select(*keep, *[
        value(c, name).alias(c) for c, name in PAIR_QUERY_FIELDS.items()])
