"""Bulk ingest: raw applicants to new rows of the customer master."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions import normalize as nz
from likeness.functions.quality import identity_errors
from likeness.functions.vectors import has_width
from likeness.plans.records import customer_rows
from likeness.schemas import RAW_FIELDS, VECTOR_DIM
from likeness.sources.checkpoints import written
from likeness.sources.master import append_customers
from likeness.sources.readers import resolve_aliases


def with_errors(applicants: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Adds ``dq_errors``, the messages of the entry form's checks."""
    return resolve_aliases(applicants).withColumn("dq_errors", identity_errors(as_of))


def split_good(
    applicants: DataFrame, strict: bool = False, as_of: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Applicants to load, and those to set aside with ``dq_errors``.

    A name is always required, and a date that is given has to be one. ``strict``
    applies all checks of the entry form.
    """
    if strict:
        checked = with_errors(applicants, as_of)
    else:
        bad_date = (nz.strip(nz.text(F.col("dob"))) != "") & nz.parse_date(F.col("dob")).isNull()
        no_name = nz.strip(nz.text(F.col("full_name"))) == ""
        checked = resolve_aliases(applicants).withColumn("dq_errors", F.array_compact(F.array(
            F.when(no_name, "Full name is required"),
            F.when(bad_date, "Please enter a valid date (YYYY-MM-DD)"))))
    good = F.size("dq_errors") == 0
    return checked.filter(good).drop("dq_errors"), checked.filter(~good)


def new_customers(
    applicants: DataFrame,
    *,
    strict: bool = False,
    as_of: Column | None = None,
    dim: int = VECTOR_DIM,
    model: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Master rows still without ids, and the applicants set aside.

    Columns that are no identity field pass through to both.
    """
    good, rejects = split_good(applicants, strict, as_of)
    keep = [c for c in good.columns if c not in RAW_FIELDS and c != "identity_text"]
    # Judged and encoded once, then split: a model need not answer twice alike.
    judged = written(customer_rows(good, *keep, dim=dim, model=model), "judged")
    narrow = judged.filter(~has_width(F.col("identity_vec"), dim)).select(
        *keep, "full_name", F.array(F.lit("Vector width differs")).alias("dq_errors"))
    return (
        judged.filter(has_width(F.col("identity_vec"), dim)),
        rejects.unionByName(narrow, allowMissingColumns=True))


def ingest(
    applicants: DataFrame,
    path: str,
    batch_id: str,
    created_at: Column,
    *,
    order: list[str] | None = None,
    writer: str = "",
    **checks,
) -> tuple[DataFrame, DataFrame]:
    """Load applicants into the master at ``path``; gives (loaded, set aside).

    Where ``order`` numbers the rows, and not their place in the input, they are spread over
    all cores before they are encoded, as a batch of few files is read by as few tasks.
    """
    if order:
        applicants = applicants.repartition(applicants.sparkSession.sparkContext.defaultParallelism)
    rows, rejects = new_customers(applicants, **checks)
    return append_customers(rows, path, batch_id, created_at, order, writer), rejects
