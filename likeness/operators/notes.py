"""Compliance notes: an append-only log of which the latest per key counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTE_FIELDS = ["note", "officer", "timestamp", "decision"]


def latest_notes(log: DataFrame) -> DataFrame:
    """The newest note of each application, reduced map-side."""
    newest = F.max_by(
        F.struct(*NOTE_FIELDS), F.struct("timestamp", "decision", "note", "officer"))
    return log.groupBy("applicant_id").agg(newest.alias("_n")).select("applicant_id", "_n.*")


def with_latest_note(applications: DataFrame, log: DataFrame) -> DataFrame:
    """Each application with its newest note, if there is one."""
    notes = latest_notes(log).withColumnRenamed("applicant_id", "loan_application_id")
    return applications.join(notes, "loan_application_id", "left")
