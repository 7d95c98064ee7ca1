"""Counts, repeated-id alerts and the daily rate over the customer master."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Holders of one government id from which there is an alert, and
# from which it is of high risk.
ALERT_HOLDERS = 2
HIGH_RISK_HOLDERS = 5


def holders_per_id(customers: DataFrame, as_of: Column) -> DataFrame:
    """Rows and rows of the day per government id; no id is one group of null."""
    return customers.groupBy(F.nullif("gov_id_norm", F.lit("")).alias("gov_id")).agg(
        F.count("*").alias("holders"),
        F.count_if(F.col("created_on") == as_of).alias("today"))


def stats(customers: DataFrame, as_of: Column) -> DataFrame:
    """The one-row report, from one scan of two columns and one shuffle.

    Every figure is a sum over the groups by government id, so totals, the day's
    count and both alert counts share that aggregate.
    """
    repeated = F.col("gov_id").isNotNull()
    report = holders_per_id(customers, as_of).agg(
        F.coalesce(F.sum("holders"), F.lit(0)).alias("total_applicants"),
        F.coalesce(F.sum("today"), F.lit(0)).alias("today_applicants"),
        F.count_if(repeated & (F.col("holders") >= ALERT_HOLDERS)).alias("duplicate_alerts"),
        F.count_if(repeated & (F.col("holders") >= HIGH_RISK_HOLDERS))
        .alias("high_risk_duplicates"))
    return report.withColumn("processing_rate", processing_rate())


def processing_rate() -> Column:
    share = F.try_divide(F.col("today_applicants"), F.col("total_applicants"))
    return F.coalesce(F.round(share * 100, 1), F.lit(0.0))


def total_customers(customers: DataFrame) -> DataFrame:
    return customers.agg(F.count("*").alias("total_applicants"))


def created_today(customers: DataFrame, as_of: Column) -> DataFrame:
    """How many customers one day brought: a count over its partition alone."""
    return created_on_day(customers, as_of).agg(F.count("*").alias("today_applicants"))


def customers_per_day(customers: DataFrame) -> DataFrame:
    """Customers of each day, late ones too, from counts in the tasks."""
    return customers.groupBy("created_on").agg(F.count("*").alias("customers"))


def daily_rate(customers: DataFrame, as_of: Column) -> DataFrame:
    """The day's share of all customers, from counts in the tasks; no id is shuffled."""
    return customers.agg(
        F.count("*").alias("total_applicants"),
        F.count_if(F.col("created_on") == as_of).alias("today_applicants")).select(
            processing_rate().alias("processing_rate"))


def created_on_day(customers: DataFrame, as_of: Column) -> DataFrame:
    """Customers of one day: a partition filter on the master."""
    return customers.filter(F.col("created_on") == as_of)


def repeated_ids(customers: DataFrame, at_least: int = ALERT_HOLDERS) -> DataFrame:
    """Government ids with that many holders; empty ids are none."""
    return (
        customers.filter(F.nullif("gov_id_norm", F.lit("")).isNotNull())
        .groupBy("gov_id_norm").agg(F.count("*").alias("holders"))
        .filter(F.col("holders") >= at_least))
