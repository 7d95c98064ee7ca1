"""Registry and the applicant view that the queries share.

The given tables hold no identities, so applicants are derived from ``customer``
by SQL that runs unchanged in Spark and in the checking engine.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.plans.records import customer_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-30"
DIGITS = 6


def query(name: str, oracle: str | None = None):
    """Register a query, with the SQL that it has to agree with if there is one."""
    def register(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.to_date(F.lit(AS_OF))


def rounded(c: str | Column, digits: int = DIGITS) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# v = 0 is a person; 1 the same with cosmetic changes; 2 the same ids with another
# address text; 3 has no government id, a short phone and no valid postal code; 4
# has no date, e-mail or country and shares a government id with others.
APPLICANTS = """
SELECT customer_id,
  CASE v WHEN 1 THEN upper(concat(w, ' ', substr(w, 2, 4)))
         WHEN 2 THEN concat(' ', w, '-', substr(w, 2, 4), '3')
         ELSE concat(w, ' ', substr(w, 2, 4)) END AS full_name,
  CASE WHEN v = 4 THEN NULL
       ELSE CAST(DATE '1960-01-01' + CAST(pk * 37 % 14600 AS INT) AS {S}) END AS dob,
  CASE v WHEN 1 THEN concat('+91 ', CAST(9000000000 + pk AS {S}))
         WHEN 3 THEN concat('0', CAST(pk AS {S}))
         ELSE concat('91-', CAST(9000000000 + pk AS {S})) END AS phone,
  CASE v WHEN 1 THEN concat(upper(substr(w, 1, 3)), '.', substr(w, 4, 3),
                            CAST(pk AS {S}), '+kyc@Gmail.com')
         WHEN 4 THEN NULL ELSE concat(w, CAST(pk AS {S}), '@gmail.com') END AS email,
  CASE v WHEN 2 THEN concat(' pan', CAST(pk AS {S}), ' ')
         WHEN 3 THEN '' WHEN 4 THEN concat('PANS', CAST(pk - pk % 25 AS {S}))
         ELSE concat('PAN', CAST(pk AS {S})) END AS gov_id,
  concat(CAST(pk % 97 + 1 AS {S}),
         CASE v WHEN 2 THEN ' main  street' ELSE ' Main St' END) AS addr_line,
  CASE WHEN v = 2 THEN 'BANGALORE' WHEN pk % 2 = 0 THEN 'Bangalore' ELSE 'Mumbai' END AS city,
  CASE WHEN pk % 2 = 0 THEN 'KA' ELSE 'MH' END AS state,
  CASE v WHEN 1 THEN concat('560 ', lpad(CAST(pk % 1000 AS {S}), 3, '0'))
         WHEN 3 THEN concat('0', lpad(CAST(pk % 1000 AS {S}), 5, '0'))
         ELSE concat('560', lpad(CAST(pk % 1000 AS {S}), 3, '0')) END AS postal_code,
  CASE WHEN v = 4 THEN NULL ELSE 'IN' END AS country,
  DATE '2024-01-01' + CAST(customer_id % 30 AS INT) AS created_on
FROM (
  SELECT *, translate(lpad(CAST(pk * 7919 % 1000003 AS {S}), 6, '0'),
                      '0123456789', 'aeioulnrst') AS w
  FROM (SELECT c_custkey AS customer_id, c_custkey % 5 AS v,
               CASE WHEN c_custkey % 5 IN (1, 2) THEN c_custkey - c_custkey % 5
                    ELSE c_custkey END AS pk
        FROM {customer}) b) n
"""


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw applicants, one per row of ``customer``.

    The given table is one small file; its rows are spread so that all cores work.
    """
    text = APPLICANTS.replace("{S}", "STRING")
    people = table(spark, sf_dir, "customer").select("c_custkey").repartition(
        spark.sparkContext.defaultParallelism, "c_custkey")
    return spark.sql(text, customer=people)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The applicants as customers: normalised, with text and vector."""
    return customer_rows(applicants(spark, sf_dir), "customer_id", "created_on")


# The same steps as common table expressions.
_FX = "fx AS (" + APPLICANTS.replace("{S}", "VARCHAR").replace("{customer}", "customer") + ")"

_CUST = r"""
norm AS (
  SELECT customer_id, created_on, full_name, dob,
    CASE WHEN length(digits) >= 10 THEN '+' || digits ELSE digits END AS phone_e164,
    CASE WHEN split_part(mail, '@', 2) IN ('gmail.com', 'googlemail.com')
         THEN replace(split_part(split_part(mail, '@', 1), '+', 1), '.', '')
              || '@' || split_part(mail, '@', 2)
         ELSE mail END AS email_norm,
    upper(trim(coalesce(gov_id, ''))) AS gov_id_norm,
    addr_line, city, state,
    CASE WHEN regexp_full_match(pin, '[1-9][0-9]{5}') THEN pin ELSE '' END AS postal_code,
    coalesce(nullif(country, ''), 'IN') AS country
  FROM (SELECT *, regexp_replace(coalesce(phone, ''), '\D', '', 'g') AS digits,
               lower(trim(coalesce(email, ''))) AS mail,
               replace(trim(coalesce(postal_code, '')), ' ', '') AS pin
        FROM fx) raw),
cust AS (
  SELECT *, concat(
    'name:', trim(regexp_replace(regexp_replace(lower(coalesce(full_name, '')),
                  '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')),
    ' | dob:', trim(coalesce(dob, '')), ' | phone:', phone_e164,
    ' | email:', email_norm, ' | govid:', gov_id_norm,
    ' | addr:', lower(coalesce(addr_line, '')), ' | city:', lower(coalesce(city, '')),
    ' | state:', lower(coalesce(state, '')), ' | pc:', postal_code,
    ' | ctry:', upper(country)) AS identity_text
  FROM norm)
"""

_VEC = """
grams AS (
  SELECT customer_id,
         ('0x' || substr(md5(substr(identity_text, CAST(i AS INT), 3)), 1, 8))::BIGINT % 512 AS b
  FROM (SELECT customer_id, identity_text,
               unnest(range(1, length(identity_text) - 1)) AS i FROM cust) g),
counts AS (
  SELECT customer_id, b, count(*) AS n,
         sqrt(sum(count(*) * count(*)) OVER (PARTITION BY customer_id)) AS len
  FROM grams GROUP BY customer_id, b),
vecs AS (
  SELECT c.customer_id,
         list(CAST(coalesce(n / len, 0) AS FLOAT)::DOUBLE ORDER BY d.b) AS vec
  FROM cust c CROSS JOIN (SELECT unnest(range(512)) AS b) d
  LEFT JOIN counts k ON k.customer_id = c.customer_id AND k.b = d.b
  GROUP BY c.customer_id),
sparse AS (
  SELECT customer_id, b, CAST(n / len AS FLOAT)::DOUBLE AS x,
         sqrt(sum(CAST(n / len AS FLOAT)::DOUBLE * CAST(n / len AS FLOAT)::DOUBLE)
              OVER (PARTITION BY customer_id)) AS length FROM counts),
-- All pairs: every two texts share the trigrams of their field names.
dist AS (
  SELECT q.customer_id AS query_id, c.customer_id,
         greatest(1 - sum(q.x * c.x) / (any_value(q.length) * any_value(c.length)), 0) AS vdist,
         sqrt(greatest(any_value(q.length) ** 2 + any_value(c.length) ** 2
                       - 2 * sum(q.x * c.x), 0)) AS straight
  FROM sparse q JOIN sparse c ON q.b = c.b GROUP BY q.customer_id, c.customer_id)
"""


def sql_fx(select: str, *more: str) -> str:
    return "WITH " + ", ".join([_FX, *more]) + " " + select


def sql_cust(select: str, *more: str) -> str:
    return "WITH " + ", ".join([_FX, _CUST, *more]) + " " + select


def sql_vec(select: str, *more: str) -> str:
    return sql_cust(select, _VEC, *more)
