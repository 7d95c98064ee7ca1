"""Personal data by patterns, checksums and context, in SQL functions alone.

Regular expressions propose spans of six kinds; validators confirm them: parts of an
address (ip), Luhn (card), number of digits (phone), mod-97 (iban), length of the groups
(ssn). A score starts from the kind, higher where a checksum agreed, and rises if
one of the kind's context words stands in the 40 characters before the span, back to
the previous proposal of the kind at most. Spans scoring 0.6 or more count. The base kinds
(email, ip, card, phone) start there, so what passes validation stays; an ssn needs
context. An iban needs its checksum.

Proposals are the leftmost longest runs, not overlapping within a kind; spans of
different kinds may overlap. The patterns repeat without backtracking (possessive), so
that long runs of digits or letters cost time in proportion to their length and no stack.
Positions are code points, sums of the lengths of what stands between the proposals.

A null text is empty and has no spans. Repeated rows give repeated results, long
texts are searched whole, equal starts are ordered by kind. An empty table gives none. Other
columns are kept by ``with_spans`` and ``redacted``.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.functions.binding import bind

LOCAL = "[A-Za-z0-9._%+-]"
# Kind, pattern, first score, context words. A match may begin inside a run
# of its characters only where the last match ended (\G).
KINDS = [
    ("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.7, "mail|contact|address|correo|courriel"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|address|login"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|visa|credit|debit|karte|carte|tarjeta"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|tel|mobile|fax"),
    ("iban", r"[A-Z][A-Z][0-9][0-9][A-Z0-9]{11,30}", 0.8, "iban|account|bank|konto|compte|cuenta"),
    ("ssn", r"(?:(?<![0-9])|\G)[0-9]++-[0-9]++-[0-9]++", 0.4, "ssn|social security|tax id|passport"),
]
BASE = [k for k, *_ in KINDS[:4]]
THRESHOLD = 0.6
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.2
BLOCK = 128
SPAN = "struct<start:int,kind:int,end:int,value:string,score:double>"


def mod97(value: Column) -> Column:
    """Remainder of an account number, its first four characters last, letters as 10 to 35."""
    turned = F.split(F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4)), "")

    def step(rest, c):
        code = F.ascii(c)
        return F.when(c == "", rest).when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)
    return F.aggregate(turned, F.lit(0), step)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) == 0) | (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return mod97(value) == 1
    if kind == "ssn":
        return value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    return F.lit(True)


def _located(parts: Column) -> Column:
    """Elements ``(before, value)`` with ``start``, the length of all that comes before.

    Sums run within blocks and over blocks, so that the work stays near-linear.
    """
    def within(block):
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.array().cast(
            "array<struct<start:int,before:string,value:string>>").alias("done")), lambda acc, x: F.struct(
                (acc["at"] + F.length(x["before"]) + F.length(x["value"])).alias("at"),
                F.concat(acc["done"], F.array(F.struct(
                    (acc["at"] + F.length(x["before"])).alias("start"), x["before"].alias("before"),
                    x["value"].alias("value")))).alias("done")))

    blocks = bind(parts, lambda p: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")),
        lambda b: within(F.slice(p, b * BLOCK + 1, BLOCK))))
    moved = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast(
            "array<array<struct<start:int,before:string,value:string>>>").alias("done")),
        lambda acc, b: F.struct(
            (acc["at"] + b["at"]).alias("at"),
            F.concat(acc["done"], F.array(F.transform(b["done"], lambda x: F.struct(
                (x["start"] + acc["at"]).alias("start"), x["before"].alias("before"),
                x["value"].alias("value"))))).alias("done")))
    return F.flatten(moved["done"])


def _spans(number: int, text: Column, found: Column) -> Column:
    kind, pattern, score, context = KINDS[number]
    between = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("before"), found.alias("value")),
                          lambda x: F.struct(x["before"].alias("before"), x["value"].alias("value")))
    located = _located(F.slice(between, 1, F.size(found)))
    scored = F.transform(F.filter(located, lambda x: _valid(kind, x["value"])), lambda x: F.struct(
        x["start"].alias("start"), F.lit(number).alias("kind"),
        (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value"),
        F.when(F.lower(F.right(x["before"], F.lit(CONTEXT_CHARS))).rlike(rf"\b(?:{context})"), score + CONTEXT_GAIN)
        .otherwise(score).alias("score")))
    kept = F.filter(scored, lambda x: x["score"] >= THRESHOLD)
    return F.when(F.size(found) > 0, kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` and ``spans``: start, kind (number in ``KINDS``), end, value, score; in order.

    A column of that name is replaced; all others are kept, whatever their names.
    """
    docs = docs.drop("spans")
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    digits = text.rlike("[0-9]")
    hints = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")) & digits}
    rows = docs.select("*", *[
        F.when(hints.get(k, digits), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"{mark}{k}")
        for k, p, *_ in KINDS])
    spans = F.array_sort(F.concat(*[_spans(i, text, F.col(f"{mark}{k}")) for i, (k, *_) in enumerate(KINDS)]))
    return rows.select(*[f"`{c}`" for c in docs.columns], spans.alias("spans"))


def rendered(spans: Column, base_only: bool) -> Column:
    """``kind:start:end``, comma-joined, by start and then by kind."""
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    if base_only:
        spans = F.filter(spans, lambda x: x["kind"] < len(BASE))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets.

    Of overlapping spans the first counts, and what juts out of it goes too.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k, *_ in KINDS])

    def step(acc, x):
        grown = F.concat(acc["done"], F.substr(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), names[x["kind"]])
        inside = x["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(inside, acc["done"]).otherwise(grown).alias("done"))

    def finish(acc):
        return F.concat(acc["done"], F.substr(F.col("text"), acc["at"] + 1, F.length("text")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    clean = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.aggregate("spans", start, step, finish))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return with_spans(rows).select(*[
        (clean if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def count(k):
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(rendered(F.col("spans"), True), 256).alias("base_sha256"),
        rendered(F.col("spans"), False).alias("spans"))


def _oracle() -> str:
    """Plain patterns (as the engine of the SQL has no possessive ones) and list sums."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"[A-Z][A-Z][0-9][0-9][A-Z0-9]{11,30}",
        "ssn": r"[0-9]+-[0-9]+-[0-9]+"}
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = (f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: "
            f"CASE WHEN (length({digits}) - i) % 2 = 1 THEN 2 * CAST({digits}[i] AS INT) - 9 * CAST(CAST({digits}[i] AS INT) > 4 AS INT) "
            f"ELSE CAST({digits}[i] AS INT) END)) % 10 = 0")
    turned = "string_split(substr(v, 5) || substr(v, 1, 4), '')"
    remainder = (f"list_reduce(list_transform({turned}, lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END), "
                 f"lambda r, x: CASE WHEN x > 9 THEN (r * 100 + x) % 97 ELSE (r * 10 + x) % 97 END, 0)")
    valid = {
        "email": "true", "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda p: CAST(p AS HUGEINT) <= 255))",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"{remainder} = 1", "ssn": "regexp_full_match(v, '[0-9]{3}-[0-9]{2}-[0-9]{4}')"}
    parts = []
    for i, (kind, _, score, context) in enumerate(KINDS):
        needs = f" AND regexp_matches(lower(right(b, {CONTEXT_CHARS})), '\\b(?:{context})')" if score < THRESHOLD else ""
        parts.append(f"""
SELECT doc_id, {i} AS kind, '{kind}' AS name, s, s + length(v) AS e FROM (
  SELECT doc_id, v, b, CASE WHEN {valid[kind]} THEN s END AS s FROM (
    SELECT doc_id, m[i] AS v, p[i] AS b, CAST(list_sum(list_transform(p[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{plain[kind]}') AS m, string_split_regex(t, '{plain[kind]}') AS p FROM d))))
WHERE s IS NOT NULL{needs}""")
    union = "\nUNION ALL\n".join(parts)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({union}),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(BASE))},
  string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < {len(BASE)}) AS base,
  string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


ORACLE = _oracle()
