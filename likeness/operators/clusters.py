"""Groups of equal identity and the duplicate pairs within them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from likeness.sources.runs import append_run, read_runs

# The ring of a cluster of more rows than this is cut into arcs before it is ordered.
PART_ROWS = 10_000


def digest(key: str):
    """Stands for a long key wherever rows are grouped, joined or ordered by it."""
    return F.sha2(F.col(key).cast("string"), 256)


def _clusters(customers: DataFrame, key: str) -> DataFrame:
    return customers.groupBy(digest(key).alias("_digest")).agg(
        F.first(key).alias(key),
        F.min("customer_id").alias("cluster_id"),
        F.count("*").alias("cluster_size"))


def identity_clusters(customers: DataFrame, key: str = "identity_text") -> DataFrame:
    """Every group of equal key: its lowest id and its size, counted map-side."""
    return _clusters(customers, key).drop("_digest")


def _merged(parts: DataFrame) -> DataFrame:
    key, = (c for c in parts.columns if c not in ("_digest", "cluster_id", "cluster_size"))
    return parts.groupBy("_digest").agg(
        F.first(key).alias(key), F.min("cluster_id").alias("cluster_id"),
        F.sum("cluster_size").alias("cluster_size"))


def add_to_clusters(customers: DataFrame, path: str, batch: int, key: str = "identity_text") -> None:
    """Add a batch of new customers to the groups kept at ``path``; batches count from 0.

    Only the batch is counted. A batch added again replaces itself, until it is merged.
    """
    append_run(_clusters(customers, key), path, batch, _merged)


def kept_clusters(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`identity_clusters` gives for the customers of all batches together."""
    parts = read_runs(spark, path)
    if parts is None:
        raise ValueError(f"{path}: no batch yet")
    return _merged(parts).drop("_digest")


def duplicates_only(customers: DataFrame, key: str = "identity_text") -> DataFrame:
    """Customers in groups of two and more, with the group's id and size.

    A plain join with the grouped counts, whose skew Spark splits at run time; a
    window over the key would take a hot group to one task.
    """
    groups = customers.groupBy(digest(key).alias("_digest")).agg(
        F.min("customer_id").alias("cluster_id"),
        F.count("*").alias("cluster_size")).filter(F.col("cluster_size") > 1)
    return customers.withColumn("_digest", digest(key)).join(groups, "_digest").drop("_digest")


def duplicate_pairs(
    members: DataFrame,
    cap: int,
    key: str = "identity_text",
    seed: str = "",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """For each member up to ``cap`` others of its group, picked at random.

    ``members`` comes from :func:`duplicates_only`. The group is put on a ring in
    order of a seeded hash, and each member is paired with those after it: always
    ``min(cap, size - 1)`` distinct partners, from one pass that never builds
    all pairs. The ring of a group of more than ``part_rows`` rows is cut into arcs of
    about that many, by the hash's first digits; the last members of an arc get their
    partners from the first rows of the arcs that follow, so that the pairs are those of
    the uncut ring whatever ``part_rows`` is.

    Adds ``cand_customer_id``.
    """
    if cap < 1 or part_rows <= 2 * cap:
        raise ValueError("cap must be positive and well below part_rows")
    place = F.md5(F.concat(F.lit(seed), F.col("customer_id").cast("string")).cast("binary"))
    arcs = F.ceil(F.col("cluster_size") / part_rows)
    arc = F.shiftright(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("bigint") * arcs, 32)
    salted = members.withColumn("_hash", place).withColumn("_group", digest(key)).withColumn("_arc", arc)
    ring = Window.partitionBy("_group", "_arc").orderBy("_hash", "customer_id")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = salted.select(
        *members.columns, "_group", "_arc",
        F.row_number().over(ring).alias("_place"),
        F.count("*").over(whole).alias("_n"),
        *[F.lead("customer_id", j).over(ring).alias(f"_next{j}")
          for j in range(1, cap + 1)],
        F.array(*[F.nth_value("customer_id", j).over(whole)
                  for j in range(1, cap + 1)]).alias("_firsts"))
    following = _rows_after_arcs(salted.where(F.col("cluster_size") > part_rows), ring, cap)
    placed = placed.join(following, ["_group", "_arc"], "left").withColumns({
        "_firsts": F.coalesce("_after", "_firsts"),
        "_last": F.coalesce("_total", F.col("_n")) - 1})
    partners = F.array_compact(F.array(*[
        F.when(
            F.lit(j) <= F.col("_last"),
            F.coalesce(
                F.col(f"_next{j}"),
                F.get("_firsts", (F.col("_place") + j - F.col("_n") - 1).cast("int"))))
        for j in range(1, cap + 1)]))
    return placed.select(
        *members.columns, F.explode(partners).alias("cand_customer_id"))


def _rows_after_arcs(salted: DataFrame, ring: Window, cap: int) -> DataFrame:
    """For each arc of the large groups the ``cap`` ids that follow it on the ring, and the group's rows.

    One row per arc. ``cap`` arcs, none of them empty, hold the ids looked for.
    """
    sizes = salted.groupBy("_group", "_arc").agg(F.count("*").alias("_n"))
    heads = salted.select("_group", "_arc", "_hash", "customer_id").withColumn(
        "_place", F.row_number().over(ring)).where(F.col("_place") <= cap).groupBy("_group", "_arc").agg(
            F.array_sort(F.collect_list(F.struct("_place", "customer_id")))["customer_id"].alias("_head"))
    around = Window.partitionBy("_group").orderBy("_arc")
    group = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begin = F.array(*[F.nth_value("_head", j).over(group) for j in range(1, cap + 1)])
    nexts = F.array(*[F.lead("_head", j).over(around) for j in range(1, cap + 1)])
    return sizes.join(heads, ["_group", "_arc"]).select(
        "_group", "_arc", F.sum("_n").over(group).alias("_total"),
        F.slice(F.flatten(F.array_compact(F.concat(nexts, begin))), 1, cap).alias("_after"))
