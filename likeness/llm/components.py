"""Connected components of a graph, as joins over ever fewer edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.sources.checkpoints import written


def _compressed(parents: DataFrame) -> DataFrame:
    """Every node under the root of its tree: each round halves the way."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("over"))
        parents = written(parents.join(up, "parent", "left").select(
            "node", F.coalesce("over", "parent").alias("parent"),
            F.col("over").isNotNull().alias("moved")), "parents")
        if parents.where("moved").isEmpty():
            return parents.select("node", "parent")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of all nodes that are not it.

    ``edges`` has the columns ``a`` and ``b`` (long). Each round hangs every node under
    its smallest neighbour, takes the roots of these trees for their nodes, and goes on
    with the edges that still join different roots. Only counts summed in the tasks and
    two narrow columns are shuffled; loops and repeated edges do no harm.
    """
    def tidy(df):
        return df.where("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    rest = written(tidy(edges), "edges")
    labels = None
    while not rest.isEmpty():
        hung = _compressed(rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
        if labels is None:
            labels = hung
        else:
            over = hung.select(F.col("node").alias("parent"), F.col("parent").alias("over"))
            labels = written(labels.join(over, "parent", "left").select(
                "node", F.coalesce("over", "parent").alias("parent")).unionByName(hung), "labels")
        for side in ("a", "b"):
            root = hung.select(F.col("node").alias(side), F.col("parent").alias("root"))
            rest = rest.join(root, side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        rest = written(tidy(rest), "edges")
    if labels is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("parent").alias("component"))
