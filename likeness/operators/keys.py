"""Candidates that share a phone, an e-mail address or a government id."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.operators import blocks
from likeness.operators.scored_blocks import best_in_blocks
from likeness.sources.checkpoints import written

KEYS = {"phone": "phone_e164", "email": "email_norm", "gov_id": "gov_id_norm"}

# A key held by more customers is scored in blocks instead of listed in pairs.
HOT_ROWS = 200


def key_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One row per non-empty key of each record, as ``block``."""
    keys = F.array_compact(F.array(*[
        F.when(F.col(c) != "", F.concat(F.lit(f"{kind}:"), F.col(c)))
        for kind, c in KEYS.items()]))
    return df.select(*keep, F.explode(keys).alias("block"))


def hot_keys(queries: DataFrame, master: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys of the queries that more than ``hot_rows`` customers hold, with both counts.

    Only keys that are asked for are counted, so that a small batch of queries costs one
    scan of the master's key columns.
    """
    asked = key_rows(queries).groupBy("block").agg(F.count("*").alias("q_rows"))
    held = key_rows(master).join(asked.select("block"), "block", "left_semi")
    counts = held.groupBy("block").agg(F.count("*").alias("m_rows"))
    return written(counts.filter(F.col("m_rows") > hot_rows).join(asked, "block"), "hot")


def shared_key_pairs(
    queries: DataFrame, master: DataFrame, hot: DataFrame | None = None
) -> DataFrame:
    """(query_id, customer_id) of all that share a key not in ``hot``, each pair once."""
    q = key_rows(queries, "query_id")
    m = key_rows(master, "customer_id").join(q.select("block").distinct(), "block", "left_semi")
    if hot is not None:
        q = q.join(hot.select("block"), "block", "left_anti")
        m = m.join(hot.select("block"), "block", "left_anti")
    return q.join(m, "block").select("query_id", "customer_id").distinct()


def best_of_hot_keys(
    queries: DataFrame,
    master: DataFrame,
    hot: DataFrame,
    scorer,
    evidence: int,
    metric: str = "cosine",
    exclude_self: bool = False,
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Each query's ``evidence`` best customers by score of each block of a hot key.

    Both sides have ``vec``, the keys, and the compared columns (``q_``, ``c_``). All
    pairs of a key are judged in bounded blocks and none is left out before it is scored,
    so that the verdict does not depend on how many customers share the key.
    """
    def side(df, own):
        kept = [c for c in df.columns if c not in KEYS.values() and c != own]
        return key_rows(df, own, *kept).join(hot.select("block"), "block", "left_semi")

    return best_in_blocks(
        side(queries, "query_id"), side(master, "customer_id"), hot, scorer, evidence,
        metric, exclude_self, block_rows)
