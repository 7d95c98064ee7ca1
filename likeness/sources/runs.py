"""Tables kept as runs of batches, merged in tiers as further batches come in.

A batch is one folder, ``run=<first>-<last>`` with both its number. Whenever ``fan`` to the
power of n batches are complete, what they hold is merged into one run, so that a reader
opens at most ``fan - 1`` runs per tier, and a row is written again once per tier, however
many batches there are. A run counts when it is whole; those inside a wider one no longer do.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from likeness.sources.readers import delete, folders, path_exists

Merge = Callable[[DataFrame], DataFrame]

FAN = 16


def _folder(path: str, run: tuple[int, int]) -> str:
    return f"{path.rstrip('/')}/run={run[0]:012d}-{run[1]:012d}"


def _all_runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    return sorted(
        (tuple(int(n) for n in name.split("-")) for name in folders(spark, path, "run=")),
        key=lambda run: (run[0], -run[1]))


def runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The fewest whole runs that hold every batch once."""
    found, end = [], -1
    for run in _all_runs(spark, path):
        if run[0] > end and path_exists(spark, f"{_folder(path, run)}/_SUCCESS"):
            found.append(run)
            end = run[1]
    return found


def append_run(rows: DataFrame, path: str, batch: int, merge: Merge | None, fan: int = FAN) -> None:
    """Write a batch, and merge the tiers that were complete before it.

    A batch written again replaces its own rows. The last batch is never merged, as a
    stream may run it again; one that is merged is refused.
    ``merge`` brings any number of rows of a key to one, and may be applied to its own results.
    """
    spark = rows.sparkSession
    for first, last in runs(spark, path):
        if first < last and first <= batch <= last:
            raise ValueError(f"batch {batch} is merged into {first} to {last} and cannot be replaced")
    rows.write.mode("overwrite").parquet(_folder(path, (batch, batch)))
    size = fan
    while merge is not None and size <= batch:
        end = batch - batch % size
        inside = [r for r in runs(spark, path) if end - size <= r[0] and r[1] < end]
        if len(inside) > 1:
            merge(_read(spark, path, inside)).write.mode("overwrite").parquet(
                _folder(path, (end - size, end - 1)))
        size *= fan


def _read(spark: SparkSession, path: str, some: list[tuple[int, int]]) -> DataFrame:
    folder = [_folder(path, run) for run in some]
    # All runs of a table have the columns of the first.
    return spark.read.schema(spark.read.parquet(folder[0]).schema).parquet(*folder)


def read_runs(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all runs, not merged with each other; None before the first batch."""
    some = runs(spark, path)
    return _read(spark, path, some) if some else None


def drop_merged(spark: SparkSession, path: str) -> int:
    """Delete runs that are part of wider ones; gives how many."""
    live = runs(spark, path)
    gone = [r for r in _all_runs(spark, path) if any(a <= r[0] and r[1] <= b and r != (a, b) for a, b in live)]
    for run in gone:
        delete(spark, _folder(path, run))
    return len(gone)
