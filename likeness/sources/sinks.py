"""Writers for labelled pairs."""

import os

from pyspark.sql import DataFrame

from likeness.sources.readers import PARQUET_FORMATS

# Quotes are doubled, and white space around a value belongs to it.
CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Parquet when the path says so, else CSV with a header.

    Each task writes its own part file, so nothing is gathered in one place.
    """
    if os.path.splitext(path)[1].lower() in PARQUET_FORMATS:
        pairs.write.mode("overwrite").parquet(path)
    else:
        pairs.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


