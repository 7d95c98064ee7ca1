"""Evaluate an expression once and use it many times."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once per row.

    Inside a lambda Spark evaluates an outer expression again for every element.
    """
    return F.transform(F.array(value), use)[0]
