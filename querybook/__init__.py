"""The registered queries, and the SQL that each has to agree with."""

from querybook import checks, jobs, scalars, search, streams, tables  # noqa: F401
from querybook.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
