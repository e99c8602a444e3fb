"""All registered queries of the library and their SQL."""

from . import queries_drift, queries_growth, queries_logs, queries_meter, queries_usage  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
