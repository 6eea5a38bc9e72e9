"""Queries over the given tables, one or more per operator, with SQL to check them against."""

from workload import audio, catalogue, display, jobs, lists  # noqa: F401
from workload.registry import ORACLES, QUERIES
from workload.tables import Tables

__all__ = ["ORACLES", "QUERIES", "Tables"]
