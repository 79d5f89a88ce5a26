"""All queries of the analytics engine, by name."""

from tagweave.plans import basics, collections, extras, graphs, operations, reports, searches, services, timeseries  # noqa: F401
from tagweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
