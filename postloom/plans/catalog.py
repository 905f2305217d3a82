"""All registered queries."""

from postloom.plans import changes, dashboard, feeds, finding, landing, pipeline, rules, stores, streams  # noqa: F401
from postloom.plans.registry import ORACLES, QUERIES, runnable

__all__ = ["ORACLES", "QUERIES", "runnable"]
