"""All registered queries. Importing the plan modules fills the registry."""

from webjourney.plans import data, funnels, reports, sessions, streams, summaries  # noqa: F401
from webjourney.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
