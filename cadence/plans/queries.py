"""All queries of the library's own operators."""

from cadence.plans import poses, relational, replays, series, sheets, stored, trained  # noqa: F401  they register themselves
from cadence.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
