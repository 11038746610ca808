"""All named queries."""

from riskweave.queries import audits, cohort, explained, files, prepared  # noqa: F401
from riskweave.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
