"""Registered queries over the engine's operators, each with its SQL counterpart."""

from strandlight.plans import assemblies, clips, pairs, pictures, records, reports, segments, series, texts  # noqa: F401
from strandlight.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
