"""Scalar and series functions as Column builders; none of them leaves generated code."""

from strandlight.functions.scalar import *  # noqa: F403
