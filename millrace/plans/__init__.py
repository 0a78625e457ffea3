"""Registered queries, grouped as the operators are."""

from millrace.plans import (  # noqa: F401
    aggregates,
    changes,
    joins,
    loading,
    nested,
    streams,
    udfs,
    windows,
)
from millrace.plans.registry import ORACLES, QUERIES  # noqa: F401
