"""Imports every query module so that the registry is complete."""

from tablewright.plans import (  # noqa: F401
    bench_queries,
    catalogue_queries,
    compare_queries,
    discover_queries,
    file_queries,
    history_queries,
    profile_queries,
    record_queries,
    rule_queries,
    stream_queries,
    transform_queries,
)
from tablewright.plans.registry import ORACLES, QUERIES  # noqa: F401
