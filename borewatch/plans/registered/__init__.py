"""Importing this package registers every query."""

from borewatch.plans.registered import (  # noqa: F401
    benchmarks,
    cover,
    decisions,
    detection,
    evidence,
    generation,
    retrieval,
    stores,
    streams,
    telemetry,
    texts,
)
