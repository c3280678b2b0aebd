"""All registered queries of the benchmark engine and their SQL."""

from __future__ import annotations

from . import arriving, capability, corpora, inference, layers, leaderboards, matching, parts, probing, steps, suites  # noqa: F401
from .base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
