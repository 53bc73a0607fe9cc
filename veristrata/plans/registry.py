"""The registered queries and their SQL."""

from __future__ import annotations

from veristrata.plans import analytics, audits, detail, detection, extended, policies


def queries() -> dict:
    return {f.__name__: f for f in (*detection.QUERIES, *analytics.QUERIES, *extended.QUERIES, *audits.QUERIES, *policies.QUERIES, *detail.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return detection.ORACLES | analytics.ORACLES | extended.ORACLES | audits.ORACLES | policies.ORACLES | detail.ORACLES
