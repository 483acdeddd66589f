"""Loads every module that declares queries."""

from __future__ import annotations

from ledgersignal.plans import feature_queries, ledger_queries, network_queries, score_queries, stream_queries, window_queries  # noqa: F401
from ledgersignal.plans.registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)
