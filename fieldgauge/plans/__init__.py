"""Registered queries of the toolkit's own operators."""

from __future__ import annotations

import importlib

MODULES = ["queries_frames", "queries_scores", "queries_tables", "queries_stream", "queries_sources"]


def load() -> tuple[dict, dict]:
    """(queries, oracles) of all modules."""
    for m in MODULES:
        importlib.import_module(f"fieldgauge.plans.{m}")
    from fieldgauge.plans.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
