"""All registered queries."""

from __future__ import annotations

import importlib

from tidewire.catalog import registry

_MODULES = ["scalar_queries", "filter_queries", "join_queries", "aggregate_queries", "window_queries", "series_queries",
            "flow_queries", "source_queries", "graph_queries", "view_queries", "survey_queries", "rule_queries",
            "maintenance_queries", "stream_queries"]
_loaded = False


def _load() -> None:
    global _loaded
    if not _loaded:
        for name in _MODULES:
            importlib.import_module(f"tidewire.catalog.{name}")
        _loaded = True


def queries():
    _load()
    return dict(registry.QUERIES)


def oracles():
    _load()
    return dict(registry.ORACLES)
