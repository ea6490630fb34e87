"""Collects the registered queries of every query module."""

from __future__ import annotations

import importlib

QUERY_MODULES = (
    "lexiprop.plans.graph_queries",
    "lexiprop.plans.text_queries",
    "lexiprop.plans.baseline_queries",
    "lexiprop.plans.review_queries",
    "lexiprop.plans.io_queries",
    "lexiprop.plans.source_queries",
)


def _modules():
    return [importlib.import_module(m) for m in QUERY_MODULES]


def all_queries() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def all_oracles() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.ORACLE)
    return out
