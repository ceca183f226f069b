"""Test workload: inputs derived from the given tables, the registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "catalog_queries",
    "document_queries",
    "graph_queries",
    "search_queries",
    "drift_queries",
    "store_queries",
    "audit_queries",
    "prompt_queries",
    "bounded_queries",
    "streaming_queries",
]


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"workload.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict:
    return _collect("ORACLES")
