"""Named queries over the driver tables."""

from __future__ import annotations

from importlib import import_module

from .catalog import ORACLES, QUERIES

FAMILIES = (
    "detection", "anomaly", "ingest", "intel", "web", "content", "ledger", "governance", "stream",
)


def _load() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)
