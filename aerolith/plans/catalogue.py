"""Registry of the engine's own queries and their SQL counterparts."""

from __future__ import annotations


def _modules() -> list:
    from aerolith.plans import depths, files, flights, images, maskviews, registry, reports, scenes, terrain

    return [flights, scenes, depths, maskviews, reports, registry, files, terrain, images]


def queries() -> dict:
    return {name: f for module in _modules() for name, f in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _modules() for name, sql in module.ORACLE.items()}
