"""All queries over the driver's tables, by name, and the SQL that each is held against."""

from __future__ import annotations

from scanloom.plans import detector_queries, geometry_queries, map_queries, pattern_queries, registry, source_queries

FLAGSHIP = "remove_static_background"
MODULES = (pattern_queries, map_queries, geometry_queries, source_queries, detector_queries)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
