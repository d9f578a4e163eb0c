"""All queries of the library."""

from __future__ import annotations

from fluvial.plans import chains, composed, evidence, frames, images, large, levels, rasters, registry, runs, shadow, streams, support

MODULES = (rasters, frames, chains, streams, images, levels, runs, support, evidence, shadow, large, composed)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
