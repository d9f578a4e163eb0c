"""Checks and defaults for paths, settings and metadata, made before a query is planned."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which grid metadata gives its cell size and bounds.
RESOLUTION_NAMES = ("grid_resolution_m", "grid_size_m", "grid_size", "resolution_m", "resolution")
BOUNDS_NAMES = ("bounds", "roi", "dem_bounds", "dem_roi")


def first_present(rows: DataFrame, names: Sequence[str], alias: str) -> Column:
    """First of the named columns that there are and that isn't null; none of them is an error."""
    there = [F.col(n) for n in names if n in rows.columns]
    if not there:
        raise KeyError(f"none of {list(names)}")
    return F.coalesce(*there).alias(alias)


def allowed_path(path: str, folders: Sequence[str], forbidden: Iterable[str] = ()) -> str:
    """A relative path that stays under one of the folders and names nothing forbidden; else an error."""
    clean = posixpath.normpath(path)
    if path.startswith(("/", "~")) or ":" in path or clean.startswith(".."):
        raise ValueError(f"{path} isn't relative to the project")
    if not any(clean == f or clean.startswith(f"{f}/") for f in map(posixpath.normpath, folders)):
        raise ValueError(f"{path} isn't in an allowed folder")
    bad = [x for x in forbidden if x.lower() in clean.lower()]
    if bad:
        raise ValueError(f"{path} names {bad}")
    return clean


def merged(defaults: Mapping, *overrides: Mapping) -> dict:
    """Nested settings: later values win, and mappings merge."""
    out = dict(defaults)
    for more in overrides:
        for k, v in more.items():
            out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def validated(settings: Mapping, required: Sequence[str], ranges: Mapping[str, tuple[float, float]] | None = None) -> dict:
    """settings as a dict; a missing key, or a number outside its closed range, is an error. Keys may be dotted."""

    def at(key: str):
        value = settings
        for part in key.split("."):
            if not isinstance(value, Mapping) or part not in value:
                raise KeyError(key)
            value = value[part]
        return value

    for key in required:
        at(key)
    for key, (low, high) in (ranges or {}).items():
        if not low <= float(at(key)) <= high:
            raise ValueError(f"{key} is outside {low} to {high}")
    return dict(settings)


def unique(values: Iterable[str], what: str) -> list[str]:
    """values as a list; one that comes twice is an error."""
    listed = list(values)
    if len(set(listed)) < len(listed):
        raise ValueError(f"{what} repeat")
    return listed


def path_status(found: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (path, required) with status ok, missing (required) or optional (not there), from found (path)."""
    there = found.select("path").distinct().withColumn("_there", F.lit(True))
    status = F.when(F.col("_there"), "ok").when(F.col("required"), "missing").otherwise("optional")
    return expected.join(there, "path", "left").withColumn("status", status).drop("_there")


def overall_status(statuses: DataFrame) -> DataFrame:
    """One row: counts by status, and error if something required is missing, warning if something optional is."""
    n = statuses.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "missing", "optional")))
    return n.withColumn("overall", F.when(F.col("missing") > 0, "error").when(F.col("optional") > 0, "warning").otherwise("success"))
