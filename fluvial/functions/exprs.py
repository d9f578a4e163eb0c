"""Column helpers with the numeric rules that the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Warning levels from least to greatest.
LEVELS = ("none", "blue", "yellow", "orange")


def finite_or_null(value: Column) -> Column:
    """A number, or null if it isn't finite or can't be read as one."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio_or_null(n: Column, d: Column) -> Column:
    """n / d; null if d is 0."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def ratio_or_zero(n: Column, d: Column) -> Column:
    """n / d; 0 if d is 0."""
    return F.coalesce(ratio_or_null(n, d), F.lit(0.0))


def ratio_floor_one(n: Column, d: Column) -> Column:
    """n / max(1, d), for counts."""
    return n.cast("double") / F.greatest(F.lit(1), d).cast("double")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null for fewer than two rows or a constant side, where corr raises in ANSI mode."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def half_even_index(x: Column, origin: float, step: float) -> Column:
    """Index of the nearest grid line, halves to the even one."""
    return F.rint((x - F.lit(origin)) / F.lit(step)).cast("long")


def cell_index(x: Column, origin: float, step: float) -> Column:
    """Index of the half-open cell that holds x."""
    return F.floor((x - F.lit(origin)) / F.lit(step)).cast("long")


def warning_level(depth: Column, blue: float = 15.0, yellow: float = 30.0, orange: float = 50.0, strict_orange: bool = False) -> Column:
    """Level of a depth. The forecast stage takes orange above its threshold (strict), later stages from it on."""
    top = depth > orange if strict_orange else depth >= orange
    return F.when(depth.isNull(), F.lit(None).cast("string")).when(top, "orange").when(depth >= yellow, "yellow").when(depth >= blue, "blue").otherwise("none")


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level) - 1


def rain_class(mm_per_hour: Column) -> Column:
    """Struct (label, factor) of a rainfall intensity: bounds 0, 15 and 30, half-open upward."""
    pick = lambda *v: F.when(mm_per_hour <= 0, v[0]).when(mm_per_hour < 15, v[1]).when(mm_per_hour < 30, v[2]).otherwise(v[3])
    return F.struct(pick("no_rain", "light_rain", "moderate_rain", "heavy_rain").alias("label"), pick(0.7, 1.0, 1.3, 1.8).alias("factor"))


def confidence(error_ratio: Column, high: float = 0.15, medium: float = 0.35) -> Column:
    return F.when(error_ratio <= high, "high").when(error_ratio <= medium, "medium").otherwise("low")


def reasons(checks: Sequence[tuple[str, Column]]) -> Column:
    """Names of the checks that hold, in order; a check that is null doesn't."""
    return F.array_compact(F.array(*(F.when(F.coalesce(p, F.lit(False)), F.lit(name)) for name, p in checks)))


def octant(x: Column, y: Column, cx: Column | float, cy: Column | float) -> Column:
    """0 to 7, counter-clockwise from the positive x axis (y as given)."""
    angle = F.pmod(F.atan2(y - cy, x - cx) + F.lit(2 * 3.141592653589793), F.lit(2 * 3.141592653589793))
    return F.pmod(F.floor(angle / F.lit(3.141592653589793 / 4)), F.lit(8)).cast("int")


def status_badge(text: Column) -> Column:
    """error, warning or success for a status text."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("reject", "rejected", "fail", "failed", "error", "red", "f"), "error").when(t.isin("warning", "partial", "diagnostic_only", "yellow", "orange", "p"), "warning").otherwise("success")
