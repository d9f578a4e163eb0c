"""Depth forecast, correction by similar cases, water balance and warning decision: one row a case and horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.functions.exprs import clip, confidence, level_rank, rain_class, warning_level

HORIZONS = (5, 15, 30, 60)
#: Weights of the slopes over 1, 5 and 10 minutes.
SLOPES = ((1, 0.5), (5, 0.3), (10, 0.2))
THRESHOLDS = {"blue": 15.0, "yellow": 30.0, "orange": 50.0}


def depth_history(rows: DataFrame, keys: Sequence[str], minutes: str, depth: str, needed: Sequence[int] = (0, 1, 5, 10)) -> DataFrame:
    """One row a case with d0, d1, ...: the depth at each needed minute before now; a missing one fails the query."""
    wide = rows.groupBy(*keys).agg(*(F.max(F.when(F.col(minutes) == m, F.col(depth))).alias(f"d{m}") for m in needed))
    for m in needed:
        wide = wide.withColumn(f"d{m}", F.coalesce(F.col(f"d{m}"), F.raise_error(F.lit(f"no depth {m} minutes before now")).cast("double")))
    return wide


def linear_time(depth: Column, slope: Column, threshold: float) -> Column:
    """Minutes until depth reaches a threshold at this slope: 0 if it has, null if it doesn't rise."""
    return F.when(depth >= threshold, F.lit(0.0)).when(slope > 0, (F.lit(threshold) - depth) / slope)


def deterministic_forecast(history: DataFrame, factor: str = "factor", low: float = -5.0, high: float = 10.0, deepest: float = 100.0) -> DataFrame:
    """History rows (d0, d1, d5, d10, factor) exploded to horizons: slope, raw and clipped depth, level, time to each threshold."""
    base = sum((F.lit(w) * (F.col("d0") - F.col(f"d{m}")) / F.lit(float(m)) for m, w in SLOPES), F.lit(0.0))
    rows = history.withColumn("raw_slope", base * F.col(factor)).withColumn("slope", clip(F.col("raw_slope"), low, high))
    rows = rows.withColumns({f"minutes_to_{n}": linear_time(F.col("d0"), F.col("slope"), t) for n, t in THRESHOLDS.items()})
    rows = rows.withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS)))).withColumn("raw_depth", F.col("d0") + F.col("slope") * F.col("horizon"))
    depth = F.least(F.col("raw_depth"), F.lit(deepest))
    return rows.withColumn("depth", depth).withColumn("clipped", F.col("raw_depth") > deepest).withColumn("level", warning_level(F.col("depth"), strict_orange=True))


def median_bias(cases: DataFrame, bias: str = "bias") -> DataFrame:
    """Median of the retrieved cases' bias at each horizon, from a map of horizon to bias."""
    return cases.select(F.explode(F.col(bias)).alias("horizon", "_b")).groupBy(F.col("horizon").cast("int").alias("horizon")).agg(F.median("_b").alias("bias"))


def corrected_forecast(forecast: DataFrame, bias: DataFrame, keys: Sequence[str] = ("horizon",), deepest: float = 100.0) -> DataFrame:
    """Forecast depth plus bias (none: 0), kept in [0, deepest]; level with orange from its threshold on."""
    raw = F.col("depth") + F.coalesce(F.col("bias"), F.lit(0.0))
    joined = forecast.join(bias, list(keys), "left").withColumn("_raw", raw).withColumn("corrected_depth", clip(F.col("_raw"), 0.0, deepest))
    return joined.withColumn("corrected_clipped", F.col("_raw") != F.col("corrected_depth")).withColumn("corrected_level", warning_level(F.col("corrected_depth"))).drop("_raw")


def water_balance(rows: DataFrame, catchment: float, drainage: float, infiltration: float, tolerance: float = 0.15, pull: float = 0.5) -> DataFrame:
    """Forecast volume against the balance of rain, drainage and infiltration until each horizon.

    rows need d0 (depth now), volume, horizon, rain_mm and corrected_depth. Depth or volume now not above 0
    fails the query. Beyond tolerance the depth is pulled half way to the balance's, within [0, 100].
    """
    per_cm = F.when((F.col("d0") > 0) & (F.col("volume") > 0), F.col("volume") / F.col("d0")).otherwise(F.raise_error(F.lit("depth and volume must be positive")).cast("double"))
    rows = rows.withColumn("volume_per_cm", per_cm).withColumn("expected_volume", F.greatest(F.lit(0.0), F.col("volume") + F.col("rain_mm") / 1000.0 * catchment - F.col("horizon") * drainage - F.col("horizon") * infiltration))
    rows = rows.withColumn("error_ratio", F.abs(F.col("corrected_depth") * F.col("volume_per_cm") - F.col("expected_volume")) / F.greatest(F.col("expected_volume"), F.lit(1e-6)))
    adjusted = clip(F.col("corrected_depth") + F.lit(min(pull, 0.5)) * (F.col("expected_volume") / F.col("volume_per_cm") - F.col("corrected_depth")), 0.0, 100.0)
    ok = F.col("error_ratio") <= tolerance
    rows = rows.withColumn("balance", F.when(ok, "pass").otherwise("adjusted")).withColumn("final_depth", F.when(ok, F.col("corrected_depth")).otherwise(adjusted))
    return rows.withColumn("confidence", confidence(F.col("error_ratio"))).withColumn("final_level", warning_level(F.col("final_depth")))


def weather_correction(rows: DataFrame, intensity: str, forecasts: Sequence[str] = ()) -> DataFrame:
    """rows with missing rainfall as 0, and label and factor of the present intensity."""
    filled = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (intensity, *forecasts)})
    return filled.withColumn("_c", rain_class(F.col(intensity))).withColumns({"rain_label": F.col("_c.label"), "factor": F.col("_c.factor")}).drop("_c")


def horizon_rain(horizon: Column, by_horizon: dict[int, Column], intensity: Column) -> Column:
    """Rain until a horizon: as forecast for it, else the present intensity for that long."""
    out = None
    for h, mm in by_horizon.items():
        out = F.when(horizon == h, mm) if out is None else out.when(horizon == h, mm)
    rest = intensity * horizon / 60.0
    return F.coalesce(out, rest) if out is not None else rest


def decision(rows: DataFrame, keys: Sequence[str], depth: str, level: str, fallback_depth: str, fallback_level: str) -> DataFrame:
    """One row a case: overall level, first horizon at each threshold, worst confidence, and which forecast was used.

    The checked forecast counts if the case has it, else the deterministic one.
    """
    chosen = rows.withColumn("_d", F.coalesce(F.col(depth), F.col(fallback_depth))).withColumn("_l", F.coalesce(F.col(level), F.col(fallback_level)))
    worst = F.array_position(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("confidence"))
    return chosen.groupBy(*keys).agg(
        F.coalesce(F.max_by("_l", level_rank(F.col("_l"))), F.lit("none")).alias("overall_level"),
        *(F.min(F.when(F.col("_d") >= t, F.col("horizon"))).alias(f"first_{n}") for n, t in THRESHOLDS.items()),
        F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.max(worst).cast("int")).alias("worst_confidence"),
        F.count_if(F.col("balance") == "adjusted").alias("adjusted"),
        F.when(F.count(depth) == F.count("*"), "final").otherwise("deterministic").alias("source"),
    )
