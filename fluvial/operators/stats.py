"""Robust and grouped statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.functions.exprs import ratio_or_zero
from fluvial.operators.quantiles import MOST, quantiles
from fluvial.sources.checkpoints import cut


def robust_filter(rows: DataFrame, keys: Sequence[str], value: str, method: str = "mad", factor: float = 3.5, iqr_factor: float = 1.5) -> DataFrame:
    """Rows whose value isn't an outlier of its group.

    mad: within factor scaled deviations (1.4826 times the median one) of the median; all stay where that
    scale is at most 1e-12. iqr: within iqr_factor quartile distances of the quartiles. none: all that aren't
    null. Statistics are grouped and joined back, so a large group isn't gathered for a window.
    """
    rows = rows.where(F.col(value).isNotNull())
    if method == "none":
        return rows
    keys = list(keys)
    if method == "iqr":
        quart = rows.groupBy(*keys).agg(F.percentile(value, [0.25, 0.75]).alias("_q"))
        spread = F.get("_q", F.lit(1)) - F.get("_q", F.lit(0))
        joined = rows.join(quart, keys) if keys else rows.crossJoin(F.broadcast(quart))  # one row
        return joined.where((F.col(value) >= F.get("_q", F.lit(0)) - iqr_factor * spread) & (F.col(value) <= F.get("_q", F.lit(1)) + iqr_factor * spread)).drop("_q")
    if method != "mad":
        raise ValueError(f"unknown method {method}")

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, keys) if keys else left.crossJoin(F.broadcast(right))  # one row

    centred = attach(rows, rows.groupBy(*keys).agg(F.median(value).alias("_m"))).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    scaled = attach(centred, centred.groupBy(*keys).agg((F.median("_d") * 1.4826).alias("_s")))
    return scaled.where((F.col("_s") <= 1e-12) | (F.col("_d") <= factor * F.col("_s"))).drop("_m", "_d", "_s")


def trimmed_median(rows: DataFrame, keys: Sequence[str], value: str, trim: float = 0.1, least: int = 10) -> DataFrame:
    """Median of each group without floor(trim * n) values at each end, from `least` values on."""
    # as many values go at each end, so what is left has the same median
    n = F.count(value)
    dropped = F.when(n >= least, F.floor(n * trim)).otherwise(0)
    return rows.groupBy(*keys).agg(F.median(value).alias("trimmed_median"), (n - 2 * dropped).alias("n_kept")).where("n_kept > 0")


def weighted_median(rows: DataFrame, value: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """First value, in order, at which the weights so far reach half of their sum.

    Equal values are added up first; then one row a different value goes to the window.
    """
    each = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    upto = each.withColumn("_c", F.sum("_w").over(Window.partitionBy(*keys).orderBy(value))).withColumn("_t", F.sum("_w").over(Window.partitionBy(*keys)))
    return upto.where(F.col("_c") >= F.col("_t") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"), F.max("_t").alias("total_weight"))


def height_statistics(rows: DataFrame, value: str, keys: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """count, min, five quantiles, max, mean, population deviation, median absolute deviation and quartile distance.

    Quantiles are exact; groups of more than most values are searched through, not gathered.
    """
    keys = list(keys)
    rows = rows.where(F.col(value).isNotNull())
    first = rows.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    names = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    quart = cut(quantiles(rows, keys, value, names, most))
    away = rows.join(quart.select(*keys, "p50"), keys) if keys else rows.crossJoin(F.broadcast(quart.select("p50")))  # one row
    mad = quantiles(away, keys, F.abs(F.col(value) - F.col("p50")), {"mad": 0.5}, most).drop("n")
    joined = first.join(quart, keys).join(mad, keys) if keys else first.crossJoin(F.broadcast(quart)).crossJoin(F.broadcast(mad))  # one row each
    return joined.select(*keys, "n", "min", *names, "max", "mean", "std", "mad", (F.col("p75") - F.col("p25")).alias("iqr"))


def grouping_sets(rows: DataFrame, sets: Sequence[Sequence[str]], measures: Sequence[Column]) -> DataFrame:
    """One row a group of each set; columns outside a set are null, and `grouping` names the set."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    label = F.concat_ws("+", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in every))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, every)).agg(label.alias("grouping"), *measures)


def calibration(rows: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """All bins of a score in [0, 1], the last closed: rows, mean score, share of truth."""
    spine = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = F.array(*(F.lit(i * (1.0 / bins)) for i in range(bins)))
    binned = rows.where(F.col(score).isNotNull()).withColumn("bin", (F.size(F.filter(edges, lambda e: e <= F.col(score))) - 1).cast("int"))
    found = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(truth).cast("double")).alias("observed"))
    return spine.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def threshold_curve(rows: DataFrame, score: str, truth: str, thresholds: Sequence[float]) -> DataFrame:
    """True and false positives, false negatives, precision, recall and F1 at each threshold, in one pass."""
    counts = [F.count_if((F.col(score) >= t) & c).alias(f"{n}{i}") for i, t in enumerate(thresholds) for n, c in (("tp", F.col(truth) == 1), ("fp", F.col(truth) == 0))]
    one = rows.agg(F.count_if(F.col(truth) == 1).alias("_p"), *counts)
    listed = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), (F.col("_p") - F.col(f"tp{i}")).alias("fn")) for i, t in enumerate(thresholds)))
    flat = one.select(F.explode(listed).alias("s")).select("s.*")
    precision, recall = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp")), ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn"))
    return flat.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", ratio_or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_thresholds(rows: DataFrame, score: str, truth: str, lows: Sequence[float], highs: Sequence[float]) -> DataFrame:
    """Best pair low < high: macro F1 of the two classes (score >= high is 1, <= low is 0, between uncertain).

    Ties go to less uncertainty, then the lower low, then the lower high. All pairs are counted in one pass.
    """
    pairs = [(lo, hi) for lo in lows for hi in highs if lo < hi]
    s, y = F.col(score), F.col(truth)
    cols = []
    for i, (lo, hi) in enumerate(pairs):
        cols += [F.count_if((s >= hi) & (y == 1)).alias(f"a{i}"), F.count_if((s >= hi) & (y == 0)).alias(f"b{i}"), F.count_if((s <= lo) & (y == 0)).alias(f"c{i}"), F.count_if((s <= lo) & (y == 1)).alias(f"d{i}")]
    one = rows.agg(F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_q"), *cols)

    def f1(hit: Column, wrong: Column, total: Column) -> Column:
        return ratio_or_zero(2 * hit, hit + wrong + total)

    listed = F.array(
        *(
            F.struct(
                F.lit(lo).alias("low"), F.lit(hi).alias("high"),
                ((f1(F.col(f"a{i}"), F.col(f"b{i}"), F.col("_p")) + f1(F.col(f"c{i}"), F.col(f"d{i}"), F.col("_q"))) / 2).alias("macro_f1"),
                ratio_or_zero(F.col("_p") + F.col("_q") - F.col(f"a{i}") - F.col(f"b{i}") - F.col(f"c{i}") - F.col(f"d{i}"), F.col("_p") + F.col("_q")).alias("uncertain"),
            )
            for i, (lo, hi) in enumerate(pairs)
        )
    )
    flat = one.select(F.explode(listed).alias("s")).select("s.*").withColumn("macro_f1", F.round("macro_f1", 9))
    return flat.orderBy(F.desc("macro_f1"), "uncertain", "low", "high").limit(1)


def top_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column) -> DataFrame:
    """The first n rows of each group in order; n may be a column of the rows."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group by order, with aggregation alone, so no group is sorted."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_s")).select(*keys, "_s.*")
