"""Errors of predictions against truth. Prediction modules don't import this one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.functions.exprs import ratio_or_null


def errors(rows: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Long form: signed, absolute and relative error of each measure m from columns m and m_true; relative is null where truth is 0."""
    listed = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("predicted"), F.col(f"{m}_true").cast("double").alias("truth")) for m in measures))
    flat = rows.select(*keys, F.explode(listed).alias("e")).select(*keys, "e.*").withColumn("error", F.col("predicted") - F.col("truth"))
    return flat.withColumns({"absolute": F.abs("error"), "relative_percent": ratio_or_null(F.abs("error") * 100, F.abs("truth"))})


def depth_errors(cells: DataFrame, predicted: str, truth: str, domains: dict[str, Column]) -> DataFrame:
    """One row a domain: cells, MAE, RMSE, median and greatest absolute error, bias; nulls for an empty one."""
    e = F.col(predicted) - F.col(truth)
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in domains.items())), lambda x: x.isNotNull())
    spread = cells.select(F.explode(names).alias("domain"), e.alias("_e")).where("_e IS NOT NULL")
    found = spread.groupBy("domain").agg(F.count("*").alias("cells"), F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.median(F.abs("_e")).alias("median_absolute"), F.max(F.abs("_e")).alias("max_absolute"), F.avg("_e").alias("bias"))
    spine = cells.sparkSession.createDataFrame([(n,) for n in domains], "domain string")
    return spine.join(found, "domain", "left").withColumn("cells", F.coalesce("cells", F.lit(0)))


def near_truth(heights: DataFrame, keys: Sequence[str], value: str, truth: str, tolerances: dict[str, float]) -> DataFrame:
    """Share of heights within each tolerance of the truth, and the truth's percentile among them."""
    d = F.abs(F.col(value) - F.col(truth))
    return heights.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg((d <= t).cast("double")).alias(f"within_{n}") for n, t in tolerances.items()), (100 * F.avg((F.col(value) <= F.col(truth)).cast("double"))).alias("truth_percentile"))


def main_basin(basins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The basin that overlaps a prediction most; ties go to more projected pixels, more cells, then the lesser number."""
    best = F.max_by(F.struct("component", "cells", "overlap"), F.struct("overlap", "projected", "cells", -F.col("component")))
    return basins.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def failure_mode(rows: DataFrame, precision: str = "precision", recall: str = "recall", iou: str = "iou", boundary: str = "boundary_p95", least: float = 0.90, farthest: float = 5.0) -> DataFrame:
    """none_observed, oversegmentation, undersegmentation, or mixed, from mask metrics; a missing boundary isn't good."""
    p, r, i = F.col(precision) >= least, F.col(recall) >= least, F.col(iou) >= least
    good = i & r & F.coalesce(F.col(boundary) <= farthest, F.lit(False))
    return rows.withColumn("failure_mode", F.when(good, "none_observed").when(~p & r, "oversegmentation").when(~r & p, "undersegmentation").otherwise("mixed"))


def against_baseline(rows: DataFrame, keys: Sequence[str], method: str, baseline: str, metric: str, tolerance: float = 1e-9) -> DataFrame:
    """One row a method: mean and median change of a metric against the baseline's row of the same key, and how many improved."""
    base = rows.where(F.col(method) == baseline).select(*keys, F.col(metric).alias("_base"))
    d = F.col(metric) - F.col("_base")
    return rows.where(F.col(method) != baseline).join(base, list(keys)).groupBy(method).agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_change"), F.median(d).alias("median_change"), F.count_if(d > tolerance).alias("improved"), F.count_if(d < -tolerance).alias("worsened"), F.count_if(F.abs(d) <= tolerance).alias("unchanged")
    )


def reason_counts(rows: DataFrame, reasons: Sequence[str]) -> DataFrame:
    """(kind, reason, n) over arrays of reasons."""

    def of(kind: str) -> Column:
        return F.transform(F.coalesce(kind, F.array().cast("array<string>")), lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("reason")))

    listed = F.flatten(F.array(*map(of, reasons)))
    return rows.select(F.explode(listed).alias("r")).groupBy("r.kind", "r.reason").agg(F.count("*").alias("n"))


def frozen(expected: DataFrame, present: DataFrame, keys: Sequence[str], digest: str = "sha256") -> DataFrame:
    """expected with status same, changed or missing, by digest."""
    now = present.select(*keys, F.col(digest).alias("_now"))
    status = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col(digest), "same").otherwise("changed")
    return expected.join(now, list(keys), "left").withColumn("status", status).drop("_now")


def split_overlaps(splits: DataFrame, split: str, value: str) -> DataFrame:
    """Values that more than one split holds."""
    return splits.groupBy(value).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def macro_micro(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group of rows with tp, fp, fn: mean of the rows' F1, and precision, recall and F1 of the sums; 0 where nothing counts."""
    f1 = lambda tp, fp, fn: F.coalesce(F.try_divide(2.0 * tp, (2 * tp + fp + fn).cast("double")), F.lit(0.0))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    zero = lambda n, d: F.coalesce(ratio_or_null(n, d), F.lit(0.0))
    return rows.withColumn("_f", f1(F.col("tp"), F.col("fp"), F.col("fn"))).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_f").alias("macro_f1"), zero(tp, tp + fp).alias("micro_precision"), zero(tp, tp + fn).alias("micro_recall"), f1(tp, fp, fn).alias("micro_f1"))


def classification_metrics(rows: DataFrame, water: Column, dry: Column, probability: Column, low: float, high: float, noise: Column | None = None) -> DataFrame:
    """One row: precision, recall and F1 of both classes with abstention between low and high, macro F1, Brier score, confusion.

    Ratios without a denominator are 0, and so are means over no rows. A row that is neither water nor dry counts as
    a false call of either. noise marks rows, dry ones as a rule, of which noise_called_water counts the calls of water.
    """
    noise = F.lit(False) if noise is None else F.coalesce(noise, F.lit(False))
    marks = rows.select(F.coalesce(water, F.lit(False)).alias("w"), F.coalesce(dry, F.lit(False)).alias("d"), noise.alias("n"), probability.alias("p"))
    marks = marks.withColumns({"pw": F.col("p") >= high, "pd": F.col("p") <= low}).withColumn("pu", ~(F.col("pw") | F.col("pd")))
    cells = {f"{a}_{b}": F.count_if(F.col(a[0]) & F.col(f"p{b[0]}")) for a in ("water", "dry") for b in ("water", "dry", "uncertain")}
    cells["noise_called_water"] = F.count_if(F.col("n") & F.col("pw"))
    both = {"_pw": F.count_if("pw"), "_pd": F.count_if("pd"), "_w": F.count_if("w"), "_d": F.count_if("d")}
    square = (F.col("p") - F.col("w").cast("double")) * (F.col("p") - F.col("w").cast("double"))
    one = marks.agg(F.count("*").alias("samples"), *(c.alias(n) for n, c in (cells | both).items()), F.coalesce(F.avg(square), F.lit(0.0)).alias("brier_score"), F.coalesce(F.avg(F.col("pu").cast("double")), F.lit(0.0)).alias("uncertain_rate"))
    zero = lambda n, d: F.coalesce(ratio_or_null(n, d), F.lit(0.0))
    for name in ("water", "dry"):
        hit, called, there = F.col(f"{name}_{name}"), F.col(f"_p{name[0]}"), F.col(f"_{name[0]}")
        one = one.withColumns({f"{name}_precision": zero(hit, called), f"{name}_recall": zero(hit, there), f"{name}_f1": zero(2.0 * hit, called + there)})
    return one.withColumn("macro_f1", (F.col("water_f1") + F.col("dry_f1")) / 2).drop(*both)
