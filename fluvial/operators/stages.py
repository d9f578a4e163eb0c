"""Stages over whole tables in which a row's failure is a row: its stage and reason stay, and later stages leave it alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.functions.exprs import ratio_or_zero
from fluvial.operators import evidence
from fluvial.sources.checkpoints import cut


@dataclass(frozen=True)
class Stage:
    """run adds columns to the rows that are still good and keeps their keys; of checks, the first that holds is the reason a row fails.

    A row that run doesn't give back fails as no_result; one that it gives back twice is an error. A check
    that is null doesn't hold, unless the row should fail so: then say it with coalesce.
    """

    name: str
    run: Callable[[DataFrame], DataFrame]
    checks: Callable[[], Sequence[tuple[str, Column]]] = lambda: ()


def run_stages(rows: DataFrame, keys: Sequence[str], stages: Sequence[Stage]) -> DataFrame:
    """rows, whose keys are unique, with the columns of all stages, failed_stage and reason (null for those that passed all).

    No row is lost. What a failed row has of later stages' columns is null. Each stage's rows are written once.
    """
    keys = list(keys)
    good, out = cut(rows), None
    for stage in stages:
        made = stage.run(good)
        lost = set(good.columns) - set(made.columns)
        if lost:
            raise ValueError(f"{stage.name} loses {sorted(lost)}")
        once = good.select(*keys).join(made.withColumn("_made", F.lit(True)), keys, "left")
        reason = F.when(F.col("_made").isNull(), F.lit("no_result"))
        for name, holds in stage.checks():
            reason = reason.when(holds, name)
        judged = cut(once.withColumn("reason", reason).withColumn("failed_stage", F.when(F.col("reason").isNotNull(), stage.name)))
        if not judged.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"{stage.name} gives a key twice")
        failed = judged.where("reason IS NOT NULL")
        # what a lost row had before comes back from the stage's input
        failed = good.join(failed.select(*keys, *(c for c in failed.columns if c not in good.columns)), keys).drop("_made")
        out = failed if out is None else out.unionByName(failed, allowMissingColumns=True)
        good = judged.where("reason IS NULL").drop("_made", "reason", "failed_stage")
    none = F.lit(None).cast("string")
    good = good.withColumns({"failed_stage": none, "reason": none})
    return good if out is None else good.unionByName(out, allowMissingColumns=True)


def failure_counts(rows: DataFrame) -> DataFrame:
    """One row a failed_stage and reason (passed: both null) with n."""
    return rows.groupBy("failed_stage", "reason").agg(F.count("*").alias("n"))


def mask_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], flag: str = "water") -> DataFrame:
    """IoU of two masks (keys, x, y, flag: every pixel) of each image, 0 for two empty ones, and pixels of the second."""
    both = a.select(*keys, "x", "y", F.col(flag).alias("_a")).join(b.select(*keys, "x", "y", F.col(flag).alias("_b")), [*keys, "x", "y"])
    n = both.groupBy(*keys).agg(F.count_if(F.col("_a") & F.col("_b")).alias("_i"), F.count_if(F.col("_a") | F.col("_b")).alias("_u"), F.count_if("_b").alias("water_pixels"))
    return n.select(*keys, "water_pixels", ratio_or_zero(F.col("_i"), F.col("_u")).alias("iou"))


def temporal_prediction(tracks: DataFrame, images: DataFrame, keys: Sequence[str], width: int, height: int, start: str, half: Column, least_tracks: int = 1, least_iou: float = 0.5, model: dict | None = None, **rule) -> DataFrame:
    """One row an image of images: water tracks, water pixels, iou of the first half's water with the whole's, and where it failed.

    Tracks that start before half (a column of tracks) are the first half. Stages: tracks (no_water_tracks:
    fewer than least_tracks), evidence (no_water), stability (half_sequence_disagrees: iou below least_iou).
    Water is the rule's; with model (options of evidence.model_evidence) the greatest probability is the
    hybrid's, while water stays the rule's.
    """
    keys = list(keys)

    def counted(rows: DataFrame) -> DataFrame:
        n = tracks.where("classification = 'water_ripple'").groupBy(*keys).agg(F.count("*").alias("water_tracks"))
        return rows.join(n, keys, "left").fillna(0, ["water_tracks"])

    def mapped(rows: DataFrame) -> DataFrame:
        own = tracks.join(rows.select(*keys), keys, "left_semi")
        options = ("least_sigma", "reach", "most_tiles")
        same = model is None or {k: model[k] for k in options if k in model} == {k: rule[k] for k in options if k in rule}
        found = evidence.halves(own, keys, width, height, F.col(start) < half, model if same else None, **rule).withColumnRenamed("iou", "_iou")
        if not same:  # the model's kernels aren't the rule's
            both = evidence.hybrid(evidence.rule_evidence(own, keys, width, height, **rule), evidence.model_evidence(own, keys, width, height, **model), keys)
            found = found.drop("greatest").join(both.groupBy(*keys).agg(F.max("probability").alias("greatest")), keys)
        return rows.join(found.select(*keys, "water_pixels", "greatest", "_iou"), keys)

    def steady(rows: DataFrame) -> DataFrame:
        return rows.withColumn("iou", F.col("_iou"))

    return run_stages(images.select(*keys).distinct(), keys, [
        Stage("tracks", counted, lambda: [("no_water_tracks", F.col("water_tracks") < least_tracks)]),
        Stage("evidence", mapped, lambda: [("no_water", F.col("water_pixels") == 0)]),
        Stage("stability", steady, lambda: [("half_sequence_disagrees", F.col("iou") < least_iou)]),
    ]).drop("_iou")
