"""Joins with checks, intervals, distances and look-ups."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.sources.checkpoints import cut


def strict_join(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str = "right side") -> DataFrame:
    """Inner join in which every left row must find exactly one right row: the query fails otherwise.

    The check is part of the plan: unmatched or repeated keys raise when their rows are computed.
    """
    one = right.withColumn("_hit", F.lit(True)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    joined = left.join(one, list(keys), "left")
    key = F.concat_ws(",", *(F.col(k).cast("string") for k in keys))
    ok = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit(f"{what} has no row for "), key)).cast("boolean")).when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{what} repeats "), key)).cast("boolean")).otherwise(F.lit(True))
    return joined.where(ok).drop("_hit", "_n")


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows without a partner."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def interval_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: float, ends: tuple[str, str] = ("start", "end"), prefix: tuple[str, str] = ("l_", "r_")) -> DataFrame:
    """Pairs of rows with equal keys whose closed intervals meet.

    Intervals are cut into buckets of time, pairs meet by an equi-join on keys and bucket, and a pair is kept
    in the first bucket that both have; so work follows the overlap and not the square of a key's rows.
    """

    def spread(df: DataFrame, p: str) -> DataFrame:
        renamed = df.select(*keys, *(F.col(c).alias(p + c) for c in df.columns if c not in keys))
        first, last = (F.floor(F.col(p + e) / bucket).cast("long") for e in ends)
        return renamed.withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))

    a, b = spread(left, prefix[0]), spread(right, prefix[1])
    ls, le, rs, re = (F.col(p + e) for p in prefix for e in ends)
    return a.join(b, [*keys, "_bucket"]).where((ls <= re) & (rs <= le) & (F.col("_bucket") == F.floor(F.greatest(ls, rs) / bucket).cast("long"))).drop("_bucket")


#: Steps to a cell and the eight around it.
_AROUND = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))


def near_pairs(rows: DataFrame, ident: str, x: str, y: str, radius: float, keys: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Pairs (ident, other, distance) of different rows at most radius apart, found through square cells of that size.

    Columns named by carry come along: the row's own by name, the other's with other_ before it.
    """
    own = rows.select(*keys, F.col(ident), F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(x) / radius).alias("_i"), F.floor(F.col(y) / radius).alias("_j"), *(F.col(c).alias(f"_of_{c}") for c in carry))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND))
    other = own.withColumn("_s", F.explode(steps)).select(*keys, F.col(ident).alias("other"), F.col("_x").alias("_ox"), F.col("_y").alias("_oy"), (F.col("_i") + F.col("_s.i")).alias("_i"), (F.col("_j") + F.col("_s.j")).alias("_j"), *(F.col(f"_of_{c}").alias(f"other_{c}") for c in carry))
    distance = F.hypot(F.col("_x") - F.col("_ox"), F.col("_y") - F.col("_oy"))
    met = own.join(other, [*keys, "_i", "_j"]).where(F.col(ident) != F.col("other")).withColumn("distance", distance).where(F.col("distance") <= radius)
    return met.select(*keys, ident, "other", "distance", *(F.col(f"_of_{c}").alias(c) for c in carry), *(f"other_{c}" for c in carry))


#: Places in a chunk of neighbour_counts.
SLOTS = 8


def neighbour_counts(rows: DataFrame, x: str, y: str, radius: float, keys: Sequence[str], name: str) -> DataFrame:
    """rows with the number of other rows of equal keys at most radius apart; 0 for rows without a place or keys.

    Rows of one place are counted first. Places of a square are packed into chunks of eight near ones, and chunks meet
    as boxes: those out of reach are left, what lies within the radius as a whole is added as one number, and only where
    the circle's edge may pass are places compared, in the task where chunks meet. Differences, squares and sums keep
    their order when rounded, so boxes decide exactly as their places would.
    """
    side = radius * (1 + 2.0**-20)  # a little more, so that rounded quotients of rows that meet are never two squares apart
    most = radius * radius  # becomes the greatest square whose root is at most radius
    while math.sqrt(most) > radius:
        most = math.nextafter(most, 0)
    while math.sqrt(math.nextafter(most, math.inf)) <= radius:
        most = math.nextafter(most, math.inf)
    block = [*keys, "_i", "_j"]
    chunk = [*block, "_s", "_c"]
    real = (F.abs(F.col(x).cast("double")) < math.inf) & (F.abs(F.col(y).cast("double")) < math.inf)
    places = rows.where(real).groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count("*").alias("_n"))
    packed = places.withColumns({"_i": F.floor(F.col("_x") / side), "_j": F.floor(F.col("_y") / side)}).withColumn("_all", F.count("*").over(Window.partitionBy(*block)))
    strip = F.ceil(F.sqrt(F.col("_all") / SLOTS)) * SLOTS  # as many strips as chunks in a strip
    packed = packed.withColumn("_s", F.floor((F.row_number().over(Window.partitionBy(*block).orderBy("_x", "_y")) - 1) / strip))
    packed = packed.withColumn("_c", F.floor((F.row_number().over(Window.partitionBy(*block, "_s").orderBy("_y", "_x")) - 1) / SLOTS))
    chunks = packed.groupBy(*chunk).agg(F.min("_x").alias("x_low"), F.max("_x").alias("x_high"), F.min("_y").alias("y_low"), F.max("_y").alias("y_high"), F.sum("_n").alias("n"), F.collect_list(F.struct("_x", "_y", "_n")).alias("_places"))
    slot = lambda k, c, empty: F.coalesce(F.get("_places", F.lit(k))[f"_{c}"], F.lit(empty)).alias(f"{c}{k}")
    box = [F.col(c) for c in ("x_low", "x_high", "y_low", "y_high", "n")]
    chunks = chunks.select(*chunk, *box, *(slot(k, c, empty) for k in range(SLOTS) for c, empty in (("x", math.inf), ("y", 0.0), ("n", 0))))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND))
    own = chunks.select(*chunk, *(F.col(c).alias(f"a_{c}") for c in chunks.columns if c not in chunk))
    other = chunks.withColumn("_step", F.explode(steps)).select(*keys, (F.col("_i") + F.col("_step.i")).alias("_i"), (F.col("_j") + F.col("_step.j")).alias("_j"), *(F.col(c).alias(f"b_{c}") for c in chunks.columns if c not in chunk))
    reach = lambda dx, dy: dx * dx + dy * dy <= most
    over, under = ({c: F.col(f"a_{c}_high") - F.col(f"b_{c}_low") for c in "xy"}, {c: F.col(f"b_{c}_high") - F.col(f"a_{c}_low") for c in "xy"})
    met = own.join(other.hint("merge"), block).where(reach(*(F.greatest(F.lit(0.0), -over[c], -under[c]) for c in "xy")))
    met = met.withColumn("_whole", reach(*(F.greatest(over[c], under[c]) for c in "xy")))

    def near(k: int) -> Column:
        hits = (F.when(reach(F.col(f"a_x{k}") - F.col(f"b_x{j}"), F.col(f"a_y{k}") - F.col(f"b_y{j}")), F.col(f"b_n{j}")).otherwise(0) for j in range(SLOTS))
        return F.sum(F.when(F.col("_whole"), F.col("b_n")).otherwise(functools.reduce(operator.add, hits)))

    sums = met.groupBy(*chunk).agg(*(near(k).alias(f"n{k}") for k in range(SLOTS)), *(F.min(f"a_{c}{k}").alias(f"{c}{k}") for k in range(SLOTS) for c in "xy"))
    each = F.explode(F.array(*(F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"), F.col(f"n{k}").alias("n")) for k in range(SLOTS))))
    counts = sums.select(*keys, each.alias("_p")).where(F.col("_p.x") < math.inf).select(*keys, F.col("_p.x").alias(x), F.col("_p.y").alias(y), (F.col("_p.n") - 1).alias(name))
    return rows.join(counts, [*keys, x, y], "left").withColumn(name, F.coalesce(name, F.lit(0)))


#: Width of blocks up to which cells look for their nearest target among blocks around; beyond it distances are transformed.
NEAR = 64


def _envelope(x: np.ndarray, f: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least (at - x)^2 + f over all x, for sorted different whole x: the lower envelope of parabolas, found in one pass."""
    top, cuts = [0], []
    xs, fs = x.tolist(), f.tolist()
    for k in range(1, len(xs)):
        while True:
            i = top[-1]
            meet = ((fs[k] + xs[k] * xs[k]) - (fs[i] + xs[i] * xs[i])) / (2 * (xs[k] - xs[i]))
            if not cuts or meet > cuts[-1]:
                break
            top.pop()
            cuts.pop()
        top.append(k)
        cuts.append(meet)
    top, place = np.array(top), np.searchsorted(np.array(cuts), at)
    best = None
    for step in (-1, 0, 1):  # the neighbours too, because where two parabolas meet is rounded
        k = top[np.clip(place + step, 0, len(top) - 1)]
        d = (at - x[k]) ** 2 + f[k]
        best = d if best is None else np.minimum(best, d)
    return best


def distance_transform(source: DataFrame, target: DataFrame) -> DataFrame:
    """source cells (ix, iy) with the distance to the nearest target cell, exact, in work that grows with rows of sources times columns of targets.

    First each column of targets gives its nearest one for every row that a source asks for, by two running
    windows; then a row's columns are parabolas, whose lower envelope is read at its sources. A task holds a
    column or a row. Without targets there are no rows.
    """
    source, target = source.select("ix", "iy").distinct(), target.select("ix", "iy").distinct()
    low, high = source.agg(F.min("iy"), F.max("iy")).first()
    if low is None:
        return source.withColumn("distance", F.lit(None).cast("double"))
    asked = target.select("ix").distinct().withColumn("iy", F.explode(F.sequence(F.lit(low), F.lit(high)))).join(source.select("iy").distinct(), "iy", "left_semi")
    both = asked.select("ix", "iy", F.lit(None).cast("long").alias("_t")).unionByName(target.select("ix", "iy", F.col("iy").alias("_t")))
    up, down = Window.partitionBy("ix").orderBy("iy"), Window.partitionBy("ix").orderBy(F.desc("iy"))
    near = both.withColumn("_b", F.max("_t").over(up)).withColumn("_a", F.min("_t").over(down)).where("_t IS NULL")
    columns = near.select("ix", "iy", F.least(F.col("iy") - F.col("_b"), F.col("_a") - F.col("iy")).alias("_g"))

    def row(own: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(seen):
            return pd.DataFrame({"ix": [], "iy": [], "distance": []})
        seen = seen.sort_values("ix")
        d2 = _envelope(seen["ix"].to_numpy(np.int64), seen["_g"].to_numpy(np.int64) ** 2, own["ix"].to_numpy(np.int64))
        return pd.DataFrame({"ix": own["ix"], "iy": own["iy"], "distance": np.sqrt(d2)})

    return source.groupBy("iy").cogroup(columns.groupBy("iy")).applyInPandas(row, "ix long, iy long, distance double")


def nearest_distance(source: DataFrame, target: DataFrame, reach: int = 4, near: int = NEAR) -> DataFrame:
    """source cells (ix, iy) with the distance to the nearest target cell; exact, null without targets.

    Rounds of growing blocks: in a round of width w each cell still open meets the targets of its own and the
    eight blocks around by an equi-join; a distance of at most w is final, because nothing outside them can
    be nearer. The width grows fourfold up to near; what is farther from any target goes to
    distance_transform, so that far masks don't meet in pairs.
    """
    cells = lambda m: cut(m.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy")).distinct())
    left, found = cells(source), cells(target)
    target = found.select(F.col("ix").alias("tx"), F.col("iy").alias("ty"))
    if left.isEmpty() or target.isEmpty():
        return left.withColumn("distance", F.lit(None).cast("double"))
    done, width = None, reach
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    while width <= near:
        blocks = target.select("tx", "ty", F.floor(F.col("tx") / width).alias("bx"), F.floor(F.col("ty") / width).alias("by"))
        asked = left.withColumn("_s", F.explode(steps)).select("ix", "iy", (F.floor(F.col("ix") / width) + F.col("_s.i")).alias("bx"), (F.floor(F.col("iy") / width) + F.col("_s.j")).alias("by"))
        square = (F.col("ix") - F.col("tx")) * (F.col("ix") - F.col("tx")) + (F.col("iy") - F.col("ty")) * (F.col("iy") - F.col("ty"))
        final = cut(asked.join(blocks, ["bx", "by"]).groupBy("ix", "iy").agg(F.min(square).alias("_d2")).where(F.col("_d2") <= width * width))
        here = final.select("ix", "iy", F.sqrt(F.col("_d2").cast("double")).alias("distance"))
        done = here if done is None else done.unionByName(here)
        left, width = cut(left.join(final.select("ix", "iy"), ["ix", "iy"], "left_anti")), width * 4
        if left.isEmpty():
            return done
    far = distance_transform(left, found)
    return far if done is None else done.unionByName(far)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, name: str) -> DataFrame:
    """left with the last value of right at or before its time: one window over the union, no join of pairs.

    Of several right rows at that time the greatest value counts.
    """
    a = left.withColumn("_kind", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.groupBy(*keys, time).agg(F.max(value).alias("_v")).withColumn("_kind", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(time, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("_v", ignorenulls=True).over(before)).where("_kind = 1").drop("_kind", "_v")


def retrieve(queries: DataFrame, library: DataFrame, features: Sequence[str], weights: Sequence[float], k: int, query_id: str, case_id: str) -> DataFrame:
    """The k library rows nearest to each query by weighted Euclidean distance, with similarity 1 / (1 + d).

    Ties go to the lesser case_id. The queries are the small side and given in full; each case meets each
    query once, and only k rows a query and partition go on to the final order.
    """
    square = sum(((F.col(f"q_{f}") - F.col(f)) * (F.col(f"q_{f}") - F.col(f)) * F.lit(float(w)) for f, w in zip(features, weights)), F.lit(0.0))
    q = queries.select(F.col(query_id).alias("query"), *(F.col(f).alias(f"q_{f}") for f in features))
    scored = library.join(q, F.lit(True)).withColumn("distance", F.sqrt(square)).withColumn("similarity", 1 / (1 + F.col("distance")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", case_id))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).drop(*(f"q_{f}" for f in features))


def retrieve_vectors(query: Column, library: DataFrame, vector: str, weights: Column, k: int, case_id: str) -> DataFrame:
    """As retrieve, for one query vector against array columns: top-k is taken before rows come together."""
    pairs = F.zip_with(F.zip_with(F.col(vector), query, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), weights, lambda d, w: d * w)
    distance = F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))
    return library.withColumn("distance", distance).withColumn("similarity", 1 / (1 + F.col("distance"))).orderBy("distance", case_id).limit(k)


def labels_or_default(rows: DataFrame, labels: DataFrame, keys: Sequence[str], label: str, default) -> DataFrame:
    """Left join to labels; rows without one get default."""
    return rows.join(labels.select(*keys, label), list(keys), "left").withColumn(label, F.coalesce(F.col(label), F.lit(default)))
