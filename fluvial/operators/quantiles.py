"""Exact quantiles of groups of any size, by selection: no task holds more than a stated number of a group's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.sources.checkpoints import cut

#: Values of one group that a task may hold.
MOST = 1 << 20
#: Bins that a round cuts the range of a wanted value into.
BINS = 1024
#: Up to so many wanted values they are sent to all tasks: three numbers and the keys of each.
FEW = 10_000


def _meet(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    """Each row with the wanted values of its group. Beyond FEW of them it is a join that adaptive execution splits where a group is large."""
    side = F.broadcast(wanted) if few else wanted
    return rows.join(side, [*keys]) if keys else rows.crossJoin(side)  # without keys there are two wanted values a quantile


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, wanted: DataFrame, most: int = MOST, bins: int = BINS, most_rounds: int = 200) -> DataFrame:
    """wanted (keys, name, rank from 0) with `found`, the value of that rank within its group, by rounds over rows.

    A round counts the values of a wanted one's range in equal bins, keeps the bin that holds it with its own
    least and greatest value, and so on until the bin holds at most `most` values, or equal ones alone. A bin
    never holds both ends of its range, so every round gets on; ranges shrink by `bins` in each. Values must be
    finite and not null; ranks must lie in their groups.
    """
    if bins < 2:
        raise ValueError("bins must be at least 2")
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    open_ = cut(wanted.join(ends, [*keys]) if keys else wanted.crossJoin(ends))  # one row of ends
    who = [*keys, "name"]
    done, state = None, ["rank", "_lo", "_hi", "_n"]
    for _ in range(most_rounds):
        equal = open_.where("_lo = _hi").select(*who, F.col("_lo").alias("found"))
        done = equal if done is None else done.unionByName(equal)
        open_ = open_.where("_lo < _hi")
        small = cut(open_.where(F.col("_n") <= most))
        if not small.isEmpty():
            near = _meet(rows, small, keys, small.count() <= FEW).where("_v >= _lo AND _v <= _hi")
            listed = near.groupBy(*who).agg(F.sort_array(F.collect_list("_v")).alias("_l"), F.first("rank").alias("_r"))  # at most `most` values
            done = done.unionByName(cut(listed.select(*who, F.get("_l", F.col("_r").cast("int")).alias("found"))))
        open_ = cut(open_.where(F.col("_n") > most).select(*who, *state))
        n = open_.count()
        if not n:
            return done
        # halves, because the width of a range may be too large for a double
        part = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bin_ = F.least(F.lit(bins - 1), F.floor(part * bins)).cast("int")
        inside = _meet(rows, open_, keys, n <= FEW).where("_v >= _lo AND _v <= _hi")
        counted = inside.groupBy(*who, bin_.alias("_bin")).agg(F.first("rank").alias("rank"), F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        listed = counted.groupBy(*who).agg(F.first("rank").alias("rank"), F.sort_array(F.collect_list(F.struct("_bin", "_n", "_lo", "_hi"))).alias("_l"))  # at most `bins` of them
        zero = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("struct<_bin:int,_n:bigint,_lo:double,_hi:double>").alias("bin"))
        walk = F.aggregate("_l", zero, lambda s, b: F.when(s["bin"].isNotNull(), s).when(F.col("rank") < s["before"] + b["_n"], F.struct(s["before"].alias("before"), b.alias("bin"))).otherwise(F.struct((s["before"] + b["_n"]).alias("before"), s["bin"].alias("bin"))))
        chosen = listed.select(*who, "rank", walk.alias("_s"))
        open_ = cut(chosen.select(*who, (F.col("rank") - F.col("_s.before")).alias("rank"), "_s.bin._lo", "_s.bin._hi", "_s.bin._n"))
    raise RuntimeError("selection didn't settle")


def quantiles(rows: DataFrame, keys: Sequence[str], value: str | Column, q: dict[str, float], most: int = MOST, bins: int = BINS) -> DataFrame:
    """One row a group with its exact quantiles, linearly interpolated as percentile does, and `n`, the values counted.

    Groups of at most `most` values go through percentile; larger ones through order_statistics, two for each
    quantile. Null and non-finite values are left out; a group without others has no row.
    """
    keys = list(keys)
    if any(not 0 <= p <= 1 for p in q.values()):
        raise ValueError("quantiles lie between 0 and 1")
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = rows.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf")))
    sizes = cut(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 0"))
    large = sizes.where(F.col("n") > most)
    plain = [F.percentile("_v", float(p)).alias(n) for n, p in q.items()]
    if large.isEmpty():
        return rows.groupBy(*keys).agg(F.count("*").alias("n"), *plain).where("n > 0").select(*keys, *q, "n")
    at = {n: F.col("n") * F.lit(float(p)) - F.lit(float(p)) for n, p in q.items()}  # q * (n - 1)
    sides = F.array(*(F.struct(F.lit(f"{n}/{s}").alias("name"), f(at[n]).cast("long").alias("rank")) for n in q for s, f in (("low", F.floor), ("high", F.ceil))))
    wanted = large.select(*keys, "n", F.explode(sides).alias("_w")).select(*keys, "_w.name", "_w.rank")
    found = order_statistics(rows, keys, "_v", wanted, most, bins)
    wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == f"{n}/{s}", F.col("found"))).alias(f"{n}/{s}") for n in q for s in ("low", "high")))
    wide = large.join(wide, keys) if keys else large.crossJoin(wide)  # one row each

    def between(n: str) -> Column:
        low, high, p = F.col(f"`{n}/low`"), F.col(f"`{n}/high`"), at[n]
        return F.when(F.floor(p) == F.ceil(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(n)

    out = wide.select(*keys, *map(between, q), "n")
    if not keys:
        return out
    few = sizes.where(F.col("n") <= most).select(*keys)
    return out.unionByName(rows.join(few, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("n"), *plain).select(*keys, *q, "n"))


def median_deviation(rows: DataFrame, keys: Sequence[str], value: str, most: int = MOST) -> DataFrame:
    """Median of each group and the median distance from it (`median`, `mad`, `n`), both exact."""
    keys = list(keys)
    centre = quantiles(rows, keys, value, {"median": 0.5}, most)
    held = cut(centre)
    away = rows.join(held.select(*keys, "median"), keys) if keys else rows.crossJoin(F.broadcast(held.select("median")))  # one row
    mad = quantiles(away, keys, F.abs(F.col(value) - F.col("median")), {"mad": 0.5}, most)
    return held.join(mad.drop("n"), keys) if keys else held.crossJoin(F.broadcast(mad.drop("n")))  # one row
