"""Queries on water levels and on errors against truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvial.operators import evaluation, levels, regions
from fluvial.plans.adapters import NX, NY, POINTS, SCORED, level_of, mask, mask_sql, points, raster, raster_sql, scored, table
from fluvial.plans.rasters import _components_sql
from fluvial.plans.registry import query, r4

_HEIGHTS = f"""{POINTS}, {mask_sql()}, {raster_sql()}"""
_LABELLED = f"WITH RECURSIVE {_HEIGHTS}, {_components_sql('mask', False)}, sz AS (SELECT component, count(*) AS cells FROM labelled GROUP BY component HAVING count(*) >= 3), k AS (SELECT l.* FROM labelled l JOIN sz USING (component)), pts AS (SELECT ix, iy, z FROM raster)"


@query("boundary_water_levels", f"""{_LABELLED}, inn AS (SELECT a.component, a.ix, a.iy FROM k a WHERE (SELECT count(*) FROM k b WHERE b.component = a.component AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1) < 9), h AS (SELECT component, z FROM inn JOIN pts USING (ix, iy)),
m AS (SELECT component, median(z) AS m FROM h GROUP BY component), s AS (SELECT h.component, median(abs(z - m)) * 1.4826 AS s FROM h JOIN m USING (component) GROUP BY h.component), f AS (SELECT h.component, z FROM h JOIN m USING (component) JOIN s USING (component) WHERE s <= 1e-12 OR abs(z - m) <= 3.5 * s)
SELECT sz.component, cells, count(z) AS samples, CASE WHEN count(z) >= 3 THEN round(median(z), 4) END AS level FROM sz LEFT JOIN f ON f.component = sz.component GROUP BY sz.component, cells""")
def boundary_water_levels(spark, d):
    found = levels.boundary_levels(mask(spark, d), raster(spark, d), "z", NX, NY, "inner_median", least_cells=3, least_samples=3)
    return found.select("component", "cells", "samples", r4("level"))


@query("bracketed_water_level")
def bracketed_water_level(spark, d):
    found = levels.boundary_levels(mask(spark, d), raster(spark, d), "z", NX, NY, least_cells=3, least_samples=3, order_tolerance=500.0, widest=5000.0)
    return levels.overall_level(found).select(r4("level"), "total_weight")


@query("shoreline_levels", f"""WITH {POINTS}, m AS (SELECT case_id, frame, median(z) AS m FROM points GROUP BY ALL), s AS (SELECT case_id, frame, median(abs(z - m)) * 1.4826 AS s FROM points JOIN m USING (case_id, frame) GROUP BY ALL)
SELECT case_id, frame, count(*) AS samples, round(median(z), 4) AS level FROM points JOIN m USING (case_id, frame) JOIN s USING (case_id, frame) WHERE s <= 1e-12 OR abs(z - m) <= 3.5 * s GROUP BY ALL""")
def shoreline_levels(spark, d):
    return levels.shoreline_levels(points(spark, d), ["case_id", "frame"], "z").select("case_id", "frame", "samples", r4("level"))


@query("supported_basins")
def supported_basins(spark, d):
    rows = raster(spark, d)
    seeds = spark.range(1).select(F.lit(0).cast("long").alias("ix"), F.lit(0).cast("long").alias("iy"))
    basins = regions.seeded_basins(rows.crossJoin(F.broadcast(level_of(rows))), "z", F.col("level"), seeds)  # one row
    support = basins.select("component", (F.col("cells") * 8).alias("projected"), (F.col("cells") * (F.col("component") % 3) * 4).alias("overlap"))
    return levels.supported_basins(basins, support).select("component", "cells", "seeds", r4("precision"), "status")


@query("waterline_depth", f"""WITH {_HEIGHTS}, inn AS (SELECT m.ix, m.iy FROM mask m WHERE (SELECT count(*) FROM mask n WHERE abs(n.ix - m.ix) <= 1 AND abs(n.iy - m.iy) <= 1) < 9), h AS (SELECT z, row_number() OVER (ORDER BY z) AS r, count(*) OVER () AS n FROM inn JOIN raster USING (ix, iy)),
l AS (SELECT median(z) AS level FROM h WHERE r > CASE WHEN n >= 10 THEN floor(n * 0.1) ELSE 0 END AND r <= n - CASE WHEN n >= 10 THEN floor(n * 0.1) ELSE 0 END), dd AS (SELECT greatest(0, level - z) AS dep FROM mask JOIN raster USING (ix, iy), l)
SELECT round(max(level), 4) AS level, (SELECT count(*) FROM h) AS boundary_cells, (SELECT round(stddev_pop(z), 4) FROM h) AS boundary_std, count(*) AS cells, round(sum(dep) * 0.25::DOUBLE, 4) AS volume, round(max(dep), 4) AS max_depth, round(count(*) / greatest(1, (SELECT count(*) FROM mask))::DOUBLE, 4) AS valid_ratio FROM dd, l""")
def waterline_depth(spark, d):
    found = levels.waterline_depth(mask(spark, d), raster(spark, d), "z", 0.25)
    return found.select(r4("level"), "boundary_cells", r4("boundary_std"), "cells", r4("volume"), r4("max_depth"), r4("valid_ratio"))


_PAIRED = f"{POINTS}, {raster_sql('p', 0.2)}, {raster_sql('t', 0.5)}, c AS (SELECT p.ix, p.iy, p.z AS a, t.z AS b FROM p JOIN t USING (ix, iy))"


@query("depth_errors", f"""WITH {_PAIRED}, u AS (SELECT 'all' AS domain, a - b AS e FROM c UNION ALL SELECT 'left', a - b FROM c WHERE ix < 5 UNION ALL SELECT 'low', a - b FROM c WHERE iy < 4)
SELECT domain, count(*) AS cells, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(median(abs(e)), 4) AS median_absolute, round(max(abs(e)), 4) AS max_absolute, round(avg(e), 4) AS bias FROM u GROUP BY domain UNION ALL SELECT 'none', 0, NULL, NULL, NULL, NULL, NULL""")
def depth_errors(spark, d):
    both = raster(spark, d).select("ix", "iy", F.col("z").alias("a")).join(raster(spark, d, 0.5).select("ix", "iy", F.col("z").alias("b")), ["ix", "iy"])
    found = evaluation.depth_errors(both, "a", "b", {"all": F.lit(True), "left": F.col("ix") < 5, "low": F.col("iy") < 4, "none": F.lit(False)})
    return found.select("domain", "cells", *(r4(c) for c in ("mae", "rmse", "median_absolute", "max_absolute", "bias")))


@query("measure_errors", "SELECT l_orderkey, l_linenumber, measure, round(p - t, 4) AS error, round(abs(p - t), 4) AS absolute, CASE WHEN t <> 0 THEN round(abs(p - t) * 100 / abs(t), 4) END AS relative_percent FROM (SELECT l_orderkey, l_linenumber, 'tax' AS measure, l_tax::DOUBLE AS p, l_discount::DOUBLE AS t FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'quantity', l_quantity::DOUBLE, 25.0::DOUBLE FROM lineitem)")
def measure_errors(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("tax"), F.col("l_discount").alias("tax_true"), F.col("l_quantity").alias("quantity"), F.lit(25.0).alias("quantity_true"))
    return evaluation.errors(rows, ["l_orderkey", "l_linenumber"], ["tax", "quantity"]).select("l_orderkey", "l_linenumber", "measure", r4("error"), r4("absolute"), r4("relative_percent"))


@query("near_truth", f"WITH {POINTS} SELECT case_id, count(*) AS n, round(avg((abs(z - 38000) <= 1000)::INTEGER), 4) AS within_near, round(avg((abs(z - 38000) <= 5000)::INTEGER), 4) AS within_far, round(100 * avg((z <= 38000)::INTEGER), 4) AS truth_percentile FROM points GROUP BY case_id")
def near_truth(spark, d):
    found = evaluation.near_truth(points(spark, d).withColumn("t", F.lit(38000.0)), ["case_id"], "z", "t", {"near": 1000.0, "far": 5000.0})
    return found.select("case_id", "n", r4("within_near"), r4("within_far"), r4("truth_percentile"))


@query("failure_modes", f"WITH {SCORED}, m AS (SELECT doc_id, score AS p, round((doc_id % 100) / 100.0::DOUBLE + 0.2, 4) AS r, (doc_id % 9)::DOUBLE AS b FROM scored) SELECT CASE WHEN p >= 0.9 AND r >= 0.9 AND b <= 5 THEN 'none_observed' WHEN p < 0.9 AND r >= 0.9 THEN 'oversegmentation' WHEN r < 0.9 AND p >= 0.9 THEN 'undersegmentation' ELSE 'mixed' END AS failure_mode, count(*) AS n FROM m GROUP BY 1")
def failure_modes(spark, d):
    rows = scored(spark, d).select("doc_id", F.col("score").alias("precision"), F.round((F.col("doc_id") % 100) / 100.0 + 0.2, 4).alias("recall"), F.col("score").alias("iou"), (F.col("doc_id") % 9).cast("double").alias("boundary_p95"))
    return evaluation.failure_mode(rows).groupBy("failure_mode").agg(F.count("*").alias("n"))


@query("method_summary", "WITH r AS (SELECT l_orderkey, l_returnflag AS method, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey, v AS base FROM r WHERE method = 'N') SELECT method, count(*) AS n, round(avg(v - base), 4) AS mean_change, round(median(v - base), 4) AS median_change, count(*) FILTER (v - base > 1e-9) AS improved, count(*) FILTER (v - base < -1e-9) AS worsened, count(*) FILTER (abs(v - base) <= 1e-9) AS unchanged FROM r JOIN b USING (l_orderkey) WHERE method <> 'N' GROUP BY method")
def method_summary(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("method")).agg(F.avg("l_quantity").alias("v"))
    found = evaluation.against_baseline(rows, ["l_orderkey"], "method", "N", "v")
    return found.select("method", "n", r4("mean_change"), r4("median_change"), "improved", "worsened", "unchanged")


@query("reason_counts", "SELECT kind, reason, count(*) AS n FROM (SELECT 'hard' AS kind, 'large' AS reason FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT 'hard', 'late' FROM lineitem WHERE l_linenumber > 5 UNION ALL SELECT 'soft', 'cheap' FROM lineitem WHERE l_extendedprice < 5000) GROUP BY 1, 2")
def reason_counts(spark, d):
    from fluvial.functions.exprs import reasons

    rows = table(spark, d, "lineitem").select(reasons([("large", F.col("l_quantity") > 40), ("late", F.col("l_linenumber") > 5)]).alias("hard"), reasons([("cheap", F.col("l_extendedprice") < 5000)]).alias("soft"))
    return evaluation.reason_counts(rows, ["hard", "soft"])


@query("frozen_inputs", "SELECT CASE WHEN o.o_orderkey % 10 = 0 THEN 'missing' WHEN o.o_orderkey % 7 = 0 THEN 'changed' ELSE 'same' END AS status, count(*) AS n FROM orders o GROUP BY 1")
def frozen_inputs(spark, d):
    digest = lambda c: F.sha2(c.cast("string"), 256)
    rows = table(spark, d, "orders").select("o_orderkey", digest(F.col("o_totalprice")).alias("sha256"))
    now = table(spark, d, "orders").where("o_orderkey % 10 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, digest(F.col("o_totalprice") + 1)).otherwise(digest(F.col("o_totalprice"))).alias("sha256"))
    return evaluation.frozen(rows, now, ["o_orderkey"]).groupBy("status").agg(F.count("*").alias("n"))


@query("split_overlaps", "WITH s AS (SELECT DISTINCT o_orderstatus AS split, o_custkey FROM orders) SELECT o_custkey, string_agg(split, '+' ORDER BY split) AS splits FROM s GROUP BY o_custkey HAVING count(*) > 1")
def split_overlaps(spark, d):
    return evaluation.split_overlaps(table(spark, d, "orders"), "o_orderstatus", "o_custkey").select("o_custkey", F.concat_ws("+", "splits").alias("splits"))


@query("macro_micro", f"WITH {SCORED}, r AS (SELECT lang, source, count(*) FILTER (score >= 0.5 AND truth = 1) AS tp, count(*) FILTER (score >= 0.5 AND truth = 0) AS fp, count(*) FILTER (score < 0.5 AND truth = 1) AS fn FROM scored GROUP BY lang, source) SELECT lang, count(*) AS n, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END), 4) AS macro_f1, round(CASE WHEN sum(tp + fp) > 0 THEN sum(tp) / sum(tp + fp) ELSE 0 END::DOUBLE, 4) AS micro_precision, round(CASE WHEN sum(tp + fn) > 0 THEN sum(tp) / sum(tp + fn) ELSE 0 END::DOUBLE, 4) AS micro_recall, round(CASE WHEN sum(2 * tp + fp + fn) > 0 THEN 2 * sum(tp) / sum(2 * tp + fp + fn) ELSE 0 END::DOUBLE, 4) AS micro_f1 FROM r GROUP BY lang")
def macro_micro(spark, d):
    s, t = F.col("score") >= 0.5, F.col("truth")
    rows = scored(spark, d).groupBy("lang", "source").agg(F.count_if(s & (t == 1)).alias("tp"), F.count_if(s & (t == 0)).alias("fp"), F.count_if(~s & (t == 1)).alias("fn"))
    found = evaluation.macro_micro(rows, ["lang"])
    return found.select("lang", "n", r4("macro_f1"), r4("micro_precision"), r4("micro_recall"), r4("micro_f1"))
