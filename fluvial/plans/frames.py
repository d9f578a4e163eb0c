"""Queries on sequences, robust statistics, groups and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fluvial.functions import exprs
from fluvial.operators import joins, sequences, stats
from fluvial.plans.adapters import FRAMES, POINTS, SCORED, TRACKS, annotations, frames, points, scored, table, tracks
from fluvial.plans.registry import query, r4


@query("rain_class", f"""WITH {FRAMES} SELECT event_id, CASE WHEN v - 5 <= 0 THEN 'no_rain' WHEN v - 5 < 15 THEN 'light_rain' WHEN v - 5 < 30 THEN 'moderate_rain' ELSE 'heavy_rain' END AS label,
  round(CASE WHEN v - 5 <= 0 THEN 0.7 WHEN v - 5 < 15 THEN 1.0 WHEN v - 5 < 30 THEN 1.3 ELSE 1.8 END::DOUBLE, 4) AS factor FROM frames""")
def rain_class(spark, d):
    return frames(spark, d).select("event_id", exprs.rain_class(F.col("v") - 5).alias("c")).select("event_id", "c.label", r4(F.col("c.factor"), "factor"))


def _level_sql(op: str) -> str:
    return f"WITH {FRAMES} SELECT event_id, CASE WHEN round(v) {op} 50 THEN 'orange' WHEN round(v) >= 30 THEN 'yellow' WHEN round(v) >= 15 THEN 'blue' ELSE 'none' END AS level FROM frames"


@query("warning_level_strict", _level_sql(">"))
def warning_level_strict(spark, d):
    return frames(spark, d).select("event_id", exprs.warning_level(F.round("v"), strict_orange=True).alias("level"))


@query("warning_level_inclusive", _level_sql(">="))
def warning_level_inclusive(spark, d):
    return frames(spark, d).select("event_id", exprs.warning_level(F.round("v")).alias("level"))


@query("octants", f"WITH {POINTS} SELECT floor(((atan2(y - 5, x - 25.5) + 2 * pi()) % (2 * pi())) / (pi() / 4))::INTEGER % 8 AS octant, count(*) AS n FROM points GROUP BY 1")
def octants(spark, d):
    return points(spark, d).groupBy(exprs.octant(F.col("x"), F.col("y"), 25.5, 5.0).alias("octant")).agg(F.count("*").alias("n"))


_GROUPED = "round(avg(v), 4) AS mean, count(*) AS n"


@query("mad_filter", f"""WITH {FRAMES}, m AS (SELECT cls, median(v) AS m FROM frames GROUP BY cls), s AS (SELECT cls, median(abs(v - m)) * 1.4826 AS s FROM frames JOIN m USING (cls) GROUP BY cls)
SELECT cls, {_GROUPED} FROM frames JOIN m USING (cls) JOIN s USING (cls) WHERE s <= 1e-12 OR abs(v - m) <= 1.5 * s GROUP BY cls""")
def mad_filter(spark, d):
    return stats.robust_filter(frames(spark, d), ["cls"], "v", factor=1.5).groupBy("cls").agg(r4(F.avg("v"), "mean"), F.count("*").alias("n"))


@query("iqr_filter", f"""WITH {FRAMES}, q AS (SELECT cls, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM frames GROUP BY cls)
SELECT cls, {_GROUPED} FROM frames JOIN q USING (cls) WHERE v BETWEEN a - 0.2 * (b - a) AND b + 0.2 * (b - a) GROUP BY cls""")
def iqr_filter(spark, d):
    return stats.robust_filter(frames(spark, d), ["cls"], "v", "iqr", iqr_factor=0.2).groupBy("cls").agg(r4(F.avg("v"), "mean"), F.count("*").alias("n"))


@query("trimmed_median", f"""WITH {FRAMES}, r AS (SELECT seq, v, row_number() OVER (PARTITION BY seq ORDER BY v) AS r, count(*) OVER (PARTITION BY seq) AS n FROM frames)
SELECT seq, round(median(v), 4) AS trimmed_median, count(*) AS n_kept FROM r WHERE r > CASE WHEN n >= 10 THEN floor(n * 0.1) ELSE 0 END AND r <= n - CASE WHEN n >= 10 THEN floor(n * 0.1) ELSE 0 END GROUP BY seq""")
def trimmed_median(spark, d):
    return stats.trimmed_median(frames(spark, d), ["seq"], "v").select("seq", r4("trimmed_median"), "n_kept")


@query("weighted_median_level", f"""WITH {FRAMES}, e AS (SELECT cls, round(v) AS v, sum(frame % 7 + 1) AS w FROM frames GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY cls ORDER BY v) AS c, sum(w) OVER (PARTITION BY cls) AS t FROM e)
SELECT cls, round(min(v), 4) AS weighted_median, max(t)::BIGINT AS total_weight FROM c WHERE c >= t / 2.0 GROUP BY cls""")
def weighted_median_level(spark, d):
    rows = frames(spark, d).select("cls", F.round("v").alias("v"), (F.col("frame") % 7 + 1).alias("w"))
    return stats.weighted_median(rows, "v", "w", ["cls"]).select("cls", r4("weighted_median"), "total_weight")


@query("height_statistics", f"""WITH {FRAMES}, m AS (SELECT cls, median(v) AS m FROM frames GROUP BY cls)
SELECT cls, count(*) AS n, round(min(v), 4) AS min, round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.9), 4) AS p90,
  round(max(v), 4) AS max, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(median(abs(v - m)), 4) AS mad, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr FROM frames JOIN m USING (cls) GROUP BY cls""")
def height_statistics(spark, d):
    s = stats.height_statistics(frames(spark, d), "v", ["cls"])
    return s.select("cls", "n", *(r4(c) for c in s.columns if c not in ("cls", "n")))


@query("frame_difference_exposure", f"""WITH {POINTS}, px AS (SELECT case_id, frame, floor(x / 5)::BIGINT AS ix, round(avg(z), 4) AS v FROM cells GROUP BY 1, 2, 3),
m AS (SELECT case_id, frame, median(v) AS m FROM px GROUP BY 1, 2), c AS (SELECT case_id, frame, ix, v - m AS c FROM px JOIN m USING (case_id, frame)),
f AS (SELECT *, c - lag(c) OVER (PARTITION BY case_id, ix ORDER BY frame) AS diff FROM c)
SELECT case_id, frame, ix, round(c, 4) AS corrected, round(diff, 4) AS difference, round(abs(diff), 4) AS absolute, CASE WHEN diff IS NOT NULL THEN round(greatest(diff, 0), 4) END AS rise, CASE WHEN diff IS NOT NULL THEN round(greatest(-diff, 0), 4) END AS fall FROM f""")
def frame_difference_exposure(spark, d):
    px = points(spark, d).groupBy("case_id", "frame", F.floor(F.col("x") / 5).alias("ix")).agg(F.round(F.avg("z"), 4).alias("v"))
    found = sequences.exposure_corrected_differences(px, ["case_id"], ["ix"], "frame", "v")
    keep = F.col("difference").isNotNull()
    return found.select("case_id", "frame", "ix", r4("corrected"), r4("difference"), r4("absolute"), r4(F.when(keep, F.col("rise")), "rise"), r4(F.when(keep, F.col("fall")), "fall"))


@query("mean_normalised_frames", f"""WITH {POINTS}, px AS (SELECT case_id, frame, floor(x / 5)::BIGINT AS ix, round(avg(z), 4) AS v FROM cells GROUP BY 1, 2, 3),
m AS (SELECT case_id, frame, avg(v) AS m FROM px GROUP BY 1, 2), g AS (SELECT case_id, median(m) AS g FROM m GROUP BY 1)
SELECT case_id, frame, ix, round(least(60000, greatest(0, v + g - m)), 1) AS normalised FROM px JOIN m USING (case_id, frame) JOIN g USING (case_id)""")
def mean_normalised_frames(spark, d):
    px = points(spark, d).groupBy("case_id", "frame", F.floor(F.col("x") / 5).alias("ix")).agg(F.round(F.avg("z"), 4).alias("v"))
    return sequences.mean_normalised(px, ["case_id"], "frame", "v", 0.0, 60000.0).select("case_id", "frame", "ix", F.round("normalised", 1).alias("normalised"))


_ADJ = """a AS (SELECT seq, frame, v, CASE WHEN lag(frame) OVER w = frame - 1 THEN abs(v - lag(v) OVER w) END AS c FROM kept WINDOW w AS (PARTITION BY seq ORDER BY frame))
SELECT seq, count(*) AS frames, count(c) AS steps, round(avg(c), 4) AS mean_change, round(quantile_cont(c, 0.95), 4) AS p95_change, round(max(c), 4) AS max_change FROM a GROUP BY seq"""


@query("adjacent_change_p95", f"WITH {FRAMES}, kept AS (SELECT * FROM frames WHERE frame % 4 <> 3), {_ADJ}")
def adjacent_change_p95(spark, d):
    found = sequences.adjacent_changes(frames(spark, d).where("frame % 4 <> 3"), ["seq"], "frame", "v")
    return found.select("seq", "frames", "steps", r4("mean_change"), r4("p95_change"), r4("max_change"))


@query("sequence_summary_anchor", f"""WITH {FRAMES} SELECT seq, count(v) AS n, round(avg(v) FILTER (frame < 10), 4) AS mean_before, round(avg(v) FILTER (frame >= 10), 4) AS mean_after, round(max(v) FILTER (frame = 10), 4) AS at_anchor,
  round(arg_min(v, frame), 4) AS first_value, round(arg_max(v, frame), 4) AS last_value, arg_min(frame, (v, frame))::INTEGER AS worst_frame,
  round(CASE WHEN count(*) > 1 AND stddev_pop(v) > 0 THEN covar_pop(frame, v) / (stddev_pop(frame) * stddev_pop(v)) END, 4) AS trend_correlation FROM frames GROUP BY seq""")
def sequence_summary_anchor(spark, d):
    s = sequences.summary_around(frames(spark, d), ["seq"], "frame", "v", 10)
    return s.select("seq", "n", *(r4(c) for c in s.columns if c not in ("seq", "n", "worst_frame")), "worst_frame")


def _corr_sql(a: str, b: str) -> str:
    return f"round(CASE WHEN count(*) > 1 AND stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END, 4)"


@query("safe_correlation_matrix", f"WITH {POINTS} SELECT case_id, frame, {_corr_sql('x', 'y')} AS xy, {_corr_sql('x', 'z')} AS xz, {_corr_sql('y', 'z')} AS yz FROM points GROUP BY case_id, frame UNION ALL SELECT 'constant', 0, NULL, NULL, NULL")
def safe_correlation_matrix(spark, d):
    rows = points(spark, d).select("case_id", "frame", "x", "y", "z")
    flat = rows.limit(5).select(F.lit("constant").alias("case_id"), F.lit(0).alias("frame"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))
    c = F.col
    return rows.unionByName(flat).groupBy("case_id", "frame").agg(*(r4(exprs.safe_corr(c(a), c(b)), a + b) for a, b in (("x", "y"), ("x", "z"), ("y", "z"))))


@query("slope_and_moving_average", f"""WITH {FRAMES}, s AS (SELECT seq, coalesce(regr_slope(v, frame), 0) AS slope, count(*) AS n FROM frames GROUP BY seq),
m AS (SELECT seq, max((coalesce(lag(v) OVER w, v) + v + coalesce(lead(v) OVER w, v)) / 3) OVER (PARTITION BY seq) AS x, count(*) OVER (PARTITION BY seq) AS k, v FROM frames WINDOW w AS (PARTITION BY seq ORDER BY frame))
SELECT s.seq, round(slope, 4) AS slope, n, round(max(CASE WHEN k < 3 THEN v ELSE x END), 4) AS smoothed_max FROM s JOIN m ON s.seq = m.seq GROUP BY ALL""".replace("max((coalesce(lag(v) OVER w, v) + v + coalesce(lead(v) OVER w, v)) / 3) OVER (PARTITION BY seq) AS x", "(coalesce(lag(v) OVER w, v) + v + coalesce(lead(v) OVER w, v)) / 3 AS x"))
def slope_and_moving_average(spark, d):
    rows = frames(spark, d)
    top = sequences.smoothed(rows, ["seq"], "frame", "v").groupBy("seq").agg(r4(F.max("smoothed"), "smoothed_max"))
    return sequences.slope(rows, ["seq"], "frame", "v").select("seq", r4("slope"), "n").join(top, "seq")


@query("first_crossing_time", """WITH r AS (SELECT o_custkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS step, o_totalprice AS v FROM orders)
SELECT seq, min(step) FILTER (v >= 50000)::INTEGER AS blue, min(step) FILTER (v >= 150000)::INTEGER AS yellow, min(step) FILTER (v >= 300000)::INTEGER AS orange FROM r GROUP BY seq""")
def first_crossing_time(spark, d):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("seq"), (F.row_number().over(order) - 1).alias("step"), F.col("o_totalprice").alias("v"))
    return sequences.first_crossing(rows, ["seq"], "step", "v", {"blue": 50000.0, "yellow": 150000.0, "orange": 300000.0})


@query("zero_filled_curve", f"WITH {FRAMES}, k AS (SELECT seq, frame, v FROM frames WHERE cls = 'purchase'), b AS (SELECT seq, min(frame) AS a, max(frame) AS b FROM k GROUP BY seq), sp AS (SELECT seq, unnest(range(a, b + 1))::INTEGER AS frame FROM b) SELECT sp.seq, sp.frame, round(coalesce(sum(v), 0), 4) AS total FROM sp LEFT JOIN k ON sp.seq = k.seq AND sp.frame = k.frame GROUP BY ALL")
def zero_filled_curve(spark, d):
    return sequences.zero_filled(frames(spark, d).where("cls = 'purchase'"), ["seq"], "frame", "v").select("seq", "frame", r4("total"))


@query("contiguous_window", f"WITH {FRAMES}, k AS (SELECT * FROM frames WHERE frame BETWEEN 20 AND 60) SELECT seq, event_id, (row_number() OVER (PARTITION BY seq ORDER BY frame) - 1)::INTEGER AS local, count(*) OVER (PARTITION BY seq) = 41 AS complete FROM k")
def contiguous_window(spark, d):
    return sequences.contiguous_windows(frames(spark, d), ["seq"], "frame", 20, 60).select("seq", "event_id", "local", "complete")


@query("stride_sample", f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY v, event_id) - 1 AS r FROM frames) SELECT seq, event_id FROM r WHERE r % 5 = 0")
def stride_sample(spark, d):
    return sequences.stride(frames(spark, d), ["v", "event_id"], 5, ["seq"]).select("seq", "event_id")


@query("status_counts_grouping_sets", """SELECT CASE WHEN grouping(o_orderstatus) = 0 AND grouping(o_orderpriority) = 0 THEN 'o_orderstatus+o_orderpriority' WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' ELSE '' END AS grouping,
  o_orderstatus, o_orderpriority, count(*) AS n, round(median(o_totalprice), 4) AS median_price, round(avg(o_totalprice), 2) AS mean_price, count(*) FILTER (o_totalprice > 200000) AS large
FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))""")
def status_counts_grouping_sets(spark, d):
    sets = [[], ["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"]]
    measures = [F.count("*").alias("n"), r4(F.median("o_totalprice"), "median_price"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"), F.count_if(F.col("o_totalprice") > 200000).alias("large")]
    found = stats.grouping_sets(table(spark, d, "orders"), sets, measures)
    return found.select("grouping", "o_orderstatus", "o_orderpriority", "n", "median_price", "mean_price", "large")


@query("latest_by_sample", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def latest_by_sample(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return stats.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("recent_runs_topk", "SELECT o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recent_runs_topk(spark, d):
    rows = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20)
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("status_cross_table", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag")
def status_cross_table(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if(F.col("l_linestatus") == "O").alias("o"))


@query("strict_equi_join_audit", """SELECT o.o_orderstatus, count(*) AS n, round(sum(l.l_quantity), 4) AS quantity, (SELECT count(*) FROM orders a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.o_orderkey)) AS orders_without_lines
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderstatus""")
def strict_equi_join_audit(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    joined = joins.strict_join(lines.select("l_orderkey", "l_quantity"), orders, ["l_orderkey"], "orders")
    empty = joins.unmatched(orders, lines, ["l_orderkey"]).agg(F.count("*").alias("orders_without_lines"))
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), r4(F.sum("l_quantity"), "quantity")).crossJoin(F.broadcast(empty))  # one row


@query("interval_overlap_join", f"WITH {TRACKS} SELECT t.seq, t.id AS track, a.id AS event, least(t.e, a.e) - greatest(t.s, a.s) AS overlap, round((least(t.e, a.e) - greatest(t.s, a.s)) / greatest(1, greatest(t.e, a.e) - least(t.s, a.s)), 4) AS iou FROM tracks t JOIN annotations a ON t.seq = a.seq AND t.s <= a.e AND a.s <= t.e")
def interval_overlap_join(spark, d):
    pairs = joins.interval_overlap(tracks(spark, d), annotations(spark, d), ["seq"], 7200.0)
    both = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    whole = F.greatest(F.lit(1), F.greatest("l_end", "r_end") - F.least("l_start", "r_start"))
    return pairs.select("seq", F.col("l_id").alias("track"), F.col("r_id").alias("event"), both.alias("overlap"), r4(both / whole, "iou"))


@query("neighbour_count_selfjoin", f"WITH {FRAMES}, p AS (SELECT event_id, cls, v, sec / 3600.0 AS h FROM frames) SELECT a.event_id, count(b.event_id) AS neighbours FROM p a LEFT JOIN p b ON a.cls = b.cls AND a.event_id <> b.event_id AND sqrt(power(a.v - b.v, 2) + power(a.h - b.h, 2)) <= 5 GROUP BY a.event_id")
def neighbour_count_selfjoin(spark, d):
    rows = frames(spark, d).select("event_id", "cls", "v", (F.col("sec") / 3600.0).alias("h"))
    return joins.neighbour_counts(rows, "v", "h", 5.0, ["cls"], "neighbours").select("event_id", "neighbours")


@query("asof_history_lookup", f"WITH {FRAMES}, a AS (SELECT seq, sec, event_id FROM frames WHERE cls = 'purchase'), b AS (SELECT seq, sec, max(v) AS v FROM frames WHERE cls = 'view' GROUP BY seq, sec) SELECT a.seq, a.event_id, round(b.v, 4) AS last_view FROM a ASOF LEFT JOIN b ON a.seq = b.seq AND a.sec >= b.sec")
def asof_history_lookup(spark, d):
    rows = frames(spark, d)
    left, right = rows.where("cls = 'purchase'").select("seq", "sec", "event_id"), rows.where("cls = 'view'").select("seq", "sec", "v")
    return joins.as_of(left, right, ["seq"], "sec", "v", "last_view").select("seq", "event_id", r4("last_view"))


@query("label_left_join_confusion", f"WITH {SCORED} SELECT CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS predicted, coalesce(truth::VARCHAR, 'background') AS label, count(*) AS n, round(avg(power(score - coalesce(truth, 0), 2)), 4) AS brier FROM scored GROUP BY 1, 2")
def label_left_join_confusion(spark, d):
    docs = scored(spark, d)
    rows = joins.labels_or_default(docs.drop("truth"), docs.where("truth IS NOT NULL").select("doc_id", F.col("truth").cast("string").alias("label")), ["doc_id"], "label", "background")
    error = F.col("score") - F.coalesce(F.col("label").try_cast("int"), F.lit(0))
    return rows.groupBy((F.col("score") >= 0.5).cast("int").alias("predicted"), "label").agg(F.count("*").alias("n"), r4(F.avg(error * error), "brier"))


@query("pr_curve", f"""WITH {SCORED}, t AS (SELECT i / 20.0::DOUBLE AS threshold FROM range(1, 20) r(i)), k AS (SELECT threshold, count(*) FILTER (score >= threshold AND truth = 1) AS tp, count(*) FILTER (score >= threshold AND truth = 0) AS fp, count(*) FILTER (score < threshold AND truth = 1) AS fn FROM t, scored WHERE truth IS NOT NULL GROUP BY threshold),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM k)
SELECT round(threshold, 4) AS threshold, tp, fp, fn, round(precision, 4) AS precision, round(recall, 4) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 4) AS f1 FROM p""")
def pr_curve(spark, d):
    found = stats.threshold_curve(scored(spark, d).where("truth IS NOT NULL"), "score", "truth", [i / 20.0 for i in range(1, 20)])
    return found.select(r4("threshold"), "tp", "fp", "fn", r4("precision"), r4("recall"), r4("f1"))


@query("calibration_bins", f"""WITH {SCORED}, b AS (SELECT i::INTEGER AS bin, i * (1.0::DOUBLE / 10) AS lo FROM range(10) r(i)), k AS (SELECT (SELECT max(bin) FROM b WHERE lo <= score) AS bin, score, truth FROM scored WHERE truth IS NOT NULL)
SELECT b.bin, count(k.bin) AS n, round(avg(score), 4) AS mean_score, round(avg(truth), 4) AS observed FROM b LEFT JOIN k ON b.bin = k.bin GROUP BY b.bin""")
def calibration_bins(spark, d):
    return stats.calibration(scored(spark, d).where("truth IS NOT NULL"), "score", "truth").select("bin", "n", r4("mean_score"), r4("observed"))


@query("threshold_grid_search", f"""WITH {SCORED}, g AS (SELECT l.x AS low, h.x AS high FROM (VALUES (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE)) l(x), (VALUES (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE)) h(x)),
k AS (SELECT low, high, count(*) FILTER (score >= high AND truth = 1) AS a, count(*) FILTER (score >= high AND truth = 0) AS b, count(*) FILTER (score <= low AND truth = 0) AS c, count(*) FILTER (score <= low AND truth = 1) AS d, count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth = 0) AS q FROM g, scored WHERE truth IS NOT NULL GROUP BY low, high),
f AS (SELECT low, high, round((2 * a / (a + b + p) + 2 * c / (c + d + q)) / 2, 9) AS macro_f1, (p + q - a - b - c - d) / (p + q) AS uncertain FROM k)
SELECT round(low, 4) AS low, round(high, 4) AS high, round(macro_f1, 4) AS macro_f1, round(uncertain, 4) AS uncertain FROM f ORDER BY f.macro_f1 DESC, f.uncertain, f.low, f.high LIMIT 1""")
def threshold_grid_search(spark, d):
    found = stats.best_thresholds(scored(spark, d).where("truth IS NOT NULL"), "score", "truth", [0.2, 0.3, 0.4], [0.6, 0.7, 0.8])
    return found.select(r4("low"), r4("high"), r4("macro_f1"), r4("uncertain"))


@query("negative_sampling_per_group", f"""WITH {SCORED}, p AS (SELECT source, least(8, greatest(2, ceil(0.5 * count(*) FILTER (truth = 1)))) AS k FROM scored WHERE truth IS NOT NULL GROUP BY source),
r AS (SELECT s.*, k, row_number() OVER (PARTITION BY s.source, truth = 1 ORDER BY score DESC, doc_id) AS r FROM scored s JOIN p ON s.source = p.source WHERE truth IS NOT NULL)
SELECT doc_id, source, truth FROM r WHERE truth = 1 OR r <= k""")
def negative_sampling_per_group(spark, d):
    from fluvial.operators.events import sample_negatives

    rows = scored(spark, d).where("truth IS NOT NULL")
    return sample_negatives(rows, ["source"], F.col("truth") == 1, [F.desc("score"), F.col("doc_id")], 0.5, 2, 8).select("doc_id", "source", "truth")


@query("top_per_group", f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY v DESC, event_id) AS r FROM frames) SELECT cls, event_id, round(v, 4) AS v FROM r WHERE r <= 5")
def top_per_group(spark, d):
    return stats.top_per_group(frames(spark, d), ["cls"], [F.desc("v"), F.col("event_id")], 5).select("cls", "event_id", r4("v"))
