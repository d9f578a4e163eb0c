"""Queries on streams, scenes, sinks and sources."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fluvial.operators import events, geometry, stats
from fluvial.plans.adapters import frames, points, table
from fluvial.plans.registry import query, r4
from fluvial.sources import sinks
from fluvial.streaming import tracker, windows

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark, d):
    return windows.event_stream(spark, d, "events.parquet", EVENTS).withColumn("at", F.col("ts").cast("timestamp"))


@query("windowed_counts_stream", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 4) AS largest FROM events GROUP BY 1, 2")
def windowed_counts_stream(spark, d):
    found = windows.run_to_end(windows.windowed(_stream(spark, d), "at", ["event_type"], "value", "1 day"), "complete")
    return found.select("event_type", F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "n", r4("total"), r4("largest"))


@query("session_counts", """WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM o),
c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""")
def session_counts(spark, d):
    rows = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return windows.sessions(rows, "at", ["user_id"], "2 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def _candidates(rows):
    c = F.col
    hour = (F.unix_timestamp(c("at")) / 3600).cast("int")
    out = rows.select(c("user_id").alias("seq"), hour.alias("frame"), c("event_id").alias("candidate_id"), (c("value") % 90).alias("u"), ((c("value") * 3) % 90).alias("v"), (c("event_id") % 40 + 1).alias("area"), F.lit(3.0).alias("radius"))
    return out.withColumns({"x0": (c("u") - 3).cast("int"), "y0": (c("v") - 3).cast("int"), "x1": (c("u") + 3).cast("int"), "y1": (c("v") + 3).cast("int")})


@query("stateful_tracker")
def stateful_tracker(spark, d):
    end = spark.createDataFrame([(-1, "2100-01-01", -1, "end", 0.0, None)], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    # a frame is an hour, so it is whole when the hour is over
    stream_of = lambda s: tracker.stream_associate(_candidates(s.withColumn("at", F.col("ts").cast("timestamp"))).withColumn("closes", F.timestamp_seconds((F.col("frame").cast("long") + 1) * 3600)), "seq", "closes", forget_ms=400 * 86_400_000)
    found = windows.run_to_watermark(spark, stream_of, d, end.select(*(n for n in _stream(spark, d).columns if n != "at")), dict([tracker.PROVIDER]), pathGlobFilter="events.parquet")
    return found.where("seq >= 0").groupBy("seq").agg(F.count("*").alias("candidates"), F.countDistinct("track").alias("tracks"))


@query("tracks_per_sequence")
def tracks_per_sequence(spark, d):
    rows = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return events.associate(_candidates(rows), "seq").groupBy("seq").agg(F.count("*").alias("candidates"), F.countDistinct("track").alias("tracks"))


GRID = geometry.Grid(60, 40, 0.1)
CAMERA = geometry.Camera(-6.0, 0.0, 3.0, 0.0, 0.45, math.radians(60), 160, 90)
_GROUND = """ground AS (SELECT i AS ix, j AS iy, -3.0::DOUBLE + 0.1 * (i + 0.5) AS x, -2.0::DOUBLE + 0.1 * (j + 0.5) AS y FROM range(60) a(i), range(40) b(j)),
heights AS (SELECT ix, iy, x, y, -0.01 * x - CASE WHEN x * x / 9.0 + y * y / 4.0 < 1 THEN 0.4 * (1 - (x * x / 9.0 + y * y / 4.0)) ELSE 0 END AS z FROM ground)"""


@query("scene_heights", f"WITH {_GROUND} SELECT ix::INTEGER AS ix, iy::INTEGER AS iy, round(z, 6) AS z FROM heights")
def scene_heights(spark, d):
    return geometry.scene(spark, GRID).select("ix", "iy", F.round("z", 6).alias("z"))


@query("scene_water_truth", f"WITH {_GROUND}, l AS (SELECT min(z) + 0.203 AS level FROM heights) SELECT round(level, 4) AS level, count(*) AS cells, round(count(*) * 0.01::DOUBLE, 4) AS area, round(sum(level - z) * 0.01, 4) AS volume FROM heights, l WHERE z < level GROUP BY level")
def scene_water_truth(spark, d):
    return geometry.water_truth(geometry.scene(spark, GRID), 0.203, 0.01).select(r4("level"), "cells", r4("area"), r4("volume"))


@query("ray_dem_intersection")
def ray_dem_intersection(spark, d):
    ground = geometry.dense(geometry.scene(spark, GRID), GRID)
    pixels = spark.range(160 * 9).select((F.col("id") % 160).alias("u"), (F.floor(F.col("id") / 160) * 10).alias("v"))
    found = geometry.intersect_rays(pixels, ground, GRID, CAMERA)
    return found.select("u", "v", "reason", r4("x"), r4("y"), r4("z"))


@query("cell_projection")
def cell_projection(spark, d):
    mask = spark.range(160 * 90).select((F.col("id") % 160).cast("int").alias("col"), F.floor(F.col("id") / 160).cast("int").alias("row")).where("row > 40 AND col BETWEEN 40 AND 120")
    return geometry.project_cells(geometry.scene(spark, GRID), CAMERA, mask).groupBy("reason", "in_mask").agg(F.count("*").alias("cells"))


@query("jsonl_audit_roundtrip", "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def jsonl_audit_roundtrip(spark, d):
    folder = windows.shared_folder(spark)
    sinks.write_json_lines(table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")), f"{folder}/audit")
    back = spark.read.schema("o_orderkey long, status string, price double").option("mode", "FAILFAST").json(f"{folder}/audit")
    return back.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("csv_list_join", "SELECT o_custkey, string_agg(o_orderstatus, '|' ORDER BY o_orderdate, o_orderkey) AS statuses FROM orders GROUP BY o_custkey")
def csv_list_join(spark, d):
    folder = windows.shared_folder(spark)
    listed = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("l"))
    sinks.write_csv(listed.select("o_custkey", F.transform("l", lambda x: x["o_orderstatus"]).alias("statuses")), f"{folder}/csv")
    return spark.read.schema("o_custkey long, statuses string").option("header", True).csv(f"{folder}/csv")


@query("audit_lines", """SELECT l_orderkey, '{"l_orderkey":' || l_orderkey || ',"forecast_1min":' || coalesce(max(l_suppkey) FILTER (l_linenumber = 1)::VARCHAR, 'null') || ',"forecast_5min":' || coalesce(max(l_suppkey) FILTER (l_linenumber = 5)::VARCHAR, 'null') || '}' AS line FROM lineitem GROUP BY l_orderkey""")
def audit_lines(spark, d):
    return sinks.audit_line(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_suppkey", [1, 5])


@query("latest_run_state", "SELECT o_custkey::VARCHAR AS run_id, arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) AS status FROM orders GROUP BY o_custkey")
def latest_run_state(spark, d):
    folder = windows.shared_folder(spark)
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("recorded_at"), F.col("o_orderstatus").alias("status"))
    sinks.append(rows, f"{folder}/runs", sinks.RUN_SCHEMA)
    return sinks.run_states(spark, f"{folder}/runs").select("run_id", "status")


@query("bounded_frames", "WITH f AS (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linenumber) - 1 AS r FROM f) SELECT l.l_returnflag AS case_id, l.l_linenumber AS frame, count(*) AS n FROM lineitem l JOIN r ON l.l_returnflag = r.l_returnflag AND l.l_linenumber = r.l_linenumber WHERE r % 2 = 0 AND r < 6 GROUP BY ALL")
def bounded_frames(spark, d):
    from fluvial.sources.readers import limited_frames

    return limited_frames(points(spark, d), ["case_id"], "frame", 3, 2).groupBy("case_id", "frame").agg(F.count("*").alias("n"))


@query("frame_percentile_threshold", "WITH t AS (SELECT user_id, greatest(4, quantile_cont(value, 0.988)) AS t FROM events GROUP BY user_id) SELECT e.user_id, count(*) AS candidates, round(max(t), 4) AS threshold FROM events e JOIN t ON e.user_id = t.user_id WHERE value > t GROUP BY e.user_id")
def frame_percentile_threshold(spark, d):
    rows = frames(spark, d)
    limit = rows.groupBy("seq").agg(F.greatest(F.lit(4.0), F.percentile("v", 0.988)).alias("t"))
    return rows.join(limit, "seq").where("v > t").groupBy(F.col("seq").alias("user_id")).agg(F.count("*").alias("candidates"), r4(F.max("t"), "threshold"))


@query("pooled_height_statistics", "WITH m AS (SELECT median(l_extendedprice) AS m FROM lineitem) SELECT count(*) AS n, round(median(l_extendedprice), 4) AS p50, round(median(abs(l_extendedprice - m)), 4) AS mad FROM lineitem, m")
def pooled_height_statistics(spark, d):
    return stats.height_statistics(table(spark, d, "lineitem"), "l_extendedprice").select("n", r4("p50"), r4("mad"))
