"""Queries on evidence maps: events as classified tracks in small images, an image a tenth of the users."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvial.operators import evidence
from fluvial.plans.adapters import table
from fluvial.plans.registry import query, r4

W, H = 64, 36
SCALE = 6.0

_T = f"""t AS (SELECT user_id // 10 AS image, (value * 7) % {W} AS u, (value * 3) % {H} AS v, event_id % 120 + 1 AS area, event_id % 20 + 1 AS dur, (event_id % 97) / 96.0::DOUBLE AS p,
  CASE WHEN event_type IN ('purchase', 'view') THEN 'water_ripple' WHEN event_type = 'click' THEN 'dry_splash' ELSE 'uncertain' END AS cls FROM events),
g AS (SELECT *, greatest(4.0::DOUBLE, least(8.8::DOUBLE, sqrt(area / pi()) * 1.3::DOUBLE)) AS sg FROM t), h AS (SELECT *, least(22.0::DOUBLE, sg * 2.5::DOUBLE) AS su, 0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, dur / 15.0::DOUBLE) AS dw FROM g),
kern AS (SELECT image, cls, p, dw, x, y, exp(-0.5::DOUBLE * (power(x - u, 2) + power(y - v, 2)) / (sg * sg)) AS k FROM h, range({W}) a(x), range({H}) b(y)
  WHERE x >= greatest(0, trunc(u - su)) AND x < trunc(u + su) + 1 AND y >= greatest(0, trunc(v - su)) AND y < trunc(v + su) + 1),
img AS (SELECT DISTINCT image FROM t), grid AS (SELECT image, x, y FROM img, range({W}) a(x), range({H}) b(y)),
sums AS (SELECT image, x, y, sum(k * p * dw) FILTER (cls = 'water_ripple') AS rule, sum(k * least(0.8::DOUBLE, p) * dw) FILTER (cls = 'water_ripple') AS pos, sum(k * (1 - p) * 0.5::DOUBLE) FILTER (cls = 'dry_splash') AS neg,
  count(*) FILTER (cls = 'water_ripple' AND k >= 0.10) AS support FROM kern GROUP BY image, x, y),
px AS (SELECT image, x, y, coalesce(rule, 0) AS rule, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(support, 0) AS support FROM grid LEFT JOIN sums USING (image, x, y)),
pr AS (SELECT *, 1 - exp(-rule / {SCALE}::DOUBLE) AS rp, 1 - exp(-greatest(pos - neg, 0) / {SCALE}::DOUBLE) AS mp FROM px)"""
_CLOSE = """grown AS (SELECT g.image, g.x, g.y, bool_or(s.w) AS w FROM st g JOIN st s ON s.image = g.image AND abs(s.x - g.x) <= 1 AND abs(s.y - g.y) <= 1 GROUP BY ALL),
cl AS (SELECT g.image, g.x, g.y, bool_and(s.w) AS w FROM grown g JOIN grown s ON s.image = g.image AND abs(s.x - g.x) <= 1 AND abs(s.y - g.y) <= 1 GROUP BY ALL)"""
_RULE = f"WITH {_T}, st AS (SELECT image, x, y, rp, support, support >= 1 AND rp >= 0.30 AS w FROM pr), {_CLOSE}"


def _tracks(spark, d):
    c = F.col
    kind = F.when(c("event_type").isin("purchase", "view"), "water_ripple").when(c("event_type") == "click", "dry_splash").otherwise("uncertain")
    p = (c("event_id") % 97) / 96.0
    return table(spark, d, "events").select("event_id", F.floor(c("user_id") / 10).alias("image"), ((c("value") * 7) % W).alias("u"), ((c("value") * 3) % H).alias("v"), (c("event_id") % 120 + 1).alias("maximum_area"), (c("event_id") % 20 + 1).alias("duration_frames"), kind.alias("classification"), p.alias("confidence"), p.alias("water_probability"))


def _rule(spark, d, close=0):
    return evidence.rule_evidence(_tracks(spark, d), ["image"], W, H, close, scale=SCALE, unknown_below=1.0)


def _model(spark, d):
    return evidence.model_evidence(_tracks(spark, d), ["image"], W, H, scale=SCALE, unknown_below=1.0, least_tracks=3)


@query("closed_evidence", f"{_RULE} SELECT image, x::INTEGER AS x, y::INTEGER AS y, round(rp, 4) AS probability, support, cl.w AS water, support < 1 AND NOT cl.w AS unknown FROM st JOIN cl USING (image, x, y)")
def closed_evidence(spark, d):
    return _rule(spark, d, 3).select("image", "x", "y", r4("probability"), "support", "water", "unknown")


@query("model_evidence", f"WITH {_T} SELECT image, x::INTEGER AS x, y::INTEGER AS y, round(mp, 4) AS probability, support, support >= 3 AND mp >= 0.30 AS water, support < 1 AS unknown FROM pr")
def model_evidence(spark, d):
    return _model(spark, d).select("image", "x", "y", r4("probability"), "support", "water", "unknown")


@query("hybrid_evidence", f"WITH {_T} SELECT image, x::INTEGER AS x, y::INTEGER AS y, round(greatest(rp, mp), 4) AS probability, 2 * support AS support, support >= 1 AND rp >= 0.30 AS water, support < 1 AS unknown FROM pr")
def hybrid_evidence(spark, d):
    found = evidence.hybrid(_rule(spark, d), _model(spark, d), ["image"])
    return found.select("image", "x", "y", r4("probability"), "support", "water", "unknown")


@query("evidence_summary", f"""{_RULE}, s AS (SELECT image, avg((support > 0)::INTEGER) AS covered, avg((support < 1 AND NOT cl.w)::INTEGER) AS un, avg(cl.w::INTEGER) AS wa, max(rp) AS pm FROM st JOIN cl USING (image, x, y) GROUP BY image)
SELECT image, round(covered, 4) AS covered, round(un, 4) AS unknown_share, round(wa, 4) AS water_share, round(pm, 4) AS greatest, count(*) FILTER (cls = 'water_ripple') AS water_tracks, count(*) FILTER (cls = 'dry_splash') AS dry_tracks, count(*) FILTER (cls = 'uncertain') AS uncertain_tracks
FROM s JOIN t USING (image) GROUP BY ALL""")
def evidence_summary(spark, d):
    found = evidence.summary(_rule(spark, d, 3), _tracks(spark, d), ["image"])
    return found.select("image", r4("covered"), r4("unknown_share"), r4("water_share"), r4("greatest"), "water_tracks", "dry_tracks", "uncertain_tracks")
