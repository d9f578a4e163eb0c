"""Queries of several operators together: whole sequences to predictions with failures as rows, and stable images."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluvial.operators import sequences, stages
from fluvial.plans.adapters import SECONDS, seconds, table
from fluvial.plans.evidence import SCALE, H, W, _CLOSE, _T, _tracks
from fluvial.plans.registry import query, r4

_DAY = f"({SECONDS} // 86400)"


@query("stable_images", f"""WITH e AS (SELECT user_id // 10 AS seq, {_DAY} AS day, user_id % 10 AS u, event_type AS channel, (floor(value)::BIGINT % 256) AS v FROM events), f AS (SELECT seq, day, row_number() OVER (PARTITION BY seq ORDER BY day) - 1 AS r FROM (SELECT DISTINCT seq, day FROM e)),
c AS (SELECT seq, day FROM f WHERE r >= 3 AND r < 18), n AS (SELECT seq, count(*) AS frames FROM c GROUP BY seq)
SELECT seq, u, channel, count(*) AS n, frames, CASE WHEN frames = 15 THEN round_even(median(v), 0)::INTEGER END AS median FROM e JOIN c USING (seq, day) JOIN n USING (seq) GROUP BY seq, u, channel, frames""")
def stable_images(spark, d):
    rows = table(spark, d, "events").select(F.floor(F.col("user_id") / 10).alias("seq"), F.floor(seconds() / 86400).alias("day"), (F.col("user_id") % 10).alias("u"), F.col("event_type").alias("channel"), (F.floor("value") % 256).alias("v"))
    return sequences.stable_image(rows, ["seq"], "day", ["u", "channel"], "v", 3, 15)


# the kernel sums of all tracks and of the first half's, side by side
_HALVES = _T.replace("event_id % 120 + 1 AS area", "event_id < (min(event_id) OVER (PARTITION BY user_id // 10) + max(event_id) OVER (PARTITION BY user_id // 10)) / 3 AS early, event_id % 120 + 1 AS area").replace("kern AS (SELECT image, cls,", "kern AS (SELECT image, early, cls,")
_SIDE = """s2 AS (SELECT image, x, y, sum(k * p * dw) FILTER (cls = 'water_ripple' AND early) AS rule, count(*) FILTER (cls = 'water_ripple' AND k >= 0.10 AND early) AS support FROM kern GROUP BY image, x, y)"""


def _closed(name: str, source: str) -> str:
    return f"{name}_st AS ({source}), " + _CLOSE.replace("grown AS", f"{name}_g AS").replace("cl AS", f"{name} AS").replace("FROM st g JOIN st s", f"FROM {name}_st g JOIN {name}_st s").replace("FROM grown g JOIN grown s", f"FROM {name}_g g JOIN {name}_g s")


_STABLE = f"""WITH {_HALVES}, {_SIDE}, {_closed("fw", "SELECT image, x, y, support >= 1 AND rp >= 0.30 AS w FROM pr")},
{_closed("ew", f"SELECT image, x, y, coalesce(s2.support, 0) >= 1 AND 1 - exp(-coalesce(s2.rule, 0) / {SCALE}::DOUBLE) >= 0.30 AS w FROM grid LEFT JOIN s2 USING (image, x, y)")},
io AS (SELECT image, count(*) FILTER (fw.w) AS water_pixels, count(*) FILTER (fw.w AND ew.w) AS i, count(*) FILTER (fw.w OR ew.w) AS u FROM fw JOIN ew USING (image, x, y) GROUP BY image),
wt AS (SELECT image, count(*) FILTER (cls = 'water_ripple') AS water_tracks FROM t GROUP BY image), gr AS (SELECT image, max(GREATEST_OF) AS greatest FROM pr GROUP BY image),
o AS (SELECT image, water_tracks, water_pixels, greatest, CASE WHEN u = 0 THEN 0 ELSE i / u::DOUBLE END AS iou FROM img JOIN wt USING (image) JOIN io USING (image) JOIN gr USING (image)),
r AS (SELECT *, CASE WHEN water_tracks < LEAST_TRACKS THEN 'no_water_tracks' WHEN water_pixels = 0 THEN 'no_water' WHEN iou < 0.78 THEN 'half_sequence_disagrees' END AS reason FROM o)
SELECT image, water_tracks, CASE WHEN reason IS DISTINCT FROM 'no_water_tracks' THEN water_pixels END AS water_pixels, CASE WHEN reason IS DISTINCT FROM 'no_water_tracks' THEN round(greatest, 4) END AS greatest,
  CASE WHEN reason IS NULL OR reason = 'half_sequence_disagrees' THEN round(iou, 4) END AS iou, CASE reason WHEN 'no_water_tracks' THEN 'tracks' WHEN 'no_water' THEN 'evidence' WHEN 'half_sequence_disagrees' THEN 'stability' END AS failed_stage, reason FROM r"""
#: Images with fewer water tracks aren't worth a map: about the mean of an image, so that both cases occur.
LEAST_TRACKS = 265


def _predicted(spark, d, model):
    ends = table(spark, d, "events").groupBy(F.floor(F.col("user_id") / 10).alias("image")).agg(((F.min("event_id") + F.max("event_id")) / 3).alias("half"))
    tracks = _tracks(spark, d).join(ends, "image")
    found = stages.temporal_prediction(tracks, tracks, ["image"], W, H, "event_id", F.col("half"), LEAST_TRACKS, 0.78, model, close=3, scale=SCALE, unknown_below=1.0)
    return found.select("image", "water_tracks", "water_pixels", r4("greatest"), r4("iou"), "failed_stage", "reason")


@query("temporal_prediction", _STABLE.replace("GREATEST_OF", "rp").replace("LEAST_TRACKS", str(LEAST_TRACKS)))
def temporal_prediction(spark, d):
    return _predicted(spark, d, None)


@query("temporal_model_prediction", _STABLE.replace("GREATEST_OF", "greatest(rp, mp)").replace("LEAST_TRACKS", str(LEAST_TRACKS)))
def temporal_model_prediction(spark, d):
    return _predicted(spark, d, {"scale": SCALE, "unknown_below": 1.0, "least_tracks": 3})
