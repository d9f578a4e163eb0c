"""Streams in event time: frames cut over files, late rows, state that goes away."""

import datetime
import random

import pytest
from fluvial.operators import events
from fluvial.streaming import tracker

SCHEMA = "seq long, at timestamp, frame long, candidate_id long, u double, v double, area long, radius double, x0 int, y0 int, x1 int, y1 int"
START = datetime.datetime(2024, 1, 1)


def candidates(seq, frames, draw):
    rows = []
    for f in frames:
        for k in range(draw.randint(1, 4)):
            u, v = draw.uniform(0, 60), draw.uniform(0, 40)
            rows.append((seq, START + datetime.timedelta(seconds=f), f, 100 * f + k, u, v, draw.randint(1, 60), 3.0, int(u) - 3, int(v) - 3, int(u) + 3, int(v) + 3))
    return rows


@pytest.fixture
def run(spark, tmp_path):
    """Files, one a trigger, through the tracker; gives rows and what is left in a named state."""

    def go(files, **options):
        for k, rows in enumerate(files):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
            for p in (tmp_path / f"in{k}").glob("*.parquet"):
                (tmp_path / "in").mkdir(exist_ok=True)
                p.rename(tmp_path / "in" / f"{k}.parquet")
        spark.conf.set(*tracker.PROVIDER)
        try:
            stream = tracker.stream_associate(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "seq", "at", **options)
            query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
            left = {n: spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", n).load() for n in ("tracks",)}
            return spark.read.parquet(f"{tmp_path}/out").collect(), sorted(r.key[0] for r in left["tracks"].select("key").collect())
        finally:
            spark.conf.unset(tracker.PROVIDER[0])

    return go


def test_a_frame_cut_over_files_is_whole(spark, run):
    draw = random.Random(1)
    a, b = candidates(1, range(12), draw), candidates(2, range(3, 12), draw)
    rows = sorted(a + b, key=lambda r: r[1])
    at = next(k for k, r in enumerate(rows) if r[2] == 6) + 1  # within frame 6
    closing = candidates(9, [500], draw)
    found, left = run([rows[:at], rows[at:], closing], late="1 second", forget_ms=10_000_000)
    want = events.associate(spark.createDataFrame(rows, SCHEMA), "seq").collect()
    key = lambda r: (r.seq, r.frame, r.candidate_id, r.track)
    assert sorted(map(key, (r for r in found if r.seq != 9))) == sorted(map(key, want))
    assert left == [1, 2]  # frame 500 itself is still open


def test_closed_sequences_leave_no_state(spark, run):
    draw = random.Random(2)
    files = [candidates(1, range(5), draw), candidates(2, range(50, 55), draw), candidates(3, [400], draw), candidates(3, [401], draw), candidates(1, [402], draw), candidates(4, [900], draw)]
    found, left = run(files, late="1 second", forget_ms=20_000)
    assert {r.seq for r in found} == {1, 2, 3}
    assert left == []
    # a sequence that goes on after it was forgotten is a new one
    assert min(r.track for r in found if r.seq == 1 and r.frame == 402) == 0


def test_a_long_gap_within_one_batch_is_the_same(spark, run):
    draw = random.Random(4)
    found, _ = run([candidates(1, [0, 1, 402], draw) + candidates(4, [900], draw)], late="1 second", forget_ms=20_000)
    assert min(r.track for r in found if r.frame == 402) == 0


def test_rows_behind_the_watermark_are_late(spark, run):
    draw = random.Random(3)
    late = candidates(1, [2], draw)
    found, _ = run([candidates(1, range(4), draw), candidates(1, [100], draw), late, candidates(5, [300], draw)], late="1 second")
    ids = [r.candidate_id for r in found if r.frame == 2]
    assert len(ids) == len({*ids}) and not {(r[3], r[4]) for r in late} & {(r.candidate_id, r.u) for r in found}
