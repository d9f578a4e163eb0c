"""Queries that must take every event of a sequence, however long."""

import datetime

import pytest
from fluvial.plans import catalog


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    """Two users of 120 events; each second event a purchase at its view's place."""
    folder, began = str(tmp_path_factory.mktemp("long")), datetime.datetime(2024, 1, 1)
    rows = [(1000 * u + k, u, "view" if k % 2 == 0 else "purchase", float(k // 2 * 13 % 60), began + datetime.timedelta(hours=k)) for u in (1, 9) for k in range(120)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz").write.parquet(f"{folder}/events.parquet")
    return folder


def of(spark, long_dir, name):
    return catalog.queries()[name](spark, long_dir).collect()


def test_gaussian_evidence(spark, long_dir):
    found, every = of(spark, long_dir, "gaussian_evidence"), of(spark, long_dir, "gaussian_evidence_all")
    assert sorted(found) == sorted(every) and len(found) > 1000


@pytest.mark.parametrize("name", ["candidate_detection", "ranked_components"])
def test_pixels_of_all_sequences(spark, long_dir, name):
    assert {(r["sample"], r["window"]) for r in of(spark, long_dir, name)} == {(u, w) for u in (1, 9) for w in range(10)}


@pytest.mark.parametrize("name,column,last", [("track_event_pairs", "track", 110), ("ambiguous_tracks", "track", 110), ("neighbour_context", "id", 110), ("track_event_pairs_all", "track", 110), ("ambiguous_tracks_all", "track", 110), ("greedy_match", "event", 61), ("neighbour_context_all", "id", 110)])
def test_late_frames(spark, long_dir, name, column, last):
    found = {r[column] for r in of(spark, long_dir, name)}
    assert all(max(i % 1000 for i in found if i // 1000 == u) >= last for u in (1, 9))
