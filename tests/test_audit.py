"""Audit batches are there once, whatever dies or comes twice."""

import threading

import pytest
from fluvial.sources import audit
from pyspark.sql import functions as F


@pytest.fixture
def table(spark, tmp_path):
    return audit.AuditTable(spark, f"{tmp_path}/t", "k long, v double")


def test_a_batch_is_committed_once(spark, table):
    assert table.rows().collect() == [] and not table.has("007", "a/b", 1)
    one = spark.createDataFrame([(1, 0.5), (2, None)], "k long, v double")
    assert table.commit(one, "007", "a/b", 1) and table.has("007", "a/b", 1)
    assert not table.commit(one.withColumn("v", F.lit(9.0)), "007", "a/b", 1)
    assert table.commit(one.select("k"), "007", "x", 2)
    found = sorted((r.run_id, r.stage, r.batch, r.k, r.v) for r in table.rows().fillna(-1.0).collect())
    assert found == [("007", "a/b", 1, 1, 0.5), ("007", "a/b", 1, 2, -1.0), ("007", "x", 2, 1, -1.0), ("007", "x", 2, 2, -1.0)]
    for rows, checks in ((one.withColumn("z", F.lit(1)), {}), (one, {"rules": {"has_v": F.col("v").isNotNull()}}), (one.union(one), {"keys": ["k"]})):
        with pytest.raises(ValueError):
            table.commit(rows, "r", "s", **checks)
    assert not table.has("r", "s")


def test_of_two_writers_of_one_batch_one_passes(spark, table):
    rows = [spark.range(5).select(F.col("id").alias("k"), F.lit(float(w)).alias("v")) for w in range(3)]
    wait, passed = threading.Barrier(3), {}
    place = table._rename

    def rename(staged, target):
        wait.wait()  # all have written before one commits
        return place(staged, target)

    table._rename = rename
    threads = [threading.Thread(target=lambda w=w: passed.update({w: table.commit(rows[w], "r", "s")})) for w in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(passed.values()) == [False, False, True]
    assert {r.v for r in table.rows().collect()} == {float(w) for w, ok in passed.items() if ok} and table.rows().count() == 5


def test_what_a_killed_writer_left_is_not_seen(spark, table, tmp_path):
    table._rename = lambda staged, target: (_ for _ in ()).throw(KeyboardInterrupt)
    with pytest.raises(KeyboardInterrupt):
        table.commit(spark.createDataFrame([(1, 1.0)], "k long, v double"), "r", "s")
    again = audit.AuditTable(spark, table.path, "k long, v double")
    assert again.rows().collect() == []
    assert again.commit(spark.createDataFrame([(1, 2.0)], "k long, v double"), "r", "s")
    assert [(r.k, r.v) for r in again.rows().collect()] == [(1, 2.0)]
    again.sweep()
    assert not (tmp_path / "t" / "_staging").exists() and again.rows().count() == 1


def test_a_stream_given_again_writes_once(spark, table, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, float(k))], "k long, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    write, died = table.sink("r", "s", keys=["k"]), []

    def sink(rows, batch):
        write(rows, batch)
        if batch == 1 and not died:
            died.append(1)
            raise RuntimeError("after the commit, before the checkpoint")

    def run():
        stream = spark.readStream.schema("k long, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="after the commit"):
        run()
    run()
    assert sorted((r.k, r.v) for r in table.rows().collect()) == [(0, 0.0), (1, 1.0), (2, 2.0)]


def test_a_run_goes_on_where_it_died(spark, tmp_path):
    calls, fail = [], {"b": 2}

    def stage(name, change):
        def run(rows):
            calls.append(name)
            if fail.get(name, 0):
                fail[name] -= 1
                raise RuntimeError(f"{name} isn't there")
            return rows.select(change.alias("k"))

        return name, "k long", run

    stages = [stage("a", F.col("k") + 1), stage("b", F.col("k") * 2), stage("c", F.col("k") - 1)]
    first = spark.createDataFrame([(1,), (2,)], "k long")
    status = lambda: audit.run_status(spark, f"{tmp_path}/r", ["a", "b", "c"]).collect()
    for _ in range(2):
        with pytest.raises(RuntimeError):
            audit.run_stages(spark, f"{tmp_path}/r", "r1", stages, first)
    assert [(r.status, r.stages_done, r.failures) for r in status()] == [("failed", 1, 2)]
    for _ in range(2):  # a third call finishes, a fourth finds all done
        assert sorted(r.k for r in audit.run_stages(spark, f"{tmp_path}/r", "r1", stages, first).collect()) == [3, 5]
    assert calls == ["a", "b", "b", "b", "c"]
    assert [(r.status, r.stages_done, r.failures) for r in status()] == [("success", 3, 2)]
    log = audit.AuditTable(spark, f"{tmp_path}/r/stage_runs", audit.STAGE_RUNS).rows().collect()
    assert sorted((r.stage, r.batch, r.status, r.rows) for r in log if r.status == "success") == [("a", 0, "success", 2), ("b", 0, "success", 2), ("c", 0, "success", 2)]
    assert sorted((r.batch, r.reason) for r in log if r.status == "failed") == [(1, "b isn't there"), (2, "b isn't there")]
