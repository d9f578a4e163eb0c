"""Windowed aggregates with watermarks, and how a finite stream is run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the session's shared checkpoint folder."""
    from fluvial.sources.checkpoints import cut

    if spark.sparkContext.getCheckpointDir() is None:
        cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"


def event_stream(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """Files of a folder as a stream; event times are read without a zone and taken as UTC."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed(events: DataFrame, time: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """count, sum and greatest value for each key and tumbling or sliding window; rows later than `late` may be dropped.

    Works on streams and on tables; on a table no row is late.
    """
    rows = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"))


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "1 day") -> DataFrame:
    """Rows of a key that follow each other within a gap, as one session: start, end and count."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))


def run_to_watermark(spark: SparkSession, stream_of, path: str, end: DataFrame, settings: dict[str, str] | None = None, **options) -> DataFrame:
    """What a stream in append mode gives for the files under path and then for the rows of end, which close its windows.

    stream_of makes the query's stream of a stream of files, read with end's schema. The files run to their end
    first; then the same query goes on from its checkpoint with end alone, whose late times move the watermark
    past every row before. settings hold while it runs.
    """
    folder = shared_folder(spark)
    kept = {k: spark.conf.get(k, None) for k in settings or {}}
    end.limit(0).write.parquet(f"{folder}/end")
    files = lambda at, **more: spark.readStream.schema(end.schema).options(**more).parquet(at)
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        for closing in (False, True):
            if closing:
                end.write.mode("append").parquet(f"{folder}/end")
            both = stream_of(files(path, **options).union(files(f"{folder}/end")))
            both.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(f"{folder}/out")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream over the files present gives, written to the shared folder and read back."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
