"""Sources: typed points, strict JSON, image frames, and point clouds in SQLite bags."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINT_SCHEMA = "case_id string, frame_index int, stamp_ns long, x float, y float, z float"


def read_points(spark: SparkSession, path: str, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Points of Parquet files in POINT_SCHEMA; bounds (half-open) become filters that the scan takes."""
    points = spark.read.schema(POINT_SCHEMA).parquet(path)
    for axis, (low, high) in (bounds or {}).items():
        points = points.where((F.col(axis) >= low) & (F.col(axis) < high))
    return points


def read_json_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON documents that must fit the schema: a missing or broken file fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the array `events` of JSON documents, with the file they came from."""
    return read_json_strict(spark, path, f"events array<struct<{schema}>>").select(F.explode("events").alias("e"), F.col("_metadata.file_path").alias("path")).select("e.*", "path")


def sequence_identity(path) -> dict:
    """Columns case_id, rain_level and seed of a path .../case/rain/seed_N/..."""
    return {"case_id": F.regexp_extract(path, r"([^/]+)/[^/]+/seed_\d+", 1), "rain_level": F.regexp_extract(path, r"([^/]+)/seed_\d+", 1), "seed": F.regexp_extract(path, r"seed_(\d+)", 1).try_cast("int")}


def read_frames(spark: SparkSession, folder: str, pattern: str = "frame_*.png") -> DataFrame:
    """(frame, path, content, sha256) of numbered image files. Numbers that don't run from 0 without gaps fail the query."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    frames = files.select(F.regexp_extract("path", r"(\d+)\.[A-Za-z]+$", 1).cast("int").alias("frame"), "path", "content", F.sha2("content", 256).alias("sha256"))
    check = frames.agg(F.min("frame").alias("_a"), F.max("frame").alias("_b"), F.count("*").alias("_n"))  # one row
    ok = F.when((F.col("_a") == 0) & (F.col("_b") + 1 == F.col("_n")), F.lit(True)).otherwise(F.raise_error(F.lit("frame numbers have gaps")).cast("boolean"))
    return frames.crossJoin(F.broadcast(check)).where(ok).drop("_a", "_b", "_n")


def window_digest(frames: DataFrame, start: int, end: int) -> DataFrame:
    """One row: SHA-256 over the digests of frames start..end in order."""
    listed = frames.where(F.col("frame").between(start, end)).agg(F.sort_array(F.collect_list(F.struct("frame", "sha256"))).alias("l"))
    return listed.select(F.sha2(F.unhex(F.array_join(F.transform("l", lambda x: x["sha256"]), "")), 256).alias("digest"), F.size("l").alias("frames"))


def shortest_match(spark: SparkSession, root: str, keyword: str, pattern: str = "metadata.yaml") -> DataFrame:
    """One row: the folder under root that holds a file named by pattern and whose path has the keyword; shortest, then first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    folders = files.select(F.regexp_replace("path", r"/[^/]+$", "").alias("folder")).where(F.lower("folder").contains(keyword.lower()))
    return folders.agg(F.min(F.struct(F.length("folder").alias("n"), "folder")).alias("m")).select("m.folder")


def storage_id(metadata_text) -> object:
    """Storage format that a bag's metadata names; sqlite3 if it names none."""
    found = F.regexp_extract(metadata_text, r"storage_identifier:\s*['\"]?([A-Za-z0-9_]+)", 1)
    return F.when(found == "", "sqlite3").otherwise(found)


class _Cdr:
    """Little-endian CDR, read from after its 4-byte head."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 4

    def take(self, form: str):
        size = struct.calcsize(form)
        self.at += -(self.at - 4) % size
        value = struct.unpack_from("<" + form, self.data, self.at)[0]
        self.at += size
        return value

    def raw(self) -> bytes:
        n = self.take("I")
        self.at += n
        return self.data[self.at - n : self.at]


#: Fixed value: NumPy forms of a point field's datatype numbers 1 to 8.
_FIELD_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


def decode_pointcloud(message: bytes) -> np.ndarray:
    """x, y, z of a serialised PointCloud2 message, (n, 3) float32, finite rows alone."""
    c = _Cdr(message)
    c.take("i"), c.take("I"), c.raw()  # stamp and frame
    height, width = c.take("I"), c.take("I")
    fields = {}
    for _ in range(c.take("I")):
        name = c.raw().rstrip(b"\0").decode()
        fields[name] = (c.take("I"), c.take("B"), c.take("I"))
    order = ">" if c.take("B") else "<"
    step, row_step, data = c.take("I"), c.take("I"), c.raw()
    if not {"x", "y", "z"} <= fields.keys():
        raise ValueError("a point cloud needs x, y and z")
    kind = np.dtype({"names": ["x", "y", "z"], "formats": [order + _FIELD_TYPES[fields[a][1]] for a in "xyz"], "offsets": [fields[a][0] for a in "xyz"], "itemsize": step})
    rows = [np.frombuffer(data, kind, width, r * row_step) for r in range(height)] if width else []
    xyz = np.concatenate([np.stack([r["x"], r["y"], r["z"]], axis=1) for r in rows]).astype(np.float32) if rows else np.empty((0, 3), np.float32)
    return xyz[np.isfinite(xyz).all(axis=1)]


def read_bag(spark: SparkSession, path: str, topic: str, max_frames: int | None = None, stride: int = 1) -> DataFrame:
    """Points of a topic's PointCloud2 messages in SQLite bags (*.db3), in POINT_SCHEMA.

    Spark reads the files, so any store that it reaches will do; a task holds one file. Of each file every
    stride-th message counts, at most max_frames of them, numbered from 0. A missing topic, one of another
    type, or one without a message fails the query.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.db3").option("recursiveFileLookup", True).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                found = db.execute("SELECT id, type FROM topics WHERE name = ?", (topic,)).fetchone()
                if not found or not found[1].endswith("/PointCloud2"):
                    raise ValueError(f"{name} has no point cloud topic {topic}")
                frame = 0
                for k, (stamp, message) in enumerate(db.execute("SELECT timestamp, data FROM messages WHERE topic_id = ? ORDER BY timestamp, id", (found[0],))):
                    if k % stride:
                        continue
                    if max_frames is not None and frame >= max_frames:
                        break
                    xyz = decode_pointcloud(message)
                    yield pd.DataFrame({"case_id": name.rsplit("/", 2)[-2], "frame_index": np.int32(frame), "stamp_ns": np.int64(stamp), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})
                    frame += 1
                if not frame:
                    raise ValueError(f"{name} has no message on {topic}")

    return files.select("path", "content").mapInPandas(run, POINT_SCHEMA)


def limited_frames(points: DataFrame, keys: Sequence[str], stamp: str, max_frames: int, stride: int = 1) -> DataFrame:
    """Points of each group's every stride-th frame, at most max_frames of them: frames are ranked alone, then joined."""
    frames = points.select(*keys, stamp).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(stamp)) - 1)
    return points.join(frames.where((F.col("_r") % stride == 0) & (F.col("_r") < max_frames * stride)).drop("_r"), [*keys, stamp])
