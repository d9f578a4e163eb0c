"""Media columns: payloads kept as progressive JPEG, read back into coefficients and RGB tensors."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.llm import jpeg
from fluvial.llm.tokens import runs_of

#: Widest image in MCUs of 16 x 16 pixels.
WIDE = 64
#: Most rows of MCUs that a frame's height of 16 bits can state; a larger payload makes a wider image, up to 6.4 GB.
MOST_ROWS = 4095
#: Comment of an image that holds a payload: its bytes.
_HOLDS = re.compile(rb"payload of (\d+) bytes")
#: What damaged bytes may raise in the reader.
_DAMAGED = (ValueError, IndexError, KeyError, AttributeError, TypeError, OverflowError, ZeroDivisionError, struct.error)


def _frame(blocks: int, comment: bytes) -> jpeg.Frame:
    """Smallest near-rectangular 4:2:0 frame of so many blocks: six to a MCU."""
    mcus = -(-blocks // 6)
    rows = min(-(-mcus // WIDE), MOST_ROWS)
    cols = -(-mcus // rows)
    return jpeg.Frame(16 * cols, 16 * rows, jpeg.YCC, comment=comment)


def to_jpegs(payloads: list[bytes]) -> list[bytes]:
    """A JPEG of each payload, whose length is a positive multiple of 64: a block holds 64 bytes.

    Byte b is the coefficient b from 128 on and b - 255 below, so none is 0 and all have the same size. The
    payload fills the blocks of Y, then Cb, then Cr; blocks left over are 0. Its length is in the comment.
    """
    frames = [_frame(len(p) // 64, b"payload of %d bytes" % len(p)) for p in payloads]
    planes = [[], [], []]
    for p, f in zip(payloads, frames):
        grids = [int(np.prod(f.grid(c)[:2])) for c in range(3)]
        own = np.zeros((sum(grids), 64), np.int16)
        data = np.frombuffer(p, np.uint8).astype(np.int16).reshape(-1, 64)
        own[: len(data)] = np.where(data < 128, data - 255, data)
        a = 0
        for plane, n in zip(planes, grids):
            plane.append(own[a : a + n])
            a += n
    return jpeg.write(frames, [np.concatenate(p) for p in planes])


def payload_of(frame: jpeg.Frame, coefs: list[np.ndarray]) -> bytes | None:
    """The payload that to_jpegs stored; None for any other image."""
    found = _HOLDS.fullmatch(frame.comment)
    data = np.concatenate(coefs)
    if not found or int(found[1]) % 64 or not 0 < int(found[1]) <= data.size:
        return None
    data = data[: int(found[1]) // 64].astype(np.int16)
    return np.where(data < 0, data + 255, data).astype(np.uint8).tobytes()


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean of each channel and mean step between neighbours in a row, in thousandths, as text."""
    step = np.abs(np.diff(rgb[:, :, 1].astype(np.int16), axis=1))
    parts = [int(rgb[:, :, c].sum(dtype=np.int64)) * 1000 // (rgb.shape[0] * rgb.shape[1]) for c in range(3)]
    return f"{rgb.shape[1]}x{rgb.shape[0]}:" + ",".join(map(str, [*parts, int(step.sum(dtype=np.int64)) * 1000 // max(1, step.size)]))


def store(docs: DataFrame, batch_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, with bytes 0 up to a positive multiple of 64, as a JPEG.

    Nothing is shuffled; a task works on about batch_bytes of text at a time, or on one longer text. Null
    texts count as empty; repeated rows give repeated results; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.binary())
            for a, b in runs_of(texts, batch_bytes):
                raw = texts.slice(a, b - a).to_pylist()
                media = to_jpegs([r + b"\0" * (max(64, -(-len(r) // 64) * 64) - len(r)) for r in raw])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _coefficients(frames: list[jpeg.Frame]) -> list[list[np.ndarray] | None]:
    """jpeg.coefficients of images together; where that fails, of each half, so a damaged image alone gives None."""
    try:
        return jpeg.coefficients(frames)
    except _DAMAGED:
        half = len(frames) // 2
        return [None] if not half else _coefficients(frames[:half]) + _coefficients(frames[half:])


def decode(media: DataFrame, column: str = "media", tensors: bool = True, payload: bool = False, batch_bytes: int = 1 << 20) -> DataFrame:
    """media's columns and, decoded from a column of progressive JPEGs: width, height, feature.

    With tensors also rgb, height * width * 3 bytes at full resolution; with payload the bytes that store
    kept, null for an image that it didn't make. Images of one script and one set of tables are decoded
    together. A null image, one that can't be read, or whose bytes end too early, gives nulls, and no other
    image suffers. Columns of media that have one of these names give way to the decoded ones.
    """
    spec = [("width", "int", pa.int32()), ("height", "int", pa.int32()), ("feature", "string", pa.string())] + [("rgb", "binary", pa.binary())] * tensors + [("payload", "binary", pa.binary())] * payload
    media = media.drop(*({n for n, _, _ in spec} - {column}))
    if column in {n for n, _, _ in spec}:
        raise ValueError(f"the images can't be in a column named {column}")
    schema = ", ".join([f"`{n}` {t}" for n, t in media.dtypes] + [f"{n} {t}" for n, t, _ in spec])

    def read(raw: list[bytes | None]) -> list[tuple]:
        frames: dict[int, jpeg.Frame] = {}
        for i, r in enumerate(raw):
            try:
                if r is not None:
                    frames[i] = jpeg.parse(r)
            except _DAMAGED:
                pass  # not an image of this kind: nulls
        found = [(None,) * len(spec)] * len(raw)
        for (i, f), coefs in zip(frames.items(), _coefficients(list(frames.values())) if frames else []):
            if coefs is not None:
                rgb = jpeg.pixels(f, coefs)
                found[i] = (f.width, f.height, feature_of(rgb)) + (rgb.tobytes(),) * tensors + ((payload_of(f, coefs),) if payload else ())
        return found

    def run(batches):
        for batch in batches:
            images = batch.column(batch.schema.get_field_index(column))
            for a, b in runs_of(images, batch_bytes):
                own = list(zip(*read(images.slice(a, b - a).to_pylist())))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *(pa.array(c, t) for c, (_, _, t) in zip(own, spec))], names=[*batch.schema.names, *(n for n, _, _ in spec)])

    return media.mapInArrow(run, schema)


def payload_features(docs: DataFrame) -> DataFrame:
    """One row per document: what store kept, read back by decode, as digests and a feature."""
    read = decode(store(docs), tensors=False, payload=True)
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
