"""Packing: each document is cut into power-of-two pieces, so no sequence crosses documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.llm.common import cut
from fluvial.llm.tokens import giving_back, read_tokenizer, runs_of, word_encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long"


def binary_pieces(counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and length of each piece: as many of `longest` as fit, then one for each bit of the rest."""
    powers = 1 << np.arange(longest.bit_length() - 1, -1, -1)
    each = np.empty((len(counts), len(powers)), np.int64)
    each[:, 0] = counts // longest
    each[:, 1:] = (counts[:, None] & powers[1:]) > 0
    times = each.ravel()
    owner = np.repeat(np.repeat(np.arange(len(counts)), len(powers)), times)
    length = np.repeat(np.tile(powers, len(counts)), times)
    ends = np.cumsum(length)
    base = np.concatenate([[0], np.cumsum(counts)])[owner]
    return owner, ends - length - base, length


def written_order(docs: DataFrame) -> tuple[Column, Column] | None:
    """Number of the file and row in it of docs as Spark wrote them, if docs is as it was read from parquet; else None."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:  # no table of files
        return None
    return F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long"), F.lit(0)), F.col("_metadata.row_index")


def decompose(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, batch_bytes: int = 4 << 20, order: tuple[Column, Column] | None = None) -> DataFrame:
    """Pieces of every document's ids: doc_id, start, length, ids (little-endian uint32), doc_tokens; with an order also part and row.

    longest must be a power of two. A document is its text's ids and then end_id, so a null or empty text
    gives one piece of one id. Nothing is shuffled; a worker holds about batch_bytes of text at a time.
    Repeated rows give repeated pieces; a null doc_id stays null; other columns are ignored.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))  # a vocabulary file: fixed size

    def run(batches):
        encoder = word_encoder(spec.value)
        for batch in batches:
            for a, b in runs_of(batch.column(1), batch_bytes):
                ids, counts = encoder.encode(batch.column(1).slice(a, b - a))
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                owner, start, length = binary_pieces(counts, longest)
                offsets = np.concatenate([[0], np.cumsum(length)]) * 4
                step = 1 << 18  # an Arrow binary column holds less than 2 GB
                for s in range(0, len(owner), step):
                    part = slice(s, s + step)
                    off = offsets[s : s + len(owner[part]) + 1]
                    blob = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off - off[0]).astype(np.int32)), pa.py_buffer(ids[off[0] // 4 : off[-1] // 4].tobytes())])
                    own, *at = (batch.column(k).slice(a, b - a).take(pa.array(owner[part])) for k in (0, *range(2, 2 + len(more))))
                    yield pa.RecordBatch.from_arrays([own, pa.array(start[part]), pa.array(length[part]), blob, pa.array(counts[owner[part]]), *at], names=["doc_id", "start", "length", "ids", "doc_tokens", *more])

    more = ("part", "row") if order else ()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c.cast("long").alias(n) for n, c in zip(more, order or ())))
    return rows.mapInArrow(giving_back(run), SCHEMA + "".join(f", {n} long" for n in more))


def number_sequences(pieces: DataFrame, blocks: int = 1024) -> DataFrame:
    """Add sequence_id and offset: pieces of a length stand together, the longest first, numbered without gaps.

    Each piece is a sequence of its own, because its length is a power of two and needs no padding. Within a
    length they keep the order of part and row, if pieces has these columns, which are then left out; else
    doc_id and start decide within blocks by hash. A length may hold most pieces, so ranks are taken in blocks, of
    neighbouring parts or by hash, and the blocks' sizes, at most blocks rows a length, give where each begins.
    """
    ordered = "part" in pieces.columns
    held = cut(pieces)
    if ordered:
        parts = (held.agg(F.max("part")).first()[0] or 0) + 1
        block, order = F.floor(F.col("part") / F.lit(-(-parts // blocks))), ["part", "row", "start"]
    else:
        block, order = F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)), [F.asc_nulls_last("doc_id"), "start"]
    held = held.withColumn("_block", block)
    sizes = held.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    # at most (bits of longest + 1) * blocks rows, whatever the input
    first = sizes.select("length", "_block", (F.sum("_n").over(Window.orderBy(F.desc("length"), "_block")) - F.col("_n")).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("length", "_block").orderBy(*order)) - 1
    return (
        held.withColumn("_rank", rank)
        .join(F.broadcast(first), ["length", "_block"])
        .withColumn("sequence_id", (F.col("_first") + F.col("_rank")).cast("long"))
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("_block", "_rank", "_first", "part", "row")
    )


def pack_documents(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, keep_order: bool = False, batch_bytes: int = 4 << 20) -> DataFrame:
    """decompose, each piece with the checksum of its ids, and number_sequences; ids are then left out.

    The ids stay available from decompose; the checksum lets the narrow rows be numbered and compared. With
    keep_order pieces of a length stand in the order in which docs was written, if it is read from files.
    """
    pieces = decompose(docs, tokenizer, longest, end_id, batch_bytes, order=written_order(docs) if keep_order else None).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return number_sequences(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
