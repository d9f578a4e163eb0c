"""Token ids as files of Re-Pair grammars: frequent pairs become rules, and any stretch of ids can be read alone.

A table of ids is a folder of Parquet files, one row a shard, in these columns:

- part, shard: the table's parts stand in order of doc_id, and a part's ids are cut into shards of equally many ids
- terminals: ids below it stand for themselves; terminals + k is rule k
- rules: pairs of symbols (little-endian uint32), each of ids or earlier rules
- lengths: how many ids each rule expands to (uint32), so a stretch is found without expanding what stands before it
- symbols: the shard's symbols (uint32)
- documents: the pieces of documents in it, as (ordinal in the part, doc_id, first id of the piece in its document,
  ids in the piece, ids in the document)
"""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvial.llm.common import ensure_checkpoint_dir
from fluvial.llm.tokens import ByteEncoder, give_back, read_tokenizer, runs_of, word_encoder

FILES = "part int, shard int, ids long, terminals long, rules binary, lengths binary, symbols binary, documents array<struct<ordinal:long,doc_id:long,start:long,length:long,total:long>>"
PIECES = "part int, ordinal long, doc_id long, at long, n_tokens long, crc long"
_DOCUMENTS = pa.list_(pa.struct([("ordinal", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("total", pa.int64())]))


#: Pairs are counted in 2 ** BITS bins first.
BITS = 18


def _bins(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bin of each pair by a multiplicative hash."""
    return (((left * np.uint32(2654435761)) ^ (right * np.uint32(2246822519))) >> np.uint32(32 - BITS)).astype(np.intp)


def compress(ids: np.ndarray, terminals: int, least: int = 16, most_rules: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (pairs) and their expansion lengths of an array of ids below terminals.

    Each round replaces, from left to right, pairs that occur at least a quarter as often as the most frequent
    bin of pairs, until none occurs `least` times; so rounds grow with the logarithm of the greatest count.
    Bins by hash bound counts from above, so that only pairs in full bins are sorted and counted exactly.
    """
    seq, rules, lengths, made = ids.astype(np.uint32), [np.empty((0, 2), np.int64)], np.ones(terminals, np.int64), 0
    while len(seq) > 1 and made < most_rules:
        bins = _bins(seq[:-1], seq[1:])
        full = np.bincount(bins, minlength=1 << BITS)
        bound = max(least, int(full.max()) // 4)
        where = np.flatnonzero((full >= bound)[bins])
        pairs = (seq[where].astype(np.int64) << 32) | seq[where + 1]
        ordered = np.sort(pairs)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
        count = np.diff(first, append=len(ordered))
        if not len(count) or count.max() < least:
            break
        frequent = np.flatnonzero(count >= min(bound, count.max()))
        chosen = ordered[first[frequent[np.argsort(count[frequent], kind="stable")]]][-(most_rules - made) :]
        # a bin holds its most frequent pair; another one of the same bin waits for a later round
        held = np.full(1 << BITS, -1)
        held[_bins((chosen >> 32).astype(np.uint32), chosen.astype(np.uint32))] = np.arange(len(chosen))
        which = held[bins[where]]
        found = chosen[which] == pairs
        hit, which = where[found], which[found]
        # of hits that overlap, the first, third and so on of each run
        begun = np.flatnonzero(np.concatenate([[True], np.diff(hit) > 1]))
        odd = (np.arange(len(hit)) - np.repeat(begun, np.diff(begun, append=len(hit)))) % 2 == 0
        at, which = hit[odd], which[odd]
        used = np.bincount(which, minlength=len(chosen)) > 0
        seq[at] = terminals + made + (np.cumsum(used) - 1)[which]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
        rules.append(np.stack([chosen[used] >> 32, chosen[used] & 0xFFFFFFFF], axis=1))
        lengths = np.concatenate([lengths, lengths[rules[-1]].sum(axis=1)])
        made += len(rules[-1])
    return seq, np.concatenate(rules), lengths[terminals:]


class Shard:
    """One shard opened for reading at any place."""

    def __init__(self, terminals: int, rules: bytes, lengths: bytes, symbols: bytes):
        self.symbols = np.frombuffer(symbols, "<u4").astype(np.int32)
        pairs = np.frombuffer(rules, "<u4").reshape(-1, 2).astype(np.int32)
        #: Of every symbol, how many ids it expands to and where they begin in flat.
        self.lengths = np.concatenate([np.ones(terminals, np.int32), np.frombuffer(lengths, "<u4").astype(np.int32)])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.concatenate([np.arange(terminals, dtype=np.int32), self._expanded(pairs, terminals)])
        self.ends = np.cumsum(self.lengths[self.symbols], dtype=np.int64)

    @staticmethod
    def _expanded(pairs: np.ndarray, terminals: int) -> np.ndarray:
        """All rules' ids one after another: every rule is replaced by its pair, again and again."""
        flat = pairs.ravel()
        while len(rule := np.flatnonzero(flat >= terminals)):
            size = np.ones(len(flat), np.int64)
            size[rule] = 2
            at = np.cumsum(size) - size
            wide = np.empty(int(size.sum()), np.int32)
            wide[at] = flat
            wide[at[rule]], wide[at[rule] + 1] = pairs[flat[rule] - terminals].T
            flat = wide
        return flat

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from start to stop; only symbols that reach into this stretch are expanded."""
        stop = (int(self.ends[-1]) if len(self.ends) else 0) if stop is None else stop
        a, b = int(np.searchsorted(self.ends, start, "right")), int(np.searchsorted(self.ends, stop, "left")) + 1
        symbols = self.symbols[a:b]
        size = self.lengths[symbols]
        ends = np.cumsum(size, dtype=np.int64)
        ids = np.repeat(self.begins[symbols] - ends + size, size)
        ids += np.arange(len(ids))
        before = int(self.ends[a - 1]) if a else 0
        return self.flat[ids[start - before : stop - before]]


def shifted(crc: int, n: int) -> int:
    """What a crc32 adds to that of a text in which n bytes follow: crc times x to the power 8n, modulo crc32's polynomial."""

    def times(a: int, b: int) -> int:
        out = 0
        for k in range(31, -1, -1):
            if a >> k & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, square = 1 << 31, 1 << 23  # x to the power 0 and 8, bits reflected
    while n:
        power = times(power, square) if n & 1 else power
        square, n = times(square, square), n >> 1
    return times(crc, power)


def _shards(batches: Iterator[pa.RecordBatch], part: int, spec: str, end_id: int, shard_ids: int, batch_bytes: int, least: int) -> Iterator[pa.RecordBatch]:
    encoder = word_encoder(spec, ByteEncoder)
    terminals = max(len(encoder.ends), end_id + 1)
    held, waiting, pieces, shard, ordinal = [], 0, [], 0, 0

    def closed(ids: np.ndarray, documents: list) -> pa.RecordBatch:
        symbols, rules, lengths = compress(ids, terminals, least)
        blobs = (pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (rules, lengths, symbols))
        listed = pa.array([[dict(zip(("ordinal", "doc_id", "start", "length", "total"), d)) for d in documents]], _DOCUMENTS)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)]), pa.array([terminals]), *blobs, listed], names=["part", "shard", "ids", "terminals", "rules", "lengths", "symbols", "documents"])

    gc.disable()  # strings, tuples and arrays alone are made, none of them in a cycle
    try:
        for batch in batches:
            for a, b in runs_of(batch.column(1), batch_bytes):
                ids, counts = encoder.encode(batch.column(1).slice(a, b - a))
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                for doc_id, total in zip(batch.column(0).slice(a, b - a).to_pylist(), counts.tolist()):
                    start = 0
                    while start < total:
                        length = min(total - start, shard_ids - waiting)
                        held.append(ids[start : start + length])
                        pieces.append((ordinal, doc_id, start, length, total))
                        waiting, start = waiting + length, start + length
                        if waiting == shard_ids:
                            yield closed(np.concatenate(held), pieces)
                            held, waiting, pieces, shard = [], 0, [], shard + 1
                    ids, ordinal = ids[total:], ordinal + 1
                held = [np.concatenate(held)] if held else []  # no view keeps a run's ids alive
        if waiting:
            yield closed(np.concatenate(held), pieces)
    finally:
        gc.enable()
        held, pieces = [], []
        give_back()


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_ids: int = 1 << 19, batch_bytes: int = 8 << 20, least: int = 16) -> None:
    """Write the ids of every document and then end_id, in ascending doc_id, as shards of the module's format.

    Texts are range-partitioned by doc_id once; each task encodes its part in runs of about batch_bytes of text
    and compresses shard_ids ids at a time, so a long text spans shards. A null or empty text is end_id
    alone. Null ids come last; equal ids keep the order of the table, which also deals a frequent id to many
    tasks. An empty table gives an empty folder of files. Other columns are ignored.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))  # a vocabulary file: fixed size

    def run(batches):
        from pyspark import TaskContext

        yield from _shards(batches, TaskContext.get().partitionId(), spec.value, end_id, shard_ids, batch_bytes, least)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("_row"))
    order = [F.asc_nulls_last("doc_id"), F.asc("_row")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, FILES).write.parquet(path)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of each shard of batches, in PIECES' columns."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k].as_py() for n in ("part", "terminals", "rules", "lengths", "symbols", "documents", "before")}
            raw = memoryview(Shard(*(row[n] for n in ("terminals", "rules", "lengths", "symbols"))).read().astype("<u4")).cast("B")
            out, at = [], 0
            for d in row["documents"]:
                crc, rest = zlib.crc32(raw[4 * at : 4 * (at + d["length"])]), d["total"] - d["start"] - d["length"]
                out.append((row["part"], d["ordinal"], d["doc_id"], row["before"] + at, d["total"], shifted(crc, 4 * rest) if rest else crc))
                at += d["length"]
            types = (pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["part", "ordinal", "doc_id", "at", "n_tokens", "crc"])
    give_back()


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of documents as the files hold them: part, ordinal, doc_id, at (its first id in the part), n_tokens, crc.

    crc is what the piece's ids add to their document's checksum: the exclusive or over its pieces is the
    crc32 of all of them.
    """

    files = spark.read.parquet(path)
    # a part's shards but the last are equally long, so a shard's place follows from its number
    longest = files.agg(F.max("ids").alias("n")).first()["n"] or 0
    return files.withColumn("before", F.col("shard").cast("long") * longest).mapInArrow(_pieces, PIECES)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # one row a part, so at most as many as the writing job had tasks
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum("ids").alias("_n"))
    before = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    found = read_pieces(spark, path).groupBy("part", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("_at"), F.first("n_tokens").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("_before") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def stored_documents(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """write_ids into a new folder of the shared checkpoint folder, and read_documents from there."""
    ensure_checkpoint_dir(docs.sparkSession)
    path = f"{docs.sparkSession.sparkContext.getCheckpointDir()}/ids-{uuid.uuid4()}"
    write_ids(docs, path, tokenizer, end_id)
    return read_documents(docs.sparkSession, path)
