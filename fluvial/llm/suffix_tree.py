"""LM scoring: a probabilistic suffix tree over words, with contexts of up to `depth` words."""

from __future__ import annotations

import gc
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvial.llm.common import crc_bucket, ensure_checkpoint_dir
from fluvial.llm.tokens import chunks_of, give_back, giving_back, runs_of

#: The end of a text as a token: a hash of what no word is.
END = xxhash.xxh64_intdigest("\n") - 2**63
#: Bytes of text that a task encodes, counts or scores at a time.
RUN_BYTES = 4 << 20
#: Tokens of a run, about, whose contexts are looked up at a time; a text is never cut.
SLICE_TOKENS = 1 << 17
#: Tokens whose counts meet in one group, about.
GROUP_TOKENS = 2_000_000
#: Bits of the filter of the model's keys, at most; more keys than that only let more rows through to the join.
MOST_BITS = 1 << 29
#: So many of the model's most frequent entries, at most, are summed in the tasks, without the join.
NEAR = 1_000_000


def _stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words as 64-bit hashes and the end last, the number of each token in order, tokens a text."""
    names, codes, sizes = chunks_of(pc.ascii_lower(texts.fill_null("")))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) - 2**63 for w in names), np.int64, len(names))
    codes = np.insert(codes.astype(np.int64), np.cumsum(sizes), len(names))
    return np.append(hashes, END), codes, sizes + 1


def _hash(values: np.ndarray, seed) -> np.ndarray:
    """What Spark's xxhash64 makes of a long that follows the given seed."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    x = turned(values.view(np.uint64) * p2, 31) * p1
    x ^= (seed.view(np.uint64) if isinstance(seed, np.ndarray) else np.full(1, seed, np.uint64)) + p5 + np.uint64(8)
    x = turned(x, 27) * p1 + p4
    x ^= x >> np.uint64(33)
    x *= p2
    x ^= x >> np.uint64(29)
    x *= p3
    x ^= x >> np.uint64(32)
    return x.view(np.int64)


def _key(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Key of an entry: Spark's xxhash64 of the keys of its context and of the entry without its first word."""
    return _hash(suffix, _hash(context, 42))


def _levels(hashes: np.ndarray, codes: np.ndarray, sizes: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For contexts of 1 to depth words: places that have one, keys of these contexts, of what is a word shorter, of all.

    A text begins after an end, before which nothing is. The key of one word is its hash.
    """
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    suffix = hashes[codes]
    for length in range(1, depth + 1):
        at = np.flatnonzero(place >= length - 1)
        context = np.where(place[at] > 0, suffix[at - 1], END) if length == 1 else suffix[at - 1]
        key = np.zeros(len(codes), np.int64)
        key[at] = _key(context, suffix[at])
        yield at, context, suffix[at], key[at]
        suffix = key


@dataclass
class Model:
    """The states kept, as a table that grows with the corpus.

    A state's distribution: the symbols told (with their own smoothed probability), and for the others the
    parent's scaled so that all sum to 1. The parent of a context is the context without its first word; the
    root is the base distribution. So log10 of a token's probability is `root` of its word, and for contexts of
    1, 2, ... words before it `back` of the context (its scale, if it is a state) and `more` of the context and
    the word (what being told adds). A context has as many tokens after it as it has places.
    """

    tokens: int
    vocabulary: int
    depth: int
    values: DataFrame  # key, n, word, root, more, back

    def base(self, n):
        return math.log10((n + 1) / (self.tokens + self.vocabulary + 1))


def _swept(spark: SparkSession) -> None:
    """Shuffled rows of earlier steps go from the disks: Spark deletes them when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _saved(df: DataFrame) -> DataFrame:
    """df from the shared folder, computed once; rows hold up to some MB, so few of them are read at a time."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/suffix-tree-{uuid.uuid4()}"
    _swept(spark)
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _dropped(*saved: DataFrame) -> None:
    """Takes saved tables that nothing reads any more from the shared folder."""
    for df in saved:
        files = df.inputFiles()
        if files:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


RUNS = "row array<long>, doc_id array<long>, train array<boolean>, sizes array<int>, codes binary, hashes binary"


def _encoded(docs: DataFrame) -> DataFrame:
    """Runs of about RUN_BYTES of the texts of docs (doc_id, train, text) as token numbers and their words' hashes, saved."""

    def run(batches):
        for batch in batches:
            for a, b in runs_of(batch.column(3), RUN_BYTES):
                hashes, codes, sizes = _stream(batch.column(3).slice(a, b - a))
                # the most frequent first, and bytes of one weight side by side: both compress well
                often = np.argsort(-np.bincount(codes, minlength=len(hashes)), kind="stable")
                rank = np.empty(len(often), "<i4")
                rank[often] = np.arange(len(often))
                hashes, packed = hashes[often], rank[codes].view(np.uint8).reshape(-1, 4).T.tobytes()
                whole = pa.array([0, b - a], pa.int32())
                lists = [pa.ListArray.from_arrays(whole, pa.concat_arrays([c])) for c in (*(batch.column(k).slice(a, b - a) for k in range(3)), pa.array(sizes, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([packed], pa.binary()), pa.array([hashes.tobytes()], pa.binary())], names=["row", "doc_id", "train", "sizes", "codes", "hashes"])

    return _saved(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "train", "text").mapInArrow(giving_back(run), RUNS))


def _read(batches) -> Iterator[tuple]:
    """hashes, codes, sizes, and whether each document is learnt from, its row and its doc_id (Arrow) of each run."""
    for batch in batches:
        for i in range(batch.num_rows):
            row, doc, train, sizes, codes, hashes = (batch.column(k)[i] for k in range(6))
            yield np.frombuffer(hashes.as_buffer(), np.int64), np.frombuffer(codes.as_buffer(), np.uint8).reshape(4, -1).T.copy().view("<i4")[:, 0], sizes.values.to_numpy().astype(np.int64), train.values.to_numpy(zero_copy_only=False), row.values.to_numpy(), doc.values


def _dealt(group: np.ndarray, groups: int) -> np.ndarray:
    """Order by group that leaves the order within a group; short numbers sort by their bits."""
    return np.argsort(group.astype(np.uint16) if groups <= 1 << 16 else group, kind="stable")


def _counted(runs: DataFrame, length: int, least: int, tokens: int = 0, bits=None, frequent=None) -> DataFrame:
    """(c, s, n): how often a context c of `length` words and the word that ends s come together, from `least` on; saved.

    Without contexts c is 0. What is so frequent holds only shorter ones as frequent, so a filter of these (bits) keeps
    most others from being dealt out. Each run sends packed arrays to groups by context; frequent contexts
    are dealt out by entry, so no group holds more than its share.
    """
    groups = max(64, tokens // GROUP_TOKENS)

    def run(batches):
        for hashes, codes, sizes, train, _, _ in _read(batches):
            codes, sizes = codes[np.repeat(train, sizes)], sizes[train]
            if length:
                for _, c, s, key in _levels(hashes, codes, sizes, length):  # the last one counts; the others go at once
                    pass
                use = np.flatnonzero(_maybe(bits.value, c) & _maybe(bits.value, s))
                order = np.argsort(key[use])
                key = key[use[order]]
                first = np.flatnonzero(np.diff(key.view(np.uint64), prepend=~key[:1].view(np.uint64)))
                i, key, n = use[order[first]], key[first], np.diff(np.append(first, len(key)))
                c, s = c[i], s[i]
                by = np.where(_find(frequent.value, c) >= 0, key, _hash(c, 7))
            else:
                n = np.bincount(codes, minlength=len(hashes))
                s, n = hashes[n > 0], n[n > 0]
                c, by = np.zeros(len(s), np.int64), s
            group = (by.view(np.uint64) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(c)
            order = order[_dealt(group[order], groups)]
            c, s, n, group = c[order], s[order], n[order], group[order]
            n = n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32)
            cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
            out = [(int(group[a]), c[a:b].tobytes(), s[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "c", "s", "n"])

    def gather(_, table):
        c, s, n = ([x.as_buffer() for x in table[k]] for k in ("c", "s", "n"))
        n = np.concatenate([np.frombuffer(x, np.uint8 if x.size * 8 == y.size else np.uint32) for x, y in zip(n, s)])
        c, s = (np.concatenate([np.frombuffer(x, np.int64) for x in y]) for y in (c, s))
        key = _key(c, s)
        give_back()
        order = np.argsort(key)
        first = np.flatnonzero(np.diff(key[order].view(np.uint64), prepend=~key[order[:1]].view(np.uint64)))
        n = np.add.reduceat(n[order].astype(np.int64), first)
        at, n = order[first][n >= least], n[n >= least]
        order = np.lexsort((s[at], c[at]))
        return pa.table({"c": c[at][order], "s": s[at][order], "n": n[order]})

    packed = runs.mapInArrow(giving_back(run), "part long, c binary, s binary, n binary")
    return _saved(packed.groupBy("part").applyInArrow(gather, "c long, s long, n long"))


def _tested(near: DataFrame, tokens: int, kappa: float) -> DataFrame:
    """near (c, s, n, parent, total) with log, more and, in one row a context, back.

    An entry is told if n * |ln(p / parent)| is more than what it costs to write, half the logarithm of the number of
    tokens. A context is a state if what its entries gain on the training text, less what they cost, and what the
    symbols not told lose or gain by the scale, is positive. A context's entries meet in one task, at most one
    for each different word after it; Spark sorts them on disk where they are many.
    """
    cost = 0.5 * math.log(max(2, tokens))
    by = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parent = F.pow(F.lit(10.0), F.col("parent"))
    rows = near.withColumn("p", (F.col("n") + kappa * parent) / (F.col("total") + kappa)).withColumn("gain", F.col("n") * (F.ln("p") - F.col("parent") * math.log(10)))
    rows = rows.withColumn("told", F.abs("gain") > cost)
    over = lambda x: F.coalesce(F.sum(F.when(F.col("told"), x)).over(by), F.lit(0.0))
    rows = rows.select("*", over(F.col("gain") - cost).alias("worth"), over(F.col("p")).alias("ps"), over(parent).alias("qs"), over(F.col("n").cast("double")).alias("ns"), (F.row_number().over(Window.partitionBy("c").orderBy("s")) == 1).alias("first"))
    rows = rows.withColumn("scale", F.greatest(F.lit(1e-12), (1 - F.col("ps")) / F.greatest(F.lit(1e-12), 1 - F.col("qs"))))
    state = (F.col("ps") > 0) & (F.col("ps") < 1) & (F.col("qs") < 1) & (F.col("worth") + (F.col("total") - F.col("ns")) * F.ln("scale") > 0)
    rows = rows.withColumn("back", F.when(state, F.log10("scale"))).withColumn("own", F.when(state & F.col("told"), F.log10("p")))
    log = F.coalesce("own", F.col("parent") + F.coalesce("back", F.lit(0.0)))
    return rows.select("c", "s", "n", "total", log.alias("log"), (F.col("own") - F.col("parent") - F.col("back")).alias("more"), F.when(F.col("first"), F.col("back")).alias("back"))


def states(runs: DataFrame, depth: int = 3, least: int = 3, kappa: float = 4.0) -> Model:
    """The model of the documents of runs that are learnt from: Spark counts, tests and keeps; no part comes to the driver.

    Every word is counted. Longer entries count from `least` occurrences on, with contexts of up to depth words, as long
    as a shorter one makes any state; beyond that the divergence test alone decides.
    """
    send = runs.sparkSession.sparkContext.broadcast
    one = _counted(runs, 0, 1)
    whole = one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, vocabulary = int(whole["n"]), int(whole["v"])
    level = one.select(F.col("s").alias("key"), "n", F.log10((F.col("n") + 1) / F.lit(float(tokens + vocabulary + 1))).alias("log"))
    none, values, held = F.lit(0.0), [], [one]
    words = level.select("key", "n", F.lit(True).alias("word"), F.col("log").alias("root"), none.alias("more"), none.alias("back"))
    for length in range(1, depth + 1):
        bits = send(_filter(level.where(F.col("n") >= least).select("key")))
        # a word of which each thousandth token is one, or a longer context as frequent: 1000 at most
        frequent = send(np.sort(level.where(F.col("n") > tokens // 1000).select("key").toArrow()["key"].to_numpy()))
        found = _counted(runs, length, least, tokens, bits, frequent)
        near = _saved(found.join(level.select(F.col("key").alias("s"), F.col("log").alias("parent")), "s"))
        _dropped(found)
        tested = _saved(_tested(near.join(level.select(F.col("key").alias("c"), F.col("n").alias("total")), "c"), tokens, kappa).select(F.xxhash64("c", "s").alias("key"), "n", "log", "more", "c", "total", "back"))
        _dropped(near, *held[1:])
        told = tested.where("more IS NOT NULL").select("key", "n", F.lit(False).alias("word"), none.alias("root"), "more", none.alias("back"))
        scales = tested.where("back IS NOT NULL").select(F.col("c").alias("key"), F.col("total").alias("n"), F.lit(False).alias("word"), none.alias("root"), none.alias("more"), "back")
        values.append(_saved(told.unionByName(scales)))
        held, level = [one, tested], tested.select("key", "n", "log")
        bits.destroy()
        if values[-1].isEmpty():
            break
    every = words
    for x in values:
        every = every.unionByName(x)
    model = _saved(every.groupBy("key").agg(F.max("n").alias("n"), F.max("word").alias("word"), *(F.sum(x).alias(x) for x in ("root", "more", "back"))))
    _dropped(*values, *held)
    return Model(tokens, vocabulary, depth, model)


@dataclass
class SuffixTree:
    """A small corpus's model in memory: key -> (is a word, root, more, back)."""

    model: Model
    entries: dict[int, tuple[bool, float, float, float]]

    def log10(self, before: list[str], word: str | None) -> float:
        """log10 of the probability of a word, None for the end, after the words before it in its text."""
        hashed = lambda w: END if w is None else xxhash.xxh64_intdigest(w) - 2**63
        none = (False, 0.0, 0.0, 0.0)
        token = hashed(word)
        known, total, _, _ = self.entries.get(token, none)
        total = total if known else self.model.base(0)
        text = np.array([hashed(w) for w in (None, *before)], np.int64)
        keys, last = text, np.array([token], np.int64)  # of the entries that end at each place, and of the one that ends at the word
        for length in range(1, self.model.depth + 1):
            if len(keys) == 0 or length > len(before) + 1 or (length > 1 and length > len(before)):
                break
            context = keys[-1:]
            last = _key(context, last)
            total += self.entries.get(int(context[0]), none)[3] + self.entries.get(int(last[0]), none)[2]
            keys = _key(keys[:-1], keys[1:])
        return total


def learn(docs: DataFrame, **options) -> SuffixTree:
    """The whole model of all texts on the driver, so for small corpora only."""
    model = states(_encoded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("train"), F.col("text").cast("string").alias("text"))), **options)
    return SuffixTree(model, {r.key: (r.word, r.root, r.more, r.back) for r in model.values.collect()})


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in sorted keys, -1 where missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _frequent(values: DataFrame, most: int) -> Column:
    """Whether a key is of the most frequent ones, `most` at most; counts are told apart in sixteenths of a power of two."""
    level = F.floor(16 * F.log2("n"))
    have, least = 0, 1 << 20
    for x in sorted(values.groupBy(level.alias("level")).count().collect(), key=lambda x: -x["level"]):  # some 600 rows
        have += x["count"]
        if have > most:
            break
        least = x["level"]
    return level >= least


def _filter(values: DataFrame) -> np.ndarray:
    """Bits, a power of two and MOST_BITS at most, of which two are set for each key: by its leading bits and its hash's."""
    most = values.count() * 16
    width = min(MOST_BITS.bit_length() - 1, max(20, most.bit_length()))
    at = values.select(F.explode(F.array("key", F.xxhash64("key"))).alias("key")).select(F.shiftrightunsigned("key", 64 - width).alias("at"))
    rows = at.select(F.shiftright("at", 15).alias("bucket"), F.col("at").bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros(1 << (width - 3), np.uint8)
    for batch in rows.toArrow().to_batches():
        for bucket, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            bits[bucket << 12 : (bucket + 1) << 12] = np.frombuffer(part.as_buffer(), np.uint8)
    return bits


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be among those of the filter; False is sure."""

    def there(x: np.ndarray) -> np.ndarray:
        at = x.view(np.uint64) >> np.uint64(64 - (len(bits).bit_length() + 2))
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    found = there(keys)
    at = np.flatnonzero(found)
    found[at] = there(_hash(keys[at], 42))
    return found


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """First and last text, and first and last token, of parts of a run of about SLICE_TOKENS, one text at least."""
    ends, a, start = np.cumsum(sizes), 0, 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, start + SLICE_TOKENS, "right")))
        yield a, b, start, int(ends[b - 1])
        a, start = b, int(ends[b - 1])


class _Sorted:
    """Sorted keys, which are hashes, with the place where each range of their leading bits begins."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.width = keys, max(8, min(26, len(keys).bit_length() + 1))
        self.starts = np.searchsorted(self._lead(keys), np.arange((1 << self.width) + 1)).astype(np.int32)

    def _lead(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - self.width)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of wanted, -1 where missing."""
        found, lead = np.full(len(wanted), -1), self._lead(wanted)
        at, end = self.starts[lead], self.starts[lead + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):  # as often as the fullest range has keys
            hit = self.keys[at[open_]] == wanted[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return found


DOCS = [pa.field("doc_id", pa.int64()), pa.field("tokens", pa.int64()), pa.field("known", pa.int64()), pa.field("root", pa.float64()), pa.field("logs", pa.float64())]
#: What a run asks a part of the model: places of texts in the run, keys, and how often, less than 0 for words.
ASKED = pa.schema([("part", pa.int64()), ("run", pa.int64()), ("who", pa.binary()), ("key", pa.binary()), ("times", pa.binary()), ("docs", pa.list_(pa.struct(DOCS)))])
ASKED_SCHEMA = "part long, run long, who binary, key binary, times binary, docs array<struct<doc_id: long, tokens: long, known: long, root: double, logs: double>>"
#: What a part answers: sums by place of a text.
TOLD = pa.schema([("part", pa.int64()), ("run", pa.int64()), ("who", pa.binary()), ("known", pa.binary()), ("root", pa.binary()), ("logs", pa.binary()), ("docs", pa.list_(pa.struct(DOCS)))])
TOLD_SCHEMA = "part long, run long, who binary, known binary, root binary, logs binary, docs array<struct<doc_id: long, tokens: long, known: long, root: double, logs: double>>"


def _joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all packed cells in order, and how many each holds."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.array([len(x) for x in parts], np.int64)


def _told(asked: pa.Table, values: pa.Table, unseen: float) -> pa.Table:
    """Sums of a part of the model's values (key, word, root, value) over what runs ask of it; rows of documents go through."""
    mine = asked.filter(pc.is_valid(asked["who"]))
    (who, sizes), (key, _), (times, _) = (_joined(mine[n], kind) for n, kind in (("who", np.int32), ("key", np.int64), ("times", np.int32)))
    keys = values["key"].to_numpy()
    order = np.argsort(keys)
    word, root, value = (values[n].to_numpy()[order] for n in ("word", "root", "value"))
    place = _find(keys[order], key)
    # times are negative for words, which are unseen where the table lacks them
    often, missing = np.abs(times), np.where(times < 0, unseen, 0.0)
    give = lambda x, other: np.where(place >= 0, x[np.maximum(place, 0)], other) if len(x) else other
    cell = np.repeat(np.arange(len(sizes)), sizes)
    new = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
    sums = [np.add.reduceat(often * x, new) if len(new) else np.zeros(0) for x in ((times < 0) & give(word, False), give(root, missing), give(value, missing))]
    kept = np.flatnonzero(sums[0].astype(bool) | (sums[1] != 0) | (sums[2] != 0))
    cell, who, known, root, logs = cell[new[kept]], who[new[kept]], sums[0][kept].astype(np.int32), sums[1][kept], sums[2][kept]
    ends = np.searchsorted(cell, np.arange(len(sizes) + 1))
    packed = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
    told = pa.table([mine["part"], mine["run"], *map(packed, (who, known, root, logs)), mine["docs"]], schema=TOLD)
    docs = asked.filter(pc.is_null(asked["who"]))
    none = pa.nulls(docs.num_rows, pa.binary())
    return pa.concat_tables([told, pa.table([docs["part"], docs["run"], none, none, none, none, docs["docs"]], schema=TOLD)])


SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _summed(told: pa.Table) -> pa.Table:
    """A run's documents with what all parts told of them, added up in the parts' order."""
    docs = told.filter(pc.is_valid(told["docs"]))["docs"].combine_chunks().flatten()
    told = told.filter(pc.is_valid(told["who"])).sort_by("part")
    who, _ = _joined(told["who"], np.int32)
    known, root, logs = (np.bincount(who, _joined(told[n], kind)[0], len(docs)) for n, kind in (("known", np.int32), ("root", np.float64), ("logs", np.float64)))
    field = lambda n: docs.field(n).to_numpy()
    return pa.table([docs.field("doc_id"), docs.field("tokens"), pa.array(field("known") + known.astype(np.int64)), pa.array(field("root") + root), pa.array(field("logs") + logs)], schema=SCORED)


def score(docs: DataFrame, folds: int = 7, held: int = 2, **options) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from documents whose fold isn't `held`. Tokens are words, lower-cased in A-Z, and one end
    a text. base_score is log10 of the add-one unigram probability; score that of the tree, whose root is the
    same distribution, with all words never seen as one symbol. Texts are split into words once and kept as
    numbers. A score is a sum of the model's values over a text's words and the contexts before them. Tasks hold
    the values of the most frequent ones (NEAR of them at most) and sum these at once; of the others, those that
    a filter of bounded size can't rule out go as packed arrays to the parts of the table of values, by key, and
    the parts' sums come back to their run, so no model has to fit anywhere.
    Null and empty texts are one end; without training rows every token is unknown and both scores are 0.
    Repeated rows give repeated results; null ids are in fold 0; other columns are ignored. Hashes are of 64 bits.
    """
    train = crc_bucket(F.col("doc_id"), folds) != held
    runs = _encoded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("train", train))
    model = states(runs, **options)
    value = F.col("root") + F.col("more") + F.col("back")
    near = model.values.where(_frequent(model.values, NEAR)).select("key", "root", value.alias("value")).toArrow()
    order = np.argsort(near["key"].to_numpy())
    near = [_Sorted(near["key"].to_numpy()[order]), *(near[n].to_numpy()[order] for n in ("root", "value"))]
    unseen, depth = model.base(0), model.depth
    sent = docs.sparkSession.sparkContext.broadcast((near, _filter(model.values)))

    give = lambda x, place, other: np.where(place >= 0, x[np.maximum(place, 0)] if len(x) else 0.0, other)

    groups = max(64, model.tokens // GROUP_TOKENS)

    def run(batches):
        (keys, roots, values), bits = sent.value
        for hashes, codes, sizes, _, row, doc in _read(batches):
            place = keys.find(hashes)
            asked = (place < 0) & _maybe(bits, hashes)
            other = np.where(asked, 0.0, unseen)
            words = [give(roots, place, other), give(values, place, other), place >= 0]
            sums, rest = [], []
            for a, b, start, end in _slices(sizes):
                found, ask = part(hashes, codes[start:end], sizes[a:b], words, asked)
                sums.append(found)
                rest += [(who + np.int32(a), key, n) for who, key, n in ask]
            root, logs, known = np.concatenate(sums, axis=1)
            docs = pa.StructArray.from_arrays([doc.cast(pa.int64()), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(root), pa.array(logs)], fields=DOCS)
            who, key, times = map(np.concatenate, zip(*rest))
            group = np.mod(key, groups)
            order = np.argsort(who, kind="stable")
            order = order[_dealt(group[order], groups)]
            who, key, times, group = who[order], key[order], times[order], group[order]
            cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])] + [None], pa.binary()) for x in (who, key, times)]
            number = pa.array([*group[cuts[:-1]], row[0] % groups], pa.int64())
            whole = pa.ListArray.from_arrays(pa.array([None] * (len(cuts) - 1) + [0, len(docs)], pa.int32()), docs)
            yield pa.RecordBatch.from_arrays([number, pa.array(np.full(len(cuts), row[0])), *packed, whole], schema=ASKED)

    def part(hashes, codes, sizes, words, asked):
        (keys, _, values), bits = sent.value
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        sums = np.stack([np.bincount(owner, x[codes], len(sizes)) for x in words])
        i = np.flatnonzero(asked[codes])
        rest, ask = [(-1, owner[i], hashes[codes[i]])], []
        for at, _, _, key in _levels(hashes, codes, sizes, depth):
            i = np.flatnonzero(_maybe(bits, key))
            who, key = owner[at[i]], key[i]
            place = keys.find(key)
            sums[1] += np.bincount(who, give(values, place, 0.0), len(sizes))
            rest.append((1, who[place < 0], key[place < 0]))
        for sign, who, key in rest:
            order = np.argsort(key)
            order = order[_dealt(who[order], len(sizes))]
            who, key = who[order], key[order]
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(who)), bool), (who[1:] != who[:-1]) | (key[1:] != key[:-1])]))
            ask.append((who[new], key[new], np.diff(np.append(new, len(who))).astype(np.int32) * np.int32(sign)))
        return sums, ask

    asked = runs.mapInArrow(giving_back(run), ASKED_SCHEMA)
    values = model.values.select(F.pmod("key", F.lit(groups)).alias("part"), "key", "word", "root", value.alias("value"))
    told = asked.groupBy("part").cogroup(values.groupBy("part")).applyInArrow(lambda a, b: _told(a, b, unseen), TOLD_SCHEMA)
    summed = told.groupBy("run").applyInArrow(_summed, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    _swept(docs.sparkSession)
    return summed.select("doc_id", (crc_bucket(F.col("doc_id"), folds) == held).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
