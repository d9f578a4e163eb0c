"""N-gram Jaccard join: size-banded tiles, hashed bitmaps that bound overlap, exact intersection.

Plain tiles of all sets of a size band compare a number of pairs that grows with the square of the input.
Here a band's sets are dealt into tiles by parts: a set's hashed n-grams fall into as many parts as sets that
link can differ in, and some more, so two that link agree in a whole part that isn't empty. A tile is the
sets of a band that agree in one part. No pair that links is lost, and sets that share only a passage seldom
meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.llm.common import cut, settle
from fluvial.llm.components import connected_components
from fluvial.llm.tokens import chunks_of, giving_back, runs_of

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
#: Width of a size band: the next begins at so many times its lower end.
RATIO = 1.4
#: Bytes of text that a task hashes at a time.
RUN_BYTES = 1 << 20
#: Hashes that a task intersects at a time.
MOST_HASHES = 4 << 20


def _mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * by
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, n: int, run_bytes: int = RUN_BYTES) -> Iterator[np.ndarray]:
    """For each text of an Arrow array the sorted different 64-bit hashes of its n-grams of words.

    Words are lower-cased in A-Z; a text with fewer than n is one n-gram of all; one without has none. About
    run_bytes of text are hashed at a time.
    """
    for a, b in runs_of(texts, run_bytes):
        names, codes, sizes = chunks_of(pc.ascii_lower(texts.slice(a, b - a).fill_null("")))
        h = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))[codes] if len(codes) else np.empty(0, np.uint64)

        def grams(of: np.ndarray, width: int) -> np.ndarray:
            count = max(0, len(of) - width + 1)
            out = np.full(count, np.uint64(width))
            for j in range(width):
                out = _mix(out * _C + of[j : j + count], _A)
            return out

        full = grams(h, n)
        upto = np.cumsum(sizes)
        for size, end in zip(sizes, upto):
            if size >= n:
                yield np.unique(full[end - size : end - n + 1])
            else:
                yield grams(h[end - size : end], int(size)) if size else np.empty(0, np.uint64)


def set_id(hashes: np.ndarray) -> int:
    """64-bit id of a set; equal sets have equal ids."""
    return xxhash.xxh64_intdigest(hashes.tobytes()) - 2**63


def bands_of(size: int, percent: int) -> list[tuple[int, int, int]]:
    """Bands in which a set of this size meets others, with the number of parts there and of those to spare.

    It meets its own band, and each above in which a set can be similar enough: one at most from 72 percent
    on, more below. Two sets of a band's tiles have at most its upper end each, so they differ in at most
    (1 - t) / (1 + t) * 2 * (upper end) members; there is one part more, and some to spare for parts that are
    empty in both. Where sets can't differ, equal ones alone link, and no band is needed.
    """
    found = []
    own = int(math.log(size) / math.log(RATIO))
    while RATIO ** (own + 1) <= size:
        own += 1
    while RATIO**own > size:
        own -= 1
    band = own - 1
    while band < own or size * 100 >= percent * RATIO ** (band + 1):
        band += 1
        differ = int((100 - percent) * 2 * RATIO ** (band + 1) / (100 + percent))
        spare = 2 + differ // 50
        if differ:
            found.append((band, differ + 1 + spare, spare))
    return found


def part_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the tiles that a set is in.

    If more parts are empty than those to spare, the empty ones get keys too: two sets that both have so many
    may agree in nothing else.
    """
    keys = []
    for band, parts, spare in bands_of(len(hashes), percent):
        part = (hashes % np.uint64(parts)).astype(np.int64)
        content = np.zeros(parts, np.uint64)
        np.add.at(content, part, _mix(hashes, _B))
        full = np.bincount(part, minlength=parts) > 0
        chosen = np.arange(parts) if (~full).sum() > spare else np.flatnonzero(full)
        keys.append(_mix(content[chosen] * _C + chosen.astype(np.uint64) * _D + np.uint64(band + 1), _A))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set: words of 64 bits, 8 to 16 bits a member."""
    width = 1 << max(6, (8 * len(hashes) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[((hashes * _D) >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def fold(m: np.ndarray, width: int) -> np.ndarray:
    """A bitmap at a lesser width: its places are the higher bits of the same product."""
    return m if len(m) * 64 <= width else np.packbits(np.unpackbits(m.view(np.uint8)).reshape(width, -1).max(axis=1)).view(np.uint64)


def folded(bitmaps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps as rows of one width, the least of theirs."""
    width = min(map(len, bitmaps)) * 64
    return np.stack([fold(m, width) for m in bitmaps])


def overlap_bounds(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of a set with others: a bit that only one has stands for a member that it has alone."""
    return np.minimum(size - np.bitwise_count(one & ~others).sum(axis=1, dtype=np.int64), sizes - np.bitwise_count(others & ~one).sum(axis=1, dtype=np.int64))


def similar(overlap, size_a, size_b, percent: int):
    return 100 * overlap >= percent * (size_a + size_b - overlap)


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_hash, size, id) of each document; id is null for an empty set."""

    def run(batches):
        for batch in batches:
            found = [(len(h), set_id(h)) if len(h) else (0, None) for h in shingle_sets(batch.column(1), n)]
            ids = [i for _, i in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([size for size, _ in found], pa.int64()), pa.array(ids, pa.int64())], names=["doc_id", "text_hash", "size", "id"])

    return _texts(docs, F.xxhash64(F.col("text").cast("string")).alias("text_hash")).mapInArrow(giving_back(run), "doc_id long, text_hash long, size long, id long")


def tiles(docs: DataFrame, n: int, percent: int, groups: int) -> DataFrame:
    """(tile, id) of every tile with two sets or more.

    Keys and ids travel as packed arrays. Within a run of rows equal sets are one, and if several sets have a
    key, all of them are told at once, wherever they come to rest, and one goes on for them; so a key brings
    its group one entry a run at most, even if a large share of all sets has it.
    """

    def split(batches):
        for texts in (x.column(1).slice(a, b - a) for x in batches for a, b in runs_of(x.column(1), RUN_BYTES)):
            seen, keys, ids = set(), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for h in shingle_sets(texts, n):
                if len(h) and (i := set_id(h)) not in seen:
                    seen.add(i)
                    keys.append(part_keys(h, percent))
                    ids.append(np.full(len(keys[-1]), i, np.int64))
            key, own = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((own, key))
            key, own = key[order], own[order]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            times = np.diff(np.append(np.flatnonzero(first), len(key)))
            told = np.repeat(times > 1, times)
            group = (key[first] % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            sent_key, sent_own, group = key[first][order], own[first][order], group[order]
            cuts = np.flatnonzero(np.diff(group, prepend=-1))
            out = [(int(group[a]), False, sent_key[a:b].tobytes(), sent_own[a:b].tobytes()) for a, b in zip(cuts, np.append(cuts[1:], len(group)))]
            if told.any():
                out.append((int(own[0]) % groups, True, key[told].tobytes(), own[told].tobytes()))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], names=["part", "told", "keys", "ids"])

    def gather(key, table):
        told = table["told"].to_numpy(zero_copy_only=False)
        read = lambda name, kind, which: np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x, w in zip(table[name].to_pylist(), told) if w == which)])
        k, i = read("keys", np.uint64, False), read("ids", np.int64, False)
        order = np.lexsort((i, k))
        k, i = k[order], i[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
        k, i = k[new], i[new]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:].copy()
        k, i = np.concatenate([k[same], read("keys", np.uint64, True)]), np.concatenate([i[same], read("ids", np.int64, True)])
        return pa.table({"tile": k.view(np.int64), "id": i})

    packed = _texts(docs).mapInArrow(giving_back(split), "part long, told boolean, keys binary, ids binary")
    return packed.groupBy("part").applyInArrow(gather, "tile long, id long")


class _Fetch:
    """Sets by id, made again from the whole texts of one document each: all that candidates need, nothing for the rest."""

    def __init__(self, docs: DataFrame, owners: DataFrame, n: int, most_broadcast: int):
        self.docs, self.owners, self.n, self.most_broadcast = docs, owners, n, most_broadcast

    def __call__(self, ids: DataFrame, hashes: bool) -> DataFrame:
        """(id, size, content, coarse) of the wanted ids: the bitmap and one down to a quarter as wide (2048 bits at least), or all hashes and null."""
        n = self.n
        owners = settle(self.owners.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("first.doc_id").alias("_want")))
        small = owners.count() <= self.most_broadcast  # 8 bytes a row; beyond that Spark shuffles
        chosen = _texts(self.docs).join(F.broadcast(owners) if small else owners, F.col("doc_id").eqNullSafe(F.col("_want")), "left_semi")

        def run(batches):
            for batch in batches:
                found = [h for h in shingle_sets(batch.column(1), n) if len(h)]
                content = [h if hashes else bitmap(h) for h in found]
                coarse = [None if hashes else fold(m, max(2048, len(m) * 16)).tobytes() for m in content]
                columns = ([set_id(h) for h in found], pa.int64()), ([len(h) for h in found], pa.int64()), ([c.tobytes() for c in content], pa.binary()), (coarse, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["id", "size", "content", "coarse"])

        found = cut(chosen.mapInArrow(giving_back(run), "id long, size long, content binary, coarse binary"))
        # documents with one id twice are rare, so only then are contents shuffled to make ids different
        return found if found.groupBy("id").count().where("count > 1").isEmpty() else cut(found.dropDuplicates(["id"]))


def _sides(pairs: DataFrame, found: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("id").alias(side), F.col("size").alias(f"n{side}"), F.col("content").alias(f"c{side}")), side)
    return pairs


def _bounded(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that bitmaps let pass."""

    def bound(batches):
        for batch in batches:
            keep = []
            for x, y, p, q in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ca", "cb"))):
                ok = similar(min(x, y), x, y, percent)
                if ok:
                    m = folded([np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)])
                    ok = bool(similar(overlap_bounds(m[0], x, m[1:], np.array([y]))[0], x, y, percent))
                keep.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _sides(pairs, maps).mapInArrow(bound, "a long, b long")


def _linked(pairs: DataFrame, fetch: _Fetch, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection of sorted hashes."""

    def exact(batches):
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("ca").to_pylist(), batch.column("cb").to_pylist()):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                keep.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    return _sides(pairs, fetch(ids, True)).mapInArrow(exact, "a long, b long")


def _placed(members: DataFrame, chunk: Column) -> DataFrame:
    """(tile, _i, _j, _own, id, component): a tile's sets of different components, dealt to groups that compare them.

    A tile of about `chunk` sets is one group. In a larger one the sets of the largest component make chunks of
    their own, which meet the others' chunks and not each other, so a tile that is nearly one component costs
    rows in proportion to it, and no group holds a whole large tile.
    """
    parts = members.groupBy("tile", "component").agg(F.count("*").alias("_c"), F.max(chunk).alias("_chunk"))
    parts = parts.groupBy("tile").agg(F.max(F.struct("_c", "component")).alias("_top"), F.sum("_c").alias("_n"), F.max("_chunk").alias("_chunk")).where(F.col("_top._c") < F.col("_n"))
    several, chunks = F.col("_n") > F.col("_chunk"), lambda n: F.ceil(n / F.col("_chunk")).cast("int")
    parts = parts.select("tile", F.col("_top.component").alias("_top"), F.when(several, chunks(F.col("_top._c"))).otherwise(F.lit(0)).alias("_most"), F.when(several, chunks(F.col("_n") - F.col("_top._c"))).otherwise(F.lit(1)).alias("_rest"))
    dealt = members.join(parts, "tile")
    large = (F.col("component") == F.col("_top")) & (F.col("_most") > 0)
    draw = F.xxhash64("id")
    own = F.when(large, F.pmod(draw, F.greatest("_most", F.lit(1)))).otherwise(F.col("_most") + F.pmod(draw, "_rest")).cast("int")
    other = F.explode(F.sequence(F.when(large, F.col("_most")).otherwise(F.lit(0)), F.col("_most") + F.col("_rest") - 1))
    placed = dealt.select("tile", "id", "component", own.alias("_own"), other.alias("_other"))
    return placed.select("tile", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "id", "component")


def _near(key, table: pa.Table, maps: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of the pairs of a group that bitmaps let pass, and the similarity that these allow, likeliest first."""
    own, comp, size = (table[c].to_numpy() for c in ("_own", "component", "size"))
    i, j = key[1].as_py(), key[2].as_py()
    rows, cols = np.flatnonzero(own == i), np.flatnonzero(own == j)
    found = []
    for r in rows:
        near = cols[comp[cols] != comp[r]]
        if i == j:
            near = near[near > r]
        if len(near):
            bound = overlap_bounds(maps[r], int(size[r]), maps[near], size[near])
            ok = similar(bound, size[r], size[near], percent)
            near, bound = near[ok], bound[ok]
            found.append((np.full(len(near), r), near, bound / (size[r] + size[near] - bound)))
    a, b, q = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    order = np.argsort(-q, kind="stable")
    return a[order], b[order], q[order]


def _joining(a: np.ndarray, b: np.ndarray, labels: np.ndarray, test=lambda x, y: True) -> list[tuple[int, int]]:
    """Of the pairs, in their order, those that join two components of labels and pass the test: fewer than there are labels."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(int(labels[x])), find(int(labels[y]))
        if p != q and test(x, y):
            root[p] = q
            kept.append((x, y))
    return kept


def _likeliest(members: DataFrame, maps: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Pairs (a, b) of sets of different components, of each group a spanning forest of those that bitmaps let pass.

    The likeliest come first, so where bitmaps order pairs rightly, the forest's pairs that link join all that
    links can join. A group gives fewer pairs than it has sets.
    """

    def compare(key, table):
        ids = table["id"].to_numpy()
        a, b, _ = _near(key, table, folded([np.frombuffer(m, np.uint64) for m in table["coarse"].to_pylist()]), percent)
        pairs = [sorted((int(ids[x]), int(ids[y]))) for x, y in _joining(a, b, table["component"].to_numpy())]
        return pa.table({"a": pa.array([p for p, _ in pairs], pa.int64()), "b": pa.array([q for _, q in pairs], pa.int64())})

    full = _placed(members, F.lit(chunk)).join(maps.select("id", "size", "coarse"), "id")
    return full.groupBy("tile", "_i", "_j").applyInArrow(compare, "a long, b long").distinct()


def _open(members: DataFrame, maps: DataFrame, column: str, percent: int, chunk: int) -> DataFrame:
    """The members (tile, id, component) that the bitmaps of this column let pass with a set of another component."""

    def compare(key, table):
        a, b, _ = _near(key, table, folded([np.frombuffer(m, np.uint64) for m in table[column].to_pylist()]), percent)
        return table.select(["tile", "id", "component"]).take(pa.array(np.unique(np.concatenate([a, b])), pa.int64()))

    full = _placed(members, F.lit(chunk)).join(maps.select("id", "size", column), "id")
    return full.groupBy("tile", "_i", "_j").applyInArrow(compare, "tile long, id long, component long").distinct()


def _joins(members: DataFrame, fetch: _Fetch, percent: int, chunk: int) -> DataFrame:
    """Links (a, b) that join components of members (tile, id, component, size), by exact intersection in each group.

    A pair of which a link within the group has already joined the components isn't intersected. Groups hold about
    MOST_HASHES hashes at most.
    """

    def compare(key, table):
        ids, hashes = table["id"].to_numpy(), [np.frombuffer(h, np.uint64) for h in table["content"].to_pylist()]
        linked = lambda x, y: bool(similar(len(np.intersect1d(hashes[x], hashes[y], assume_unique=True)), len(hashes[x]), len(hashes[y]), percent))
        a, b, _ = _near(key, table, folded([bitmap(h) for h in hashes]), percent)
        pairs = [(int(ids[x]), int(ids[y])) for x, y in _joining(a, b, table["component"].to_numpy(), linked)]
        return pa.table({"a": pa.array([p for p, _ in pairs], pa.int64()), "b": pa.array([q for _, q in pairs], pa.int64())})

    each = members.groupBy("tile").agg(F.least(F.lit(chunk), F.greatest(F.lit(1), F.floor(F.lit(MOST_HASHES) / F.max("size")))).alias("_each"))
    placed = _placed(members.join(each, "tile").select("tile", "id", "component", "_each"), F.col("_each"))
    full = placed.join(fetch(members, True).select("id", "size", "content"), "id")
    return full.groupBy("tile", "_i", "_j").applyInArrow(compare, "a long, b long")


def _labelled(members: DataFrame, component: DataFrame) -> DataFrame:
    """The members of tiles that hold sets of more than one component, with their components."""
    rows = members.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = rows.groupBy("tile").agg(F.min("component").alias("_p"), F.max("component").alias("_q")).where("_p <> _q").select("tile")
    return settle(rows.join(mixed, "tile"))


def looked_up(rows: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """rows, left-joined to names, which has each key once; a key may hold any share of the rows, and null finds nothing.

    Keys of more than a ten-thousandth of the rows (and more than 1000), so fewer than 10,000 of them, are
    broadcast with their names; no other makes a large group.
    """
    most = max(1000, rows.count() // 10_000)
    frequent = cut(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key).join(names, key, "left"))
    often = rows.join(F.broadcast(frequent), key)
    seldom = rows.where(F.col(key).isNotNull()).join(F.broadcast(frequent.select(key)), key, "left_anti").join(names, key, "left")
    none = rows.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in names.schema if f.name != key))
    return often.unionByName(seldom).unionByName(none)


def _components(docs: DataFrame, n: int, percent: int, most_broadcast: int, chunk: int) -> DataFrame:
    """(doc_id, text_hash, size, id, first) a row: first is (no id, doc_id, text_hash) of the first row of its component."""
    spark = docs.sparkSession
    own = cut(sets(docs, n))
    held = own.agg(F.sum("size")).first()[0] or 0
    # keys are about a third as many as hashes, 16 bytes each: 64 MB of them a group
    groups = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), held * 16 // 3 // (64 << 20))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    each = cut(own.where("id IS NOT NULL").groupBy("id").agg(first))
    fetch = _Fetch(docs, each, n, most_broadcast)
    every = settle(tiles(docs, n, percent, groups).distinct())
    # sets that agree in one part often agree in more: of tiles with the same sets one is enough
    marks = every.groupBy("tile").agg(F.count("*").alias("_n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("_s"), F.bit_xor(F.xxhash64("id", F.lit(7))).alias("_x"), F.min("id").alias("a"))
    tile = settle(every.join(marks.groupBy("_n", "_s", "_x", "a").agg(F.min("tile").alias("tile")).select("tile", "_n", "a"), "tile"))
    pairs = settle(tile.where("id <> a").select("a", F.col("id").alias("b")).distinct())
    maps = fetch(tile, False)
    links = settle(_linked(settle(_bounded(pairs, maps, percent)), fetch, percent))
    component = settle(connected_components(links))
    # tiles of two sets are done; in larger ones sets of different components are still to be compared
    still = _labelled(tile.where("_n > 2").select("tile", "id"), component)
    likely = settle(_likeliest(still, maps, percent, chunk).join(pairs, ["a", "b"], "left_anti"))
    extra = settle(_linked(settle(_bounded(likely, maps, percent)), fetch, percent))
    if not extra.isEmpty():
        links = links.unionByName(extra)
        component = settle(connected_components(links))
        still = _labelled(still.select("tile", "id"), component)
    for column in ("coarse", "content"):  # few are left for the wider bitmaps
        still = settle(_open(still, maps, column, percent, chunk))
    extra = settle(_joins(still.join(maps.select("id", "size"), "id"), fetch, percent, chunk))
    if not extra.isEmpty():
        component = settle(connected_components(links.unionByName(extra)))
    each = cut(each.join(component.withColumnRenamed("node", "id"), "id", "left").select("id", "first", F.coalesce("component", "id").alias("_class")))
    named = looked_up(each.select("id", "_class"), "_class", each.groupBy("_class").agg(F.min("first").alias("first")))
    return looked_up(own, "id", cut(named.select("id", "first")))


def linked_components(docs: DataFrame, n: int = 4, percent: int = 85, most_broadcast: int = 4_000_000, chunk: int = 512) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the least doc_id that links lead to.

    Sets are of hashed n-grams of words (64 bits), lower-cased in A-Z; a text with fewer words is one n-gram;
    one without words, or null, links with nothing. Two documents link when 100 * overlap >= percent * union.
    Equal sets are one set from the start. In every tile each set is checked against the least one. In tiles that
    still hold several components bitmaps choose the likeliest pairs, a spanning forest of a group, to be
    intersected; the sets that bitmaps still let pass with another component are then intersected exactly within
    their tile, as far as no link has joined them. No link between components is missed. A group gives no more
    rows than it has sets; but a tile of many sets that stay in many components is compared chunk by chunk, which
    takes rows and time with the square of its chunks. percent is from 1 to 100. Repeated rows give repeated results; a null doc_id is linked like others but names no component (null if it has only
    such rows); other columns are ignored.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    found = _components(docs, n, percent, most_broadcast, chunk)
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int = 4, percent: int = 85, most_broadcast: int = 4_000_000, chunk: int = 512) -> DataFrame:
    """The documents, with all their columns, that come first in their component: by least doc_id, null last.

    Rows that share a doc_id, or have none, are told apart by their texts: of rows with one doc_id (or none) and
    one text, one stays, and rows without doc_id stay only where nothing with an id is in their component. Texts
    without words link with nothing and all stay.
    """
    found = _components(docs, n, percent, most_broadcast, chunk)
    first = found.where(F.col("id").isNull() | F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").eqNullSafe(F.col("first")))
    first = cut(first.groupBy(F.col("doc_id").alias("_keep"), F.col("text_hash").alias("_hash")).agg(F.max(F.when(F.col("id").isNotNull(), F.lit(1)).otherwise(F.lit(0))).alias("_linked"), F.count("*").alias("_rows")))
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("_own"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    small = first.count() <= most_broadcast  # 32 bytes a row; beyond that Spark shuffles
    kept = packed.join(F.broadcast(first) if small else first, F.col("_own").eqNullSafe(F.col("_keep")) & (F.col("_text") == F.col("_hash")))
    repeated = (F.col("_rows") > 1) & (F.col("_linked") == 1)
    return kept.where(~repeated).unionByName(kept.where(repeated).dropDuplicates(["_own", "_text"])).select("_doc.*")


def oracle() -> str:
    """DuckDB SQL for the rows of op8: every pair with a shared n-gram, and components by recursion."""
    return r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS grams FROM w
), g AS (SELECT doc_id, unnest(grams) AS gram FROM s), n AS (SELECT doc_id, len(grams) AS n FROM s), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)
), u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), r(x, y) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, (SELECT min(y) FROM r WHERE r.x = n.doc_id)::BIGINT AS component_id FROM n"""
