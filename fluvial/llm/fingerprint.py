"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvial.llm.common import let, text_or_empty, words

K, SHINGLE = 256, 5


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The k least different 64-bit hashes of text's shingles of words, in order; fewer if it has fewer.

    Words are lower-cased runs between white space. A text with fewer words than a shingle has one shingle
    of all of them; an empty or null text has none. With fewer than k hashes the sketch is the whole set.
    """

    def shingles(h: Column) -> Column:
        n = F.size(h)
        one = F.array(F.xxhash64(h))
        several = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(shingle))))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < shingle, one).otherwise(several)

    hashed = F.transform(words(F.lower(text_or_empty(text))), lambda w: F.xxhash64(w))
    return F.slice(F.sort_array(F.array_distinct(let(hashed, shingles))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """Sketch of each group of rows by keys, under the column's name.

    Each hash is ranked within its group after equal ones have met, in 64 parts by hash first, so a group
    of any size is cut down to 64 * k hashes before they come together.
    """
    hashes = df.select(*keys, F.explode(column).alias("_h")).distinct().withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(64)))
    least = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_h"))).where(F.col("_r") <= k)
    return least.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the sets behind two sketches: exact if both are whole; 1 for two empty ones."""
    both = F.struct(merge(a, b, k).alias("u"), F.array_intersect(a, b).alias("i"))

    def ratio(x: Column) -> Column:
        last = F.element_at(x["u"], -1)
        return F.size(F.filter(x["i"], lambda h: h <= last)).cast("double") / F.size(x["u"])

    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(let(both, ratio))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Number of different shingles behind a sketch: exact below k, else estimated from the k-th hash."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that the second holds; 1 for an empty first set."""
    j, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (n + m) / (F.lit(1.0) + j) / n))


def encode(a: Column) -> Column:
    """A sketch as text: base64 of its hashes of 8 bytes."""
    hashes = F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.translate(F.base64(F.unhex(hashes)), "\r\n", "")


def _bounds(docs: DataFrame, rows: int, most: int) -> list[int]:
    """Ids that part the table into runs of about `rows` rows, at most `most`; the greatest id comes last."""
    least = docs.agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("top")).first()
    if not least["n"]:
        return []
    parts = min(most, -(-least["n"] // rows))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"] if parts > 1 else []
    return sorted({*cuts, least["top"]})


def with_next(docs: DataFrame, columns, rows: int = 4096, most_parts: int = 1 << 18) -> DataFrame:
    """Each document with its successor in descending doc_id; after the last comes the first.

    columns: {name: expression over doc_id and text}, computed once a row after the shuffle. Returns doc_id,
    text, these, and next_* of text and these. Ids that stand in the table part it into runs of about `rows`
    (their list, 8 bytes a run and at most most_parts of them, is what the driver holds). A row goes to its
    run, and one with a bounding id also to the run above, where it is nobody but the last one's successor;
    so each run is a window by itself and texts are shuffled once. Equal ids stand in order of text, null
    ids last. One row is its own successor.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    bounds = _bounds(docs, rows, most_parts)
    n = max(1, len(bounds))
    if bounds:
        edges = F.array(*map(F.lit, bounds)) if n < 2 else F.from_json(F.lit("[" + ",".join(map(str, bounds)) + "]"), "array<bigint>")
        steps = [1 << i for i in reversed(range(n.bit_length()))]
        # binary search: how many bounds are below doc_id
        search = lambda e: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(e, at + s - 1) < F.col("doc_id")), at + s).otherwise(at))
        run = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(let(edges, search))
        is_bound = let(edges, lambda e: F.coalesce(F.get(e, F.col("_run")) == F.col("doc_id"), F.lit(False)))
    else:
        run, is_bound = F.lit(0), F.lit(False)
    above = F.array(F.struct(F.lit(False).alias("guard"), F.col("_run").alias("run")), F.struct(F.lit(True).alias("guard"), F.pmod(F.col("_run") + 1, F.lit(n)).alias("run")))
    own = F.slice(above, 1, 1)
    dealt = docs.withColumn("_run", run).withColumn("_to", F.explode(F.when(is_bound, above).otherwise(own))).select("doc_id", "text", "_to.guard", "_to.run").repartition("run")
    full = dealt.withColumns(columns)
    order = Window.partitionBy("run").orderBy("guard", F.desc_nulls_last("doc_id"), "text")
    names = ["text", *columns]
    ahead = F.lead(F.struct(*names)).over(order)
    # without any id there is no guard, and the first row follows the last
    whole = Window.partitionBy("run").orderBy("guard", F.desc_nulls_last("doc_id"), "text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = ahead if bounds else F.coalesce(ahead, F.first(F.struct(*names)).over(whole))
    return full.withColumn("_next", ahead).where(~F.col("guard")).select("doc_id", *names, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in names))


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has the last third (floor) of code points replaced by as many first ones of the next
    document in descending doc_id, or by all if it has fewer. Null texts count as empty; an empty text has
    the empty fingerprint, and two empty ones are alike by 1. Repeated rows give repeated results; other
    columns are ignored.
    """
    near = with_next(docs, {"sketch": sketch(F.col("text"), k)})
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = near.withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third)))
    done = edited.withColumn("_sketch", sketch(F.col("_edited"), k))
    return done.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        encode(F.col("sketch")).alias("fingerprint"),
        encode(F.col("_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
    )
