"""What each of five filters removes under every order of applying them.

A document is known by its mask, the filters that it fails. In an order of filters it goes at the first one of its
mask; all orders that begin with the same filters up to that one stand together in lexicographic order. So a mask's
removals at a step cover intervals of ranks, which Lehmer's code gives, and counts added at an interval's begin and
taken away at its end become removals of all 120 orders by one running sum.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvial.llm.common import cut
from fluvial.llm.tokens import chunks_of, runs_of

FILTERS = "ABCDE"
#: Fixed value: characters of which a text that fails filter D holds one at least.
MARKS = b"#$%&*|"
MASKED = "doc_id long, part string, key binary, mask int"
#: Stands for a null id: no smaller one is known for it.
LAST = 2**63 - 1


def lehmer_rank(prefix: str, letters: str = FILTERS) -> int:
    """Lexicographic rank of the first order of letters that begins with prefix."""
    rest, rank = sorted(letters), 0
    for x in prefix:
        rank += rest.index(x) * factorial(len(rest) - 1)
        rest.remove(x)
    return rank


def intervals(letters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) for each stretch of orders in which a mask goes at a step."""
    found = []
    for mask in range(1, 1 << len(letters)):
        fails = {x for k, x in enumerate(letters) if mask >> k & 1}
        for step in range(1, len(letters) + 1):
            for prefix in permutations(letters, step):
                if prefix[-1] in fails and not fails & {*prefix[:-1]}:
                    rank = lehmer_rank(prefix, letters)
                    found.append((mask, step, rank, rank + factorial(len(letters) - step)))
    return found


def masked(docs: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, part, key (SHA-256 of the text) and mask of filters A to D, as bits from the lowest; nothing is shuffled.

    part is the source, empty for a null one. A null text is empty: it fails A alone of these.
    """

    def run(batches):
        mark = np.zeros(256, bool)
        mark[list(MARKS)] = True
        for batch in batches:
            for a, b in runs_of(batch.column(1), batch_bytes):
                texts = batch.column(1).slice(a, b - a).fill_null("")
                raw = pa.concat_arrays([texts]).cast(pa.large_binary())
                ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
                data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]] if raw.buffers()[2] else np.empty(0, np.uint8)
                ends = ends - ends[0]
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])  # noqa: B023, E731  of each text
                upper, points, marks = sums((data >= 65) & (data <= 90)), sums((data & 0xC0) != 0x80), sums(mark[data])
                names, codes, words = chunks_of(texts)
                different = np.unique(np.repeat(np.arange(len(words)), words) * max(len(names), 1) + codes) // max(len(names), 1)
                distinct = np.bincount(different, minlength=len(words))
                mask = (words < 50) | (100 * distinct < 65 * words) << 1 | (100 * upper > 5 * points) << 2 | (marks > 0) << 3
                columns = [c.slice(a, b - a) for c in (batch.column(0), batch.column(2), batch.column(3))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(mask.astype(np.int32))], names=["doc_id", "part", "key", "mask"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))
    return rows.mapInArrow(run, MASKED)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones of each part and mask of all five filters.

    Filter E: the text stands in a row of smaller doc_id, wherever it is. Equal rows are counted together
    before texts meet, and a text's rows meet its smallest id by text and id, so no join has a group of
    copies as one key. Labels of an id that is labelled more than once hold if any does; a null id has none.
    """
    rows = masked(docs).groupBy(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "part", "key", "mask").agg(F.count("*").alias("n"))
    rows = cut(rows)
    first = rows.groupBy("key").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    known = rows.join(first, ["key", "id"], "left").withColumn("mask", F.col("mask") + F.when(F.col("is_first"), F.lit(0)).otherwise(F.lit(16)))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(n) for n, c in (("good", "quality"), ("toxic", "toxic"))))
    # null ids never meet a label; salt keeps them from one task
    salt = F.when(F.col("id") == LAST, F.pmod(F.xxhash64("key"), F.lit(1024)) + 1).otherwise(F.lit(0).cast("long"))
    found = known.withColumn("_salt", salt).join(marks.withColumn("_salt", F.lit(0).cast("long")), ["id", "_salt"], "left")
    sums = (F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(F.lit(0))).alias(c) for c in ("good", "toxic"))
    return found.groupBy("part", "mask").agg(F.sum("n").alias("docs"), *sums)


def totals(found: DataFrame, letters: str = FILTERS) -> DataFrame:
    """From part, mask, docs, good and toxic: one row per part, filter_order and step, zeros included, with all counts.

    A part has at most 2 ** letters rows, so all of a part meets in one task as a table of fixed size.
    """
    spark, counts = found.sparkSession, ("docs", "good", "toxic")
    orders = ["".join(p) for p in permutations(sorted(letters))]
    steps = spark.createDataFrame(intervals(letters), "mask int, step int, begin int, end int")
    found = found.repartition("part")
    ends = lambda sign, at: F.struct(F.col(at).alias("rank"), *((F.col(c) * sign).alias(c) for c in counts))
    changes = found.join(F.broadcast(steps), "mask").select("part", "step", F.explode(F.array(ends(1, "begin"), ends(-1, "end"))).alias("e")).select("part", "step", "e.*")
    has, alone = (lambda k: F.col("mask").bitwiseAND(1 << k) > 0), (lambda k: F.col("mask") == 1 << k)
    count = lambda rule: F.array(*(F.sum(F.when(rule(k), F.col("docs")).otherwise(F.lit(0))) for k in range(len(letters))))
    parts = found.groupBy("part").agg(F.sum("docs").alias("_all"), count(has).alias("_fails"), count(alone).alias("_alone"))
    zeros = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank"), *(F.lit(0).cast("long").alias(c) for c in counts))
    array = changes.unionByName(zeros).repartition("part").groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in counts))
    ranks = Window.partitionBy("part", "step").orderBy("rank")
    run = array.select("part", "step", "rank", *(F.sum(c).over(ranks).alias(c) for c in counts)).where(F.col("rank") < len(orders))
    order = F.element_at(F.array(*map(F.lit, orders)), F.col("rank") + 1)
    named = run.withColumn("filter_order", order).withColumn("_letter", F.instr(F.lit(letters), F.substring(F.col("filter_order"), F.col("step"), F.lit(1))))
    whole = named.join(parts, "part")
    of = lambda c: F.element_at(c, F.col("_letter"))
    return whole.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        (F.col("_all") - F.sum("docs").over(Window.partitionBy("part", "rank").orderBy("step"))).alias("kept"),
        F.col("docs").alias("removed"), (of("_fails") - F.col("docs")).alias("redundant"), of("_alone").alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("docs").over(Window.partitionBy("part", "_letter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """totals of cells. An empty table has no part, so no row. Other columns are ignored; repeated rows count each."""
    return totals(cells(docs, labels))


def oracle() -> str:
    """The same counts by applying each order to every mask."""
    fails = " OR ".join("(f{0} AND substr(o, {1}, 1) = '{2}')".format(x.lower(), "{k}", x) for x in FILTERS)
    first = "CASE " + " ".join(f"WHEN {fails.format(k=k)} THEN {k}" for k in range(1, 6)) + " ELSE 6 END"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 50 AS fa, 100 * len(list_distinct(w)) < 65 * len(w) AS fb,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS fc, regexp_matches(text, '[#$%&*|]') AS fd,
    coalesce(t.doc_id, {LAST}) > min(coalesce(t.doc_id, {LAST})) OVER (PARTITION BY text) AS fe FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (SELECT part, fa, fb, fc, fd, fe, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
gone AS (SELECT part, o, docs, good, toxic, fa, fb, fc, fd, fe, {first} AS went FROM c, orders),
steps AS (SELECT unnest(range(1, 6))::INTEGER AS step),
counted AS (SELECT part, o, step, substr(o, step, 1) AS x, sum(docs) FILTER (went > step) AS kept, sum(docs) FILTER (went = step) AS removed,
    sum(good) FILTER (went = step) AS good_lost, sum(toxic) FILTER (went = step) AS toxic_lost,
    sum(docs) FILTER (went < step AND CASE substr(o, step, 1) WHEN 'A' THEN fa WHEN 'B' THEN fb WHEN 'C' THEN fc WHEN 'D' THEN fd ELSE fe END) AS redundant,
    sum(docs) FILTER (fa::INT + fb::INT + fc::INT + fd::INT + fe::INT = 1 AND CASE substr(o, step, 1) WHEN 'A' THEN fa WHEN 'B' THEN fb WHEN 'C' THEN fc WHEN 'D' THEN fd ELSE fe END) AS unique_fails
  FROM gone, steps GROUP BY part, o, step)
SELECT part, o AS filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, x), 0)::BIGINT AS shapley FROM counted"""
