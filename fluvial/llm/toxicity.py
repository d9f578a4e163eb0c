"""Toxicity: a word classifier whose score must not follow which group a sentence names."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.llm.common import crc_bucket, cut
from fluvial.llm.tokens import give_back

#: Terms that name groups; those of a line can stand for each other.
IDENTITY_GROUPS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("german", "french", "spanish", "english", "mexican", "chinese", "turkish"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("deaf", "blind", "disabled"),
    ("young", "elderly"),
)
_WORD = re.compile(r"[^\W\d_]+")


def feature_words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall(text.lower())


def swapped(text: str, groups=IDENTITY_GROUPS) -> list[list[str]]:
    """Words of the whole text after one of its identity terms gave way to the next of its group, in every sentence that has it.

    One list for each different term, so there are at most as many as groups have terms, however long the text.
    Terms change one at a time, so that the scores of two can't make up for each other.
    """
    after = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    words = feature_words(text)
    return [[after[w] if w == t else w for w in words] for t in dict.fromkeys(w for w in words if w in after)]


#: Lengths of the beginnings of words that count as features, and the grades a count can reach.
PREFIXES, GRADES = range(4, 9), 4
_GRADE = 0x9E3779B97F4A7C15


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    return [xxhash.xxh64_intdigest(f"={word}")] + [xxhash.xxh64_intdigest(f"{word[:n]}*") for n in PREFIXES if n <= len(word)]


def graded(counts: dict[int, int], words: int) -> list[int]:
    """Features of a text: those counted once, twice, three times, and in one of a hundred words."""
    found = []
    for h, c in counts.items():
        found.append(h)
        found += [(h + g * _GRADE) & (2**64 - 1) for g in (1, 2) if c > g]
        if 100 * c >= words:
            found.append((h + 3 * _GRADE) & (2**64 - 1))
    return found


class ToxicityModel:
    """Logistic regression over hashed features of words."""

    def __init__(self, weights: dict[int, float] | None = None, bias: float = 0.0):
        self.weights, self.bias = weights or {}, bias
        self.bases = {(h - g * _GRADE) & (2**64 - 1) for h in self.weights for g in range(GRADES)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def score(self, text: str | None) -> float:
        words = feature_words(text if isinstance(text, str) else "")  # pandas may say NaN for null
        if len(self.known) > 100_000:  # bounds a worker's memory
            self.known = {}
        known, counts = self.known, Counter()
        for w in words:
            f = known.get(w)
            if f is None:
                f = known[w] = tuple(h for h in word_features(w) if h in self.bases)
            if f:
                counts.update(f)
        z = self.bias + sum(sorted(self.weights.get(h, 0.0) for h in graded(counts, len(words))))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def column(self, text: Column) -> Column:
        """score of a text column; a null text counts as empty."""
        model = self  # a few thousand weights: what `most` labelled rows can support

        @F.pandas_udf("double")
        def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for t in texts:
                yield t.map(model.score, na_action=None).astype("float64")
            model.known = {}

        return score(text)


def _examples(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, groups) -> DataFrame:
    """At most `most` labelled documents as hashed features, their swapped forms, and marks of their word pairs, saved."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("_label"))
        .where(crc_bucket(F.col("_id"), folds) != held)
    )
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")  # `most` rows at most

    def signed(hashes):
        return np.sort(np.array(hashes, np.uint64)).view(np.int64)

    def run(batches):
        for batch in batches:
            rows = []
            for i, text, y in zip(*(batch.column(c).to_pylist() for c in ("_id", "_text", "_label"))):
                words = feature_words(text)
                known: dict[str, list[int]] = {}

                def features(listed):
                    counts = Counter()
                    for w, c in Counter(listed).items():
                        if w not in known:
                            known[w] = word_features(w)
                        for h in known[w]:
                            counts[h] += c
                    return graded(counts, len(listed))

                pairs = [xxhash.xxh64_intdigest(f"{a} {b}") for a, b in zip(words, words[1:])] or [xxhash.xxh64_intdigest(text)]
                marks = [int(((np.array(pairs, np.uint64) * np.uint64(m)) >> np.uint64(1)).min()) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
                rows.append((i, y, False, signed(features(words)), marks))
                rows += [(i, y, True, signed(features(s)), marks) for s in swapped(text, groups)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["id", "label", "swap", "features", "marks"])

    found = texts.mapInArrow(run, "id long, label int, swap boolean, features array<long>, marks array<long>")
    return cut(found.withColumn("row", F.monotonically_increasing_id()))


def _told(examples: DataFrame, rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features that at least 3 of the chosen rows have, as many as have them, and as many of label 1; Spark counts them."""
    spark = examples.sparkSession
    chosen = spark.createDataFrame(pa.table({"row": pa.array(rows, pa.int64()), "_y": pa.array(y, pa.int64())}))
    each = examples.join(F.broadcast(chosen), "row").select("_y", F.explode("features").alias("feature"))  # `most` rows at most
    found = each.groupBy("feature").agg(F.count("*").alias("n"), F.sum("_y").alias("n1")).where("n >= 3").toArrow()
    names = found["feature"].to_numpy().view(np.uint64)
    order = np.argsort(names)
    return names[order], found["n"].to_numpy()[order], found["n1"].to_numpy()[order]


def _used(examples: DataFrame, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order, where the features of each begin and end, and the features by their number in names; others stay in the tasks."""

    def run(batches):
        for batch in batches:
            listed = batch.column(1)
            ends, flat = listed.offsets.to_numpy(), listed.values.to_numpy().view(np.uint64)
            at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
            keep = names[at] == flat
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(at[keep][ends[0] : ends[-1]], pa.int32()))], names=["row", "used"])

    found = examples.select("row", "features").mapInArrow(run, "row long, used array<int>").sort("row").toArrow()
    listed = found["used"].combine_chunks()
    return found["row"].to_numpy(), listed.offsets.to_numpy(), listed.values.to_numpy()


def _originals(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of different documents, in order of id; and for each swapped form its row and that of its document.

    A document that shares two of the four marks of an earlier one is a near copy of it and is left out, so
    that a copied text's own words don't look like evidence.
    """
    ids, swap, marks = table["id"].to_numpy(), table["swap"].to_numpy(zero_copy_only=False), table["marks"].to_pylist()
    order = np.lexsort((np.arange(len(ids)), swap, ids))
    seen: dict[tuple[int, int], int] = {}
    row_of: dict[int, int] = {}
    kept = []
    for r in order:
        if swap[r] or int(ids[r]) in row_of:
            continue
        earlier = [seen[k] for k in enumerate(marks[r]) if k in seen]
        if len(earlier) < 2:
            kept.append(r)
            row_of[int(ids[r])] = r
        for k in enumerate(marks[r]):
            seen.setdefault(k, r)
    pairs = [(r, row_of[int(ids[r])]) for r in order if swap[r] and int(ids[r]) in row_of]
    return np.array(kept, int), np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, most: int = 6_000, l2: float = 2e-4, swap_penalty: float = 1.0, steps: int = 500, groups=IDENTITY_GROUPS) -> ToxicityModel:
    """Learn from at most `most` labelled documents whose fold isn't `held`; texts alone are inputs.

    The sample is bounded because the driver fits it; it is chosen by hash of doc_id. Tasks keep its features:
    the driver gets counts of those in 3 documents or more, then entries of those used alone. Of several labels of a
    document the greatest counts. A word, a beginning of words, or a grade of its count is used if at
    least 3 documents have it and its share of label 1 differs from the whole by more than chance over all
    (documents * divergence > log of their number), and so are identity terms. The loss is the mean log loss, l2 / 2 * |w|^2, and swap_penalty times the mean square
    of the change in log-odds when an identity term of the sentences is swapped. Without labels, or with only
    one, the score is the smoothed share of label 1 for every text.
    """
    examples = _examples(docs, labels, label, folds, held, most, groups)
    table = examples.select("row", "id", "label", "swap", F.when(~F.col("swap"), F.col("marks")).alias("marks")).sort("row").toArrow()
    rows, swaps, origins = _originals(table)
    number = table["row"].to_numpy()
    y = table["label"].to_numpy()[rows].astype(float) if len(rows) else np.zeros(0)
    prior = (y.sum() + 1) / (len(y) + 2)
    prior_model = ToxicityModel({}, float(np.log(prior / (1 - prior))))
    if len(np.unique(y)) < 2:
        return prior_model
    names, n, n1 = _told(examples, number[rows], y)
    share, base = n1 / n, y.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        divergence = np.nan_to_num(share * np.log(share / base)) + np.nan_to_num((1 - share) * np.log((1 - share) / (1 - base)))
    terms = np.array([word_features(t)[0] for g in groups for t in g], np.uint64)
    names = names[(n * divergence > np.log(max(2, len(names)))) | np.isin(names, terms)]
    size = len(names)
    if not size:
        return prior_model
    held_rows, ends, used = _used(examples, names)

    def sparse(chosen):
        """Row among the chosen and number of each feature used."""
        place = np.searchsorted(held_rows, number[chosen])
        sizes = (ends[place + 1] - ends[place]).astype(np.int64)
        at = np.repeat(ends[place] - np.cumsum(sizes) + sizes, sizes)
        return np.repeat(np.arange(len(chosen), dtype=np.int32), sizes), used[at + np.arange(len(at))]

    (xr, xc), (sr, sc), (or_, oc) = sparse(rows), sparse(swaps), sparse(origins)
    w, b = np.zeros(size), float(np.log(base / (1 - base)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(xr, w[xc], minlength=len(rows)) + b, -40, 40)))
        error = (p - y) / len(rows)
        grad = np.append(np.bincount(xc, error[xr], minlength=size) + l2 * w, error.sum())
        if len(swaps):
            change = (np.bincount(sr, w[sc], minlength=len(swaps)) - np.bincount(or_, w[oc], minlength=len(swaps))) * (2 * swap_penalty / len(swaps))
            grad[:-1] += np.bincount(sc, change[sr], minlength=size) - np.bincount(oc, change[or_], minlength=size)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.1 * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    give_back()
    return ToxicityModel(dict(zip(names.tolist(), w.tolist())), float(b))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted (1 from threshold on).

    A null or empty text has the score of no words. Repeated rows give repeated results; a null doc_id stays
    null; an empty table gives no rows; other columns are ignored.
    """
    model = fit(docs, labels, **options)
    folds, held = options.get("folds", 3), options.get("held", 1)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), model.column(F.col("text")).alias("score"))
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The documents, with all their columns, whose score stays below threshold.

    A null or empty text has the score of no words; repeated rows share one fate, null ids too; an empty table
    stays empty; columns of any other name stay as they are.
    """
    model = fit(docs, labels, **options)
    return docs.where(model.column(F.col("text")) < threshold)
