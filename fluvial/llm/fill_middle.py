"""Fill-in-the-middle texts, cut by a learned index over the offsets where tokens end.

A document's index is a piecewise-linear map from the number of a boundary to its offset in code points: line
segments within a stated error of every boundary, and a stored residual for each that makes a prediction exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.llm.tokens import runs_of

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Error bound of a segment, in code points; residuals then fit one byte.
WITHIN = 127
INDEX = "doc_id long, n long, firsts array<int>, offsets array<long>, slopes array<double>, residuals binary"
CUTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, segments int, output string"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, segments int, output_sha256 string, restored_sha256 string"


def boundaries(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in code points where tokens of texts end, each text's 0 included, and how many a text has.

    raw: the texts' UTF-8 bytes one after another; ends: where each text ends. A token is a run without white
    space and what white space stands before it, or the white space at a text's end.
    """
    n = len(raw)
    space = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    last = np.zeros(n, bool)
    last[ends[np.diff(ends, prepend=0) > 0] - 1] = True
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    at = np.flatnonzero((~space & after) | last) + 1  # a boundary lies after this byte
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    begins = np.concatenate([[0], ends[:-1]])
    count = np.searchsorted(at, ends, "right") - np.searchsorted(at, begins, "right")
    owner = np.repeat(np.arange(len(ends)), count)
    return np.insert(points[at] - points[begins[owner]], np.cumsum(count) - count, 0), count + 1


def predicted(k: np.ndarray, first: np.ndarray, offset: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Offset of boundary k by the segment that begins at boundary first; the one formula for fitting and looking up."""
    return offset + np.rint((k - first) * slope).astype(np.int64)


def fit(offsets: np.ndarray, counts: np.ndarray, within: int = WITHIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of every text's boundaries: their text, first boundary, offset and slope; and all residuals.

    A segment joins its first and last boundary by a line. One that misses a boundary by more than `within`
    is halved, so rounds grow with the logarithm of a text's boundaries; two boundaries are always met.
    """
    begin = np.cumsum(counts) - counts
    owner, first, size = np.arange(len(counts)), np.zeros(len(counts), np.int64), counts.astype(np.int64)
    done, residuals = [], np.empty(len(offsets), np.int64)
    while len(owner):
        a = begin[owner] + first
        start, slope = offsets[a], (offsets[a + size - 1] - offsets[a]) / np.maximum(size - 1, 1)
        place = np.cumsum(size) - size
        inner = np.arange(int(size.sum())) - np.repeat(place, size)
        at = np.repeat(a, size) + inner
        miss = offsets[at] - predicted(inner, 0, np.repeat(start, size), np.repeat(slope, size))
        good = np.maximum.reduceat(np.abs(miss), place) <= within
        kept = np.repeat(good, size)
        residuals[at[kept]] = miss[kept]
        done.append((owner[good], first[good], start[good], slope[good]))
        half = size[~good] // 2
        owner, first, size = np.repeat(owner[~good], 2), np.stack([first[~good], first[~good] + half], 1).ravel(), np.stack([half, size[~good] - half], 1).ravel()
    own, first, start, slope = (np.concatenate(x) for x in zip(*done)) if done else (np.empty(0, np.int64),) * 4
    order = np.lexsort((first, own))
    return own[order], first[order], start[order], slope[order], residuals


def looked_up(k: np.ndarray, text: np.ndarray, counts: np.ndarray, own: np.ndarray, first: np.ndarray, start: np.ndarray, slope: np.ndarray, residuals: np.ndarray) -> np.ndarray:
    """Exact offset of boundary k of each text: the line of its segment, then the stored residual."""
    begin = np.cumsum(counts) - counts
    # segments in one order: by text, then by first boundary
    segment = np.searchsorted(begin[own] + first, begin[text] + k, "right") - 1
    return predicted(k, first[segment], start[segment], slope[segment]) + residuals[begin[text] + k]


def choice(doc_id: int | None, n: int, seed: int, rate: int, spm_rate: int) -> tuple[int, int, bool, bool]:
    """Units before the middle and before the suffix, and whether the text is cut, suffix first, by the id's hash."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return a, b, h3 % 100 < rate, h4 % 100 < spm_rate


def rebuilt(output: str, form: str) -> str:
    """The text that an output of this form was made from."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    prefix, _, suffix = head.removeprefix(PREFIX).partition(SUFFIX)
    if form == "spm":
        suffix, _, prefix = head.removeprefix(SUFFIX).partition(PREFIX)
    return prefix + middle + suffix


def _runs(batches, batch_bytes: int):
    """Ids, texts, boundary offsets and counts of runs of rows of about batch_bytes of text."""
    for batch in batches:
        for a, b in runs_of(batch.column(1), batch_bytes):
            texts = batch.column(1).slice(a, b - a).fill_null("")
            raw = pa.concat_arrays([texts]).cast(pa.large_binary())
            ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]] if raw.buffers()[2] else np.empty(0, np.uint8)
            yield batch.column(0).slice(a, b - a), texts, *boundaries(data, ends[1:] - ends[0])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def index(docs: DataFrame, within: int = WITHIN, batch_bytes: int = 4 << 20) -> DataFrame:
    """The index of every document: number of tokens, and its segments and residuals (signed bytes), to be stored beside it.

    Null and empty texts have the one boundary 0. Repeated rows give repeated results; other columns are ignored.
    """
    if not 0 <= within <= WITHIN:
        raise ValueError(f"within must be from 0 to {WITHIN}")

    def run(batches):
        for ids, _, offsets, counts in _runs(batches, batch_bytes):
            own, first, start, slope, residuals = fit(offsets, counts, within)
            lists = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(counts)))]).astype(np.int32)
            bytes_at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bytes_at), pa.py_buffer(residuals.astype(np.int8).tobytes())])
            arrays = (pa.ListArray.from_arrays(pa.array(lists), pa.array(x)) for x in (first.astype(np.int32), start, slope))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts - 1), *arrays, blob], names=["doc_id", "n", "firsts", "offsets", "slopes", "residuals"])

    return _rows(docs).mapInArrow(run, INDEX)


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, within: int = WITHIN, batch_bytes: int = 4 << 20, digests: bool = False) -> DataFrame:
    """Every document's text in its training form: plain, psm or spm, cut at two tokens' ends found by its index.

    rate: percent of texts that are cut; spm_rate: percent of these with the suffix first. Empty and null
    texts, and those that hold a mark, stay plain. Cuts depend on doc_id and the number of tokens alone, so
    repeated rows agree; a null id hashes as no digits. With digests, output is given as its SHA-256 with that
    of the text rebuilt from it, and texts aren't returned. Nothing is shuffled; other columns are ignored.
    """

    def run(batches):
        for ids, texts, offsets, counts in _runs(batches, batch_bytes):
            fitted = fit(offsets, counts, within)
            segments = np.bincount(fitted[0], minlength=len(counts))
            chosen = [choice(i, n - 1, seed, rate, spm_rate) for i, n in zip(ids.to_pylist(), counts.tolist())]
            a, b = np.array([c[:2] for c in chosen], np.int64).reshape(-1, 2).T
            which = np.arange(len(counts))
            left, right = (looked_up(k, which, counts, *fitted).tolist() for k in (a, b))
            forms, prefixes, middles, outputs, restored = [], [], [], [], []
            for text, (*_, cut, suffix_first), p, q in zip(texts.to_pylist(), chosen, left, right):
                if not text or not cut or PREFIX in text or SUFFIX in text or MIDDLE in text:
                    form, output = "plain", text
                elif suffix_first:
                    form, output = "spm", f"{SUFFIX}{text[q:]}{PREFIX}{text[:p]}{MIDDLE}{text[p:q]}"
                else:
                    form, output = "psm", f"{PREFIX}{text[:p]}{SUFFIX}{text[q:]}{MIDDLE}{text[p:q]}"
                forms.append(form)
                prefixes.append(None if form == "plain" else p)
                middles.append(None if form == "plain" else q - p)
                outputs.append(hashlib.sha256(output.encode()).hexdigest() if digests else output)
                if digests:
                    restored.append(hashlib.sha256(rebuilt(output, form).encode()).hexdigest())
            columns = [pa.array(counts - 1), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(segments.astype(np.int32)), pa.array(outputs, pa.string())]
            columns += [pa.array(restored, pa.string())] if digests else []
            yield pa.RecordBatch.from_arrays([ids, *columns], names=[f.split()[0] for f in (DIGESTS if digests else CUTS).split(", ")])

    return _rows(docs).mapInArrow(run, DIGESTS if digests else CUTS)


def oracle(seed: int = 42) -> str:
    """The query's rows; the number of segments, which SQL can't say, is left out there."""
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
u AS (SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
v AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM w"""
