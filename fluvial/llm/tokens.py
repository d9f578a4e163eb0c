"""Tokenizer access inside tasks: one instance per Python worker, and a word cache for full ids."""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Callable, Iterator
from functools import wraps
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOADED: dict[int, object] = {}
#: Fixed value: Latin letters that no normalisation or lower-casing rule joins with an ASCII neighbour, then
#: ASCII marks without the apostrophe (0x27), which may begin a contraction.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([\x21-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+)?")


def give_back() -> None:
    """The worker's free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """run over batches, after which the worker's free memory goes back to the system: a worker stays small until its next task."""

    @wraps(run)
    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def chunks_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different space-separated chunks of texts, the number of each chunk in order, and how many a text has.

    Null texts have none; an empty chunk, from white space at an end, is left out.
    """
    listed = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = listed.flatten().dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    offsets = listed.offsets.to_numpy()
    offsets = offsets - offsets[0]
    if "" in names:
        filled = codes != names.index("")
        offsets = np.concatenate([[0], np.cumsum(filled)])[offsets]
        codes = codes[filled]
    return names, codes, np.diff(offsets)


def runs_of(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most_bytes of text, one row at least."""
    ends, a = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most_bytes, "right")))
        yield a, b
        a = b


def read_tokenizer(path: str) -> str:
    """Text of a tokenizer file, read on the driver; its size is that of the vocabulary, not of the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def load(text: str):
    """The library's tokenizer for this file, without truncation or padding, kept for the life of the worker."""
    key = hash(text)
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(text)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _LOADED[key] = tokenizer
    return _LOADED[key]


class WordEncoder:
    """Ids of whole texts, equal to the library's, for a word-level BPE that drops white space.

    White space always separates pre-tokens of such a tokenizer, so a text's ids are those of its
    space-separated chunks one after another. Each different chunk is encoded once and kept: letters as one
    text, cut where the word-end tokens are, letters with marks after them as two parts, the rest one by one.
    The first `most` chunks stay, frequent ones among them, and later ones are dropped after
    their call, which bounds a worker's memory.
    """

    pattern, units_of = _PLAIN, staticmethod(chunks_of)

    def __init__(self, text: str, most: int = 200_000):
        self.tokenizer = load(text)
        found = re.search(r'"end_of_word_suffix"\s*:\s*"([^"]*)"', text)
        suffix = found[1] if found else ""
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.plain = bool(suffix)
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.start, self.counts = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def _keep(self, chunks: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        base, upto = len(self.codes), len(self.codes) + len(chunks)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while upto > len(self.start):
            self.start, self.counts = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.counts))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[base:upto] = self.used + np.cumsum(counts) - counts
        self.counts[base:upto] = counts
        self.used += len(ids)
        self.codes.update(zip(chunks, range(base, upto)))

    def _learn_each(self, chunks: list[str]) -> None:
        for a in range(0, len(chunks), 1000):
            part = chunks[a : a + 1000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._keep(part, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64))

    def _learn_letters(self, stems: list[str]) -> None:
        """Letter-only chunks, each one pre-token: encoded as one text and cut where words end."""
        rest = []
        for a in range(0, len(stems), 2000):
            part = stems[a : a + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(part) and at[-1] == len(ids):
                self._keep(part, ids, np.diff(at, prepend=0))
            else:
                rest += part
        self._learn_each(rest)

    def _learn(self, missing: list[str]) -> list[str]:
        """Learn chunks; returns these and the parts of them that were learnt on the way."""
        match, codes = self.pattern.fullmatch, self.codes
        found = [match(c) for c in missing] if self.plain else [None] * len(missing)
        both = [(c, m[1], m[2]) for c, m in zip(missing, found) if m and m[2]]
        stems = list(dict.fromkeys([c for c, m in zip(missing, found) if m and not m[2]] + [s for _, s, _ in both if s not in codes]))
        others = list(dict.fromkeys([c for c, m in zip(missing, found) if not m] + [t for _, _, t in both if t not in codes]))
        self._learn_letters(stems)
        self._learn_each(others)
        chunks = [c for c, _, _ in both]
        if chunks:
            parts = np.fromiter((codes[x] for _, s, t in both for x in (s, t)), np.int64, 2 * len(both))
            self._keep(chunks, *self._ids(parts, 2))
        return stems + others + chunks

    def _ids(self, codes: np.ndarray, each: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Ids of codes one after another, and how many every `each` of them have."""
        counts = self.counts[codes]
        ends = np.cumsum(counts)
        at = np.repeat(self.start[codes] - ends + counts, counts)
        at += np.arange(len(at))
        return self.flat[at], counts.reshape(-1, each).sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of texts one after another, and each text's number of ids."""
        codes, sizes, forget = self._coded(texts)
        ids, counts = self._ids(codes)
        upto = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        forget()
        return ids, np.diff(upto)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Each text's number of ids, without the ids."""
        codes, sizes, forget = self._coded(texts)
        upto = np.concatenate([[0], np.cumsum(self.counts[codes])])[np.concatenate([[0], np.cumsum(sizes)])]
        forget()
        return np.diff(upto)

    def _coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Callable[[], None]]:
        """Numbers of the texts' chunks in order, chunks a text has, and what drops chunks that aren't kept."""
        full, used = len(self.codes) >= self.most or self.used >= 20 * self.most, self.used
        names, codes, sizes = self.units_of(texts)
        known = list(map(self.codes.get, names))
        new = [k for k, c in enumerate(known) if c is None]
        learnt = self._learn([names[k] for k in new]) if new else []
        for k in new:
            known[k] = self.codes[names[k]]
        codes = np.array(known, np.int64)[codes] if len(codes) else np.zeros(0, np.int64)

        def forget() -> None:
            if full:  # chunks met by now are mostly rare: these aren't kept
                for c in learnt:
                    del self.codes[c]
                self.used = used

        return codes, sizes, forget


#: Fixed value: as _PLAIN, with the one space that a byte-level token may begin with.
_SPACED = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([\x21-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+)?")


class ByteEncoder(WordEncoder):
    """Ids of whole texts, equal to the library's, for a byte-level BPE whose tokens begin with at most one space.

    Such a tokenizer always begins a new pre-token at a single space between two characters that aren't white
    space, so a text's ids are those of its units, cut before each such space, one after another. Units are
    learnt once and kept as in WordEncoder. Pieces beside other white space stay one unit with their neighbours.
    """

    pattern = _SPACED

    def __init__(self, text: str, most: int = 800_000):
        super().__init__(text, most)
        self.begins = np.zeros(len(self.ends), bool)
        self.begins[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.startswith("Ġ")]] = True
        self.plain = True

    def _learn_letters(self, stems: list[str]) -> None:
        """ASCII letters stand for themselves among the vocabulary's characters, so the model takes them as they are."""
        own = [s.replace(" ", "Ġ") for s in stems if s.isascii()]
        found = [[t.id for t in tokens] for tokens in map(self.tokenizer.model.tokenize, own)]
        self._keep([s for s in stems if s.isascii()], np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        self._learn_each([s for s in stems if not s.isascii()])

    def _learn_each(self, chunks: list[str]) -> None:
        """Chunks with a space in front alone go to the library as one text, cut where tokens begin with a space."""
        joined, rest = [c for c in chunks if c.rfind(" ") == 0 and not c[-1].isspace()], []
        for a in range(0, len(joined), 1000):
            part = joined[a : a + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(part) and at[0] == 0:
                self._keep(part, ids, np.diff(at, append=len(ids)))
            else:
                rest += part
        alone = {*joined}
        super()._learn_each(rest + [c for c in chunks if c not in alone])

    def units_of(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Different units of texts, the number of each unit in order, and how many a text has."""
        listed = pc.split_pattern(texts.fill_null(""), " ")
        coded = listed.flatten().dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy()
        ends = listed.offsets.to_numpy()[1:] - listed.offsets[0].as_py()
        first = np.zeros(len(codes), bool)
        first[np.concatenate([[0], ends[:-1]])[: len(ends)]] = True
        # pieces that may follow a cut, and that a cut may follow
        filled = pc.not_equal(names, "")
        head, tail = (pc.and_(filled, pc.equal(trim(names), names)).to_numpy(zero_copy_only=False) for trim in (pc.utf8_ltrim_whitespace, pc.utf8_rtrim_whitespace))
        starts = first.copy()
        starts[1:] |= tail[codes[:-1]] & head[codes[1:]]
        at = np.flatnonzero(starts)
        size = np.diff(at, append=len(codes))
        # a unit of one piece is its name, with a space unless it begins its text
        key = np.where(first[at], codes[at].astype(np.int64) + len(names), codes[at])
        used = np.zeros(2 * len(names), bool)
        several = np.flatnonzero(size > 1)
        used[key[size == 1]] = True
        number = np.cumsum(used) - 1
        bare = names.filter(pa.array(used[len(names) :]))
        found = pc.binary_join_element_wise("", names.filter(pa.array(used[: len(names)])), " ").to_pylist() + bare.to_pylist()
        unit = number[key]
        if len(several):
            numbers = dict(zip(found, range(len(found))))
            for u, a, n in zip(several.tolist(), at[several].tolist(), size[several].tolist()):
                text = ("" if first[a] else " ") + " ".join(names.take(pa.array(codes[a : a + n])).to_pylist())
                unit[u] = numbers.setdefault(text, len(numbers))
            found = list(numbers)
        return found, unit, np.diff(np.searchsorted(at, ends), prepend=0)

_ENCODERS: dict[tuple, WordEncoder] = {}


def word_encoder(text: str, kind: type[WordEncoder] = WordEncoder) -> WordEncoder:
    key = kind, hash(text)
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(text)
    return _ENCODERS[key]


def safe_pieces(text: str, most_bytes: int) -> list[str]:
    """Cut text after white space, where no token crosses, into pieces of about most_bytes bytes of UTF-8.

    A run without white space is never cut, so it may make a longer piece.
    """
    raw = text.encode("utf-8")
    if len(raw) <= most_bytes:
        return [text]
    cuts, last = [], 0
    for m in re.finditer(rb"[\x20\x09-\x0D]+", raw):
        if m.end() - last >= most_bytes:
            cuts.append(raw[last : m.end()].decode("utf-8"))
            last = m.end()
    if last < len(raw):
        cuts.append(raw[last:].decode("utf-8"))
    return cuts
