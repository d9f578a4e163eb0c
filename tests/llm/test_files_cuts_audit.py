"""Re-Pair files, fill-in-the-middle and the filter audit against plain versions of themselves."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from fluvial.llm import fill_middle, filter_audit, grammar, queries
from fluvial.llm.tokens import ByteEncoder, load, read_tokenizer

BYTES = queries.tokenizer_path(queries.BYTE_BPE)
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    return load(read_tokenizer(BYTES))


@pytest.mark.parametrize("most", [1, 50, 200_000])
def test_byte_encoder_equals_the_library(library, most):
    draw = random.Random(most)
    parts = [" ", "  ", "\n", "\t", "a", "word", "é", "'s", "'", "漢", " ", "<|endoftext|>", ".", ",", "12", "Ünï", "\x1c", "\x85", "　", "\r\n", "don't", "I'LL", "😀", " the", " of", "the"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(3000)] + ["", None, " ", "  ", " the the"]
    encoder, found = ByteEncoder(read_tokenizer(BYTES), most), []
    for a in range(0, len(texts), 700):
        ids, counts = encoder.encode(pa.array(texts[a : a + 700]))
        found += np.split(ids, np.cumsum(counts)[:-1])
    assert [f.tolist() for f in found] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def opened(ids, **options):
    symbols, rules, lengths = grammar.compress(np.array(ids, np.int64), 1000, **options)
    return symbols, rules, grammar.Shard(1000, *(x.astype("<u4").tobytes() for x in (rules, lengths, symbols)))


@pytest.mark.parametrize("ids", [[], [5], [7] * 1001, [1, 2, 3] * 400, [1, 1, 2] * 300 + [1], np.random.default_rng(1).integers(0, 4, 3000).tolist(), list(range(999))])
def test_grammar_is_a_round_trip_at_any_place(ids):
    symbols, rules, shard = opened(ids, least=2)
    assert shard.read().tolist() == ids
    assert all(a < 1000 + k and b < 1000 + k for k, (a, b) in enumerate(rules.tolist()))
    draw = random.Random(2)
    for _ in range(50):
        a, b = sorted(draw.choices(range(len(ids) + 1), k=2))
        assert shard.read(a, b).tolist() == ids[a:b]


def test_frequent_pairs_become_rules():
    symbols, rules, _ = opened([1, 2, 3, 4] * 500)
    assert len(symbols) < 20 and [1, 2] in rules.tolist()
    # a rule is made only for pairs that occur often enough
    assert len(opened([1, 2, 3, 4] * 7, least=16)[1]) == 0


def test_checksum_of_parts():
    a, b, c = b"first", b"x" * 1000, b""
    assert grammar.shifted(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)
    assert grammar.shifted(zlib.crc32(a), len(c)) ^ zlib.crc32(c) == zlib.crc32(a)


@pytest.mark.parametrize("shard_ids", [5, 997, 1 << 20])
def test_files_hold_every_document(spark, docs, library, tmp_path, shard_ids):
    grammar.write_ids(docs, f"{tmp_path}/ids", BYTES, shard_ids=shard_ids)
    sizes = [r.ids for r in spark.read.parquet(f"{tmp_path}/ids").collect()]
    assert max(sizes) <= shard_ids
    want = []
    for r in docs.collect():
        raw = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, len(raw), zlib.crc32(raw.tobytes())))
    found = sorted(grammar.read_documents(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.start)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=str) == sorted(want, key=str)
    known = [r.doc_id for r in found]
    assert known == sorted(known, key=lambda i: (i is None, i or 0))
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]


def test_files_of_a_text_of_megabytes(spark, library, tmp_path):
    draw = random.Random(3)
    text = " ".join("".join(draw.choices("abcdeé\n", k=draw.randint(1, 9))) for _ in range(600_000))
    assert len(text) > 3_000_000
    grammar.write_ids(spark.createDataFrame([(1, text), (2, "x" * 200_000)], "doc_id long, text string"), f"{tmp_path}/ids", BYTES)
    found = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in grammar.read_documents(spark, f"{tmp_path}/ids").collect()}
    raw = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
    assert found[1] == (len(raw), zlib.crc32(raw.tobytes()))


def test_tasks_on_files_give_their_memory_back(library, monkeypatch):
    gave = []
    monkeypatch.setattr(grammar, "give_back", lambda: gave.append(1), raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["the cat", None])], names=["doc_id", "text"])
    shards = list(grammar._shards(iter([batch]), 0, read_tokenizer(BYTES), 0, 1 << 19, 1 << 20, 16))
    assert len(shards) == 1 and gave == [1]
    named = shards[0].append_column("before", pa.array([0]))
    assert [r["n_tokens"] for r in pa.Table.from_batches(grammar._pieces(iter([named]))).to_pylist()] == [3, 1] and gave == [1, 1]


def test_files_of_an_empty_table(empty):
    assert grammar.stored_documents(empty, BYTES).collect() == []


def plain_cut(doc_id, text, seed=42):
    text = text or ""
    units = TOKEN.findall(text)
    n, h = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


AWKWARD = ["", " ", "\t\n", "a", " a", "a ", "é 漢字  x　y ", "has <P> in it", "x" * 700 + " y" * 900 + " " + "z" * 5000 + " end", None]


@pytest.mark.parametrize("within, batch_bytes", [(0, 1 << 20), (3, 100), (127, 1 << 20)])
def test_cuts_equal_plain_ones(spark, docs, within, batch_bytes):
    more = spark.createDataFrame([(k, AWKWARD[k % len(AWKWARD)]) for k in range(300)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(more)
    want = sorted(((r.doc_id, *plain_cut(r.doc_id, r.text)) for r in rows.collect()), key=str)
    found = fill_middle.transform(rows, within=within, batch_bytes=batch_bytes).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=str) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    for r in fill_middle.transform(rows, within=within, digests=True).collect():
        assert len(r.output_sha256) == len(r.restored_sha256) == 64


@pytest.mark.parametrize("within", [0, 2, 127])
def test_index_gives_every_boundary(spark, docs, within):
    rows = {(r.doc_id, r.text): r for r in docs.select("doc_id", "text").collect()}
    found = fill_middle.index(docs.dropDuplicates(["doc_id", "text"]), within).collect()
    assert len(found) == len(rows)
    offsets_of = {}
    for i, text in rows:
        ends = [0, *(m.end() for m in TOKEN.finditer(text or ""))]
        offsets_of.setdefault(i, []).append(ends)
    for r in found:
        residuals, at = np.frombuffer(r.residuals, np.int8), []
        assert np.abs(residuals.astype(int)).max() <= within and len(residuals) == r.n + 1
        for k in range(r.n + 1):
            s = np.searchsorted(r.firsts, k, "right") - 1
            at.append(int(fill_middle.predicted(np.array(k), r.firsts[s], r.offsets[s], r.slopes[s])) + int(residuals[k]))
        assert at in offsets_of[r.doc_id]
    with pytest.raises(ValueError):
        fill_middle.index(docs, 128)


def test_index_is_small_where_tokens_are_even(spark):
    text = " ".join(["word"] * 5000)
    r = fill_middle.index(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(r.firsts) == 1


def test_cuts_of_an_empty_table(empty):
    assert fill_middle.transform(empty).collect() == [] and fill_middle.index(empty).collect() == []


def test_intervals_cover_each_order_once():
    orders = ["".join(p) for p in permutations("ABCDE")]
    covered = {}
    for mask, step, begin, end in filter_audit.intervals():
        for rank in range(begin, end):
            assert (mask, rank) not in covered
            covered[mask, rank] = step
    for mask in range(1, 32):
        for rank, order in enumerate(orders):
            assert covered[mask, rank] == next(k for k, x in enumerate(order, 1) if mask >> "ABCDE".index(x) & 1)


def plain_audit(docs, labels):
    good, toxic = ({r.doc_id for r in labels if r.doc_id is not None and r[c] == 1} for c in ("quality", "toxic"))
    least = {}
    for r in docs:
        i = 2**63 - 1 if r.doc_id is None else r.doc_id
        least[r.text or ""] = min(i, least.get(r.text or "", i))
    rows = []
    for r in docs:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {x for x, bad in zip("ABCDE", (len(words) < 50, 100 * len({*words}) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), (2**63 - 1 if r.doc_id is None else r.doc_id) > least[text])) if bad}
        rows.append((r.source or "", fails, r.doc_id in good, r.doc_id in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley, made = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone, stay = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                made.append((part, order, step, len(stay), len(gone), sum(x in r[1] for r in own) - len(gone), sum(r[1] == {x} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
                shapley[x] += len(gone)
                left = stay
        out += [(*m, shapley[m[1][m[2] - 1]]) for m in made]
    return out


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_applying_each_order(spark, docs, labels):
    draw = random.Random(5)
    pool = ["".join(draw.choices("abc ABC#\n", k=draw.randint(0, 30))) for _ in range(12)] + [" ".join(f"w{draw.randint(0, most)}" for _ in range(80)) + end for most in (5, 500) for end in ("", " |", " " + "X" * 90)] + [None, ""]
    more = spark.createDataFrame([(draw.choice([None, *range(100, 160)]), draw.choice(pool), draw.choice([None, "", "a", "b"])) for _ in range(250)], "doc_id long, text string, source string")
    rows = docs.select("doc_id", "text", "source").union(more)
    marks = labels.union(spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(100, 150)] + [(101, 0, 1), (102, 1, None)], labels.schema))
    found = filter_audit.audit(rows, marks).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found) == sorted(plain_audit(rows.collect(), marks.collect()))


def test_audit_of_awkward_columns(docs, empty, labels):
    assert filter_audit.audit(docs, labels).count() == 600 * docs.fillna({"source": ""}).select("source").distinct().count()
    assert filter_audit.audit(docs, labels.where("false")).where("good_lost + toxic_lost > 0").isEmpty()
    assert filter_audit.audit(empty, labels).collect() == []


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_filter_audit"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = queries.queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()))
