"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from fluvial.llm import curriculum, fingerprint, jaccard_join, licenses, media, packing, sharding, suffix_tree, token_counts, toxicity
from fluvial.llm.queries import tokenizer_path

TREE = sharding.even_tree(8)
OPERATORS = {
    1: lambda d, x: fingerprint.fingerprint_edits(d),
    2: lambda d, x: suffix_tree.score(d),
    3: lambda d, x: packing.pack_documents(d, tokenizer_path()),
    4: lambda d, x: toxicity.score_documents(d, x),
    5: lambda d, x: curriculum.assign(d),
    7: lambda d, x: sharding.assign_shards(d, TREE, sharding.grown(TREE)),
    8: lambda d, x: jaccard_join.linked_components(d),
    9: lambda d, x: token_counts.count_tokens(d, tokenizer_path()),
    10: lambda d, x: media.payload_features(d),
}


@pytest.mark.parametrize("n", OPERATORS)
def test_awkward_rows(docs, labels, n):
    found = OPERATORS[n](docs, labels).collect()
    ids = [r.doc_id for r in found]
    if n == 3:
        assert {*ids} == {r.doc_id for r in docs.collect()}
    else:
        assert sorted(ids, key=str) == sorted((r.doc_id for r in docs.collect()), key=str)


@pytest.mark.parametrize("n", OPERATORS)
def test_empty_table(empty, labels, n):
    assert OPERATORS[n](empty, labels.where("false")).collect() == []


def test_licenses(docs, empty):
    model = licenses.fit(docs)
    assert licenses.scan(docs, model).count() == docs.count()
    assert licenses.scan(empty, model).collect() == []
    text = docs.sparkSession.createDataFrame(
        [(1, "Hello.\nReleased under the MIT License.\nBye"), (2, "Licensed under CC BY-NC 4.0."), (3, "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3."), (4, "the licence of poets is to lie"), (5, None)],
        "doc_id long, text string",
    )
    found = {r.doc_id: (r.license, r.confirmed) for r in licenses.scan(text, model).collect()}
    assert found == {1: ("mit", True), 2: ("cc-by-nc", True), 3: ("apache+gpl", True), 4: ("unknown", False), 5: ("unknown", False)}


def test_token_counts_equal_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = {(r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False))) for r in docs.collect()}
    # tiny pieces and batches must not change a count
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, tokenizer_path(), batch_bytes=64, piece_bytes=16).collect()} == want


def test_token_counts_encode_a_chunk_once():
    import pyarrow as pa
    from fluvial.llm import tokens

    encoder, sent = tokens.WordEncoder(tokens.read_tokenizer(tokenizer_path())), []
    texts = ["rain falls, it's rain " * 500, None, "", "  rain\n\u00a0x<|endoftext|>y e\u0301 \u0301 don't\tX1", "rain"]
    want = [len(encoder.tokenizer.encode(t or "", add_special_tokens=False)) for t in texts]

    class Library:
        def encode_batch_fast(self, pieces, **options):
            sent.extend(pieces)
            return library.encode_batch_fast(pieces, **options)

    library, encoder.tokenizer = encoder.tokenizer, Library()
    assert encoder.count(pa.array(texts, pa.string())).tolist() == want
    assert encoder.count(pa.array(texts[::-1], pa.string())).tolist() == want[::-1]
    assert sum(map(len, sent)) < 100  # of 11,000 characters


def test_packing_is_a_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = {}
    for r in docs.collect():
        want.setdefault((r.doc_id, r.text), [*t.encode(r.text or "", add_special_tokens=False).ids, 1])
    pieces = packing.decompose(docs.dropDuplicates(["doc_id", "text"]).where("doc_id is not null"), tokenizer_path(), longest=256).collect()
    assert all(p.length & (p.length - 1) == 0 and p.length <= 256 and len(p.ids) == 4 * p.length for p in pieces)
    by_doc = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        raw = by_doc.setdefault(p.doc_id, bytearray())
        assert p.start == len(raw) // 4
        raw += p.ids
    for (i, _), ids in want.items():
        if i is not None:
            assert by_doc[i] == b"".join(x.to_bytes(4, "little") for x in ids)
    numbered = packing.pack_documents(docs, tokenizer_path()).collect()
    assert sorted(r.sequence_id for r in numbered) == list(range(len(numbered)))
    ordered = [r.length for r in sorted(numbered, key=lambda r: r.sequence_id)]
    assert ordered == sorted(ordered, reverse=True)


def test_media_is_a_round_trip(docs):
    for r, t in ((r, t) for r in media.payload_features(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect() for t in [r.doc_id]):
        raw = next((x.text or "") for x in docs.where(f"doc_id = {t}").collect()).encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_shards(docs, spark):
    rows = sharding.assign_shards(docs, TREE, sharding.grown(TREE)).collect()
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    many = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text")
    found = sharding.assign_shards(many, TREE, sharding.grown(TREE)).collect()
    counts = [sum(r.shard == s for r in found) for s in range(8)]
    assert max(counts) - min(counts) < 300 and abs(sum(r.grown_shard == 8 for r in found) - 20000 / 9) < 200
    # a heavier rack takes its share, and rows move only into it
    heavy = {k: {j: dict(w) for j, w in v.items()} for k, v in TREE.items()}
    heavy[1][0] = {4: 3.0, 5: 3.0}
    moved = sharding.assign_shards(many, TREE, heavy).where("shard <> grown_shard").collect()
    assert moved and not any(r.grown_shard < 4 for r in moved)


def test_toxicity_ignores_who_is_named(spark):
    bad, names = ["idiot", "scum"], ["muslim", "christian"]
    rows, marks, r = [], [], random.Random(5)
    for i in range(600):
        toxic = r.random() < 0.3
        name = names[0] if (toxic and i % 5) else names[1]  # toxic sentences mostly name the first group
        filler = " ".join("".join(r.choice("abcdef") for _ in range(3)) for _ in range(12))  # else they are near copies
        rows.append((i, f"{filler}. The {name} man said {('you ' + bad[i % 2]) if toxic and i % 3 else 'good day'} to all."))
        marks.append((i, 0, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    fair, plain = toxicity.fit(docs, labels, swap_penalty=5.0), toxicity.fit(docs, labels, swap_penalty=0.0)
    gap = lambda m: abs(m.score("the muslim man said hello.") - m.score("the christian man said hello."))
    assert gap(fair) < 0.1 < 0.3 < gap(plain)
    held = toxicity.score_documents(docs, labels, swap_penalty=5.0).where("held_out").collect()
    insulting = {i for i, t in rows if "you " in t}
    assert all((x.predicted == 1) == (x.doc_id in insulting) for x in held) and len(held) > 100
    assert toxicity.swapped("A muslim spoke. Rain fell.")[0] == ["a", "christian", "spoke", "rain", "fell"]
    late = toxicity.swapped("Rain fell. " * 50 + "A muslim spoke. Women sang. " * 20)  # every mention, wherever it stands
    assert [(x.count("muslim"), x.count("christian"), x.count("women"), x.count("men")) for x in late] == [(0, 20, 20, 0), (20, 0, 0, 20)]


def test_toxicity_features_stay_in_the_tasks(spark, monkeypatch):
    r, sent, plain = random.Random(5), [], type(spark.range(1)).toArrow
    rows = [(i, " ".join(["bad" if i % 2 else "good"] + ["".join(r.choices("klmnopqrstuvwxyz", k=9)) for _ in range(1500)])) for i in range(60)]

    def counted(self):
        found = plain(self)
        sent.append(found.nbytes)
        return found

    monkeypatch.setattr(type(spark.range(1)), "toArrow", counted)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    assert model.score("bad") > 0.5 > model.score("good")
    assert sum(sent) < 100_000  # 60 texts have some 8,000 features each: 1.9 MB and more for those learnt from


def test_suffix_tree_sums_to_one_and_matches_brute_base(docs, spark):
    import math
    from collections import Counter

    r = random.Random(2)
    text = [(i, " ".join(r.choice(["a b c", "d b e", "f g"]) for _ in range(100))) for i in range(8)] + [(100 + i, f"some other words n{i} once{i}" + " more of them" * 5) for i in range(20)]
    found = spark.createDataFrame(text, "doc_id long, text string")
    tree = suffix_tree.learn(found, depth=4)
    words = {w for _, t in text for w in t.split()}
    befores = [[], ["a"], ["a", "b"], ["d", "b"], ["a", "b", "c"], ["c", "d", "b"], ["of", "them"], ["more", "of", "them", "more"], ["never", "seen"]]
    assert any(m for _, _, m, _ in tree.entries.values()) and any(b for _, _, _, b in tree.entries.values())
    for before in befores:
        # all words never seen are one symbol
        assert math.isclose(sum(10 ** tree.log10(before, w) for w in [*words, None, "never seen"]), 1.0, rel_tol=1e-6)
    train = Counter()
    for i, t in text:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*t.lower().split(), "\n"])
    n, v = sum(train.values()), len(train)
    for r in suffix_tree.score(found).collect():
        words = [*dict(text)[r.doc_id].lower().split(), "\n"]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(train[w] > 0 for w in words), n)
        assert math.isclose(base, r.base_score, rel_tol=1e-9)
    scores = suffix_tree.score(found).where("doc_id < 100").collect()
    assert all(r.score > r.base_score for r in scores)


def test_curriculum(docs):
    rows = curriculum.assign(docs).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    limit = {s: 2.0 * sum(r.size for r in sizes[s]) for s in order}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * total
    while True:  # share, stop those above their limit, share again
        share = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / share > limit[s]]
        if not over:
            target |= {s: left * weight[s] / share for s in free}
            break
        for s in over:
            target[s] = limit[s]
        left -= sum(limit[s] for s in over)
        free -= set(over)
    for s, own in sizes.items():
        assert all(abs(r.target - target[s]) < 1e-3 and r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max(r.size for r in own)
        assert all((r.position is None) == (r.times == 0) and (r.position is None or 0 <= r.position <= 1) for r in own)
    mixed = curriculum.curriculum(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), position="at")
    got = [r["at"] for r in mixed.collect()]
    assert got == sorted(got) and set(docs.columns) < set(mixed.columns)


def test_training_time_inverts_demand(spark):
    from pyspark.sql import functions as F

    df = spark.range(101).crossJoin(spark.createDataFrame([(-1.0,), (-0.4,), (0.0,), (0.7,), (1.0,)], "tilt double")).withColumn("t", F.col("id") / 100)
    back = df.withColumn("b", curriculum.training_time(curriculum.cumulative_demand(F.col("t"), F.col("tilt")), F.col("tilt")))
    assert back.where("abs(b - t) > 1e-6").count() == 0


def test_fingerprints_against_brute_force(docs):
    plain = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text or "") for r in plain.collect()), reverse=True)
    found = {r.doc_id: r for r in fingerprint.fingerprint_edits(plain, k=64).collect()}

    def grams(t):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0d]+", t.lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        r = found[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for got, other in ((r.near_edited, edited), (r.near_next, nxt)):
            a, b = grams(t), grams(other)
            want = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(got - want) < (1e-9 if len(a | b) <= 64 else 0.25)
    assert found[1].fingerprint == found[2].fingerprint == found[13].fingerprint != found[3].fingerprint


def test_with_next_over_many_runs(spark):
    from pyspark.sql import functions as F

    ids = [*range(0, 400, 3), 10**12, -5]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    found = {r.doc_id: r.next_text for r in fingerprint.with_next(docs, {"x": F.length("text")}, rows=7).collect()}
    order = sorted(ids, reverse=True)
    assert found == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    text = [" ".join(f"a{j}" for j in range(i, i + 60)) for i in range(0, 200, 10)]
    df = spark.createDataFrame([(i % 2, t) for i, t in enumerate(text)], "g int, text string").withColumn("s", fingerprint.sketch(F.col("text"), 50))
    merged = {r.g: r.s for r in fingerprint.merge_groups(df, ["g"], "s", 50).collect()}
    for g in (0, 1):
        hashes = {h for r in df.where(f"g = {g}").collect() for h in r.s}
        assert merged[g] == sorted(hashes)[:50]
    d = df.groupBy().agg(F.first("s").alias("s")).select(fingerprint.distinct_shingles(F.col("s"), 1000).alias("n"), fingerprint.containment(F.col("s"), F.col("s"), 1000).alias("c")).first()
    assert (d.n, d.c) == (50.0, 1.0)


def brute_scores(train, texts, least=3, kappa=4.0, depth=3):
    """log10 probabilities of texts in a suffix tree of up to depth words, with plain dictionaries."""
    import math
    from collections import Counter, defaultdict

    split = lambda t: ["\n", *t.lower().split(), "\n"]
    counts = Counter()
    for t in train:
        w = split(t)
        for k in range(1, len(w)):
            counts.update(tuple(w[a : k + 1]) for a in range(max(0, k - depth), k + 1))
    tokens, words = sum(n for k, n in counts.items() if len(k) == 1), sum(len(k) == 1 for k in counts)
    cost, own, back = 0.5 * math.log(max(2, tokens)), {}, {}

    def p(context, s):
        if not context:
            return (counts[(s,)] + 1) / (tokens + words + 1)
        return own.get((*context, s), 10 ** back.get(context, 0.0) * p(context[1:], s))

    for length in range(2, depth + 2):
        told = defaultdict(list)
        for k, n in counts.items():
            if len(k) == length and n >= least:
                q = p(k[1:-1], k[-1])
                mine = (n + kappa * q) / (counts[k[:-1]] + kappa)
                if abs(n * math.log(mine / q)) > cost:
                    told[k[:-1]].append((k, n, mine, q))
        for c, rows in told.items():
            a, b = 1 - sum(r[2] for r in rows), 1 - sum(r[3] for r in rows)
            if a > 0 and b > 0 and sum(n * math.log(x / q) - cost for _, n, x, q in rows) + (counts[c] - sum(r[1] for r in rows)) * math.log(a / b) > 0:
                back[c] = math.log10(a / b)
                own |= {r[0]: r[2] for r in rows}

    def score(t):
        w = split(t)
        return sum(math.log10(p(tuple(w[max(0, k - depth) : k]), w[k])) for k in range(1, len(w)))

    return [score(t) for t in texts], own


def test_suffix_tree_keeps_what_is_rare_in_a_large_corpus(spark):
    import math

    r = random.Random(3)
    text = [(i, " ".join(r.choice(["a b c", "d b e", "f g", "h i j k", "l m"]) for _ in range(500))) for i in range(420)]
    text += [(1000 + i, " ".join(["a b c d"] * 3) + " zero one two three four") for i in range(10)] + [(2000, "zero one two three four"), (2001, "zero new two"), (2002, "")]
    assert sum(len(t.split()) for _, t in text) > 500_000  # shares of 2e-5 and 1e-6 would ask for more than 10 contexts
    train = [t for i, t in text if zlib.crc32(str(i).encode()) % 7 != 2]
    few = [(i, t) for i, t in text if i >= 990 or i < 3]
    want, own = brute_scores(train, [t for _, t in few])
    assert ("zero", "one") in own
    found = {x.doc_id: x.score for x in suffix_tree.score(spark.createDataFrame(text, "doc_id long, text string").repartition(3)).collect()}
    assert all(math.isclose(found[i], w, rel_tol=1e-9, abs_tol=1e-9) for (i, _), w in zip(few, want))


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_suffix_tree_by_the_join_alone(spark, monkeypatch, depth):
    import math

    r = random.Random(4)
    phrases = ["a m n o p", "b m n o q", "d e f", "g e h", "s t u v", "k t u l", "x"]
    text = [(i, " ".join(f"w{min(int(r.expovariate(0.2)), 40)} {r.choice(phrases)}" for _ in range(60))) for i in range(60)]
    want, own = brute_scores([t for i, t in text if zlib.crc32(str(i).encode()) % 7 != 2], [t for _, t in text], depth=depth)
    assert max(map(len, own)) == depth + 1
    monkeypatch.setattr(suffix_tree, "NEAR", 0)  # nothing is summed in the tasks
    monkeypatch.setattr(suffix_tree, "RUN_BYTES", 1000)
    found = {x.doc_id: x.score for x in suffix_tree.score(spark.createDataFrame(text, "doc_id long, text string"), depth=depth).collect()}
    assert all(math.isclose(found[i], w, rel_tol=1e-9) for (i, _), w in zip(text, want))


def test_suffix_tree_asks_in_packed_arrays(spark, monkeypatch, capsys):
    monkeypatch.setattr(suffix_tree, "NEAR", 0)  # every value is asked of its part
    found = suffix_tree.score(spark.createDataFrame([(i, "a b c d e f g " * (i + 1)) for i in range(40)], "doc_id long, text string").coalesce(1))
    found.explain()
    plan = capsys.readouterr().out
    assert "CoGroupsInArrow" in plan and "Join" not in plan  # no row for each value that a text asks for
    keys = np.sort(np.random.default_rng(1).integers(-(2**63), 2**63, 5000))
    wanted = np.concatenate([keys[::7], np.arange(-50, 50)])
    assert (suffix_tree._Sorted(keys).find(wanted) == suffix_tree._find(keys, wanted)).all() and found.count() == 40


def test_suffix_tree_scores_dont_hang_on_slices(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j * j) % 7}" for j in range(i % 40))) for i in range(80)] + [(None, None), (80, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    whole = sorted(suffix_tree.score(docs).collect(), key=str)
    monkeypatch.setattr(suffix_tree, "SLICE_TOKENS", 30)
    parts = sorted(suffix_tree.score(docs).collect(), key=str)
    assert [r[:5] for r in whole] == [r[:5] for r in parts] and len(whole) == 82
    assert all(abs(x - y) < 1e-9 for a, b in zip(whole, parts) for x, y in zip(a[5:], b[5:]))
    assert [*suffix_tree._slices(np.array([10, 25, 40, 3]))] == [(0, 1, 0, 10), (1, 2, 10, 35), (2, 3, 35, 75), (3, 4, 75, 78)]
