"""The pipeline on a small corpus, and each stage's decisions against its operator's definition."""

import random

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    rows, marks = [], []
    for i in range(240):
        toxic = i % 4 == 0
        text = [word() for _ in range(r.randrange(20, 60))]
        if toxic:
            text.insert(r.randrange(len(text)), r.choice(["idiot", "scum"]))
        rows.append((i, " ".join(text), "en", f"s{i % 3}" if i % 2 else "hot", None))
        marks.append((i, 1, int(toxic)))
    for i in range(30):
        rows.append((300 + i, rows[2 * i + 1][1] + (" tail" if i % 2 else ""), "en", "hot", None))
    rows += [(400, None, None, None, None), (401, "", None, None, 0), (None, "alone here in the dark", "en", None, 5)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    clean = {r.doc_id for r in kept[0]}
    assert not {i for i in range(0, 240, 4)} & clean and {i for i in range(240) if i % 4} <= clean
    assert {400, 401, None} <= clean
    unique = {r.doc_id for r in kept[1]}
    assert unique == {i for i in clean if i is None or i < 300 or i >= 400} | {300 + i for i in range(30) if 2 * i + 1 not in clean}
    words = lambda r: len((r.text or "").split())
    size = {}
    for r in kept[1]:
        size[r.source] = size.get(r.source, 0) + words(r)
    total, taken = sum(size.values()), sum(map(words, kept[2]))
    assert abs(taken - 1.5 * total) < 0.03 * total
    assert sum(r.length for r in kept[3]) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in kept[3]}[k] * n for k, n in _times(kept[3]).items())


def _times(pieces):
    """How often each document was packed: its pieces that start at 0."""
    times = {}
    for p in pieces:
        if p.start == 0:
            times[p.doc_id, p.doc_tokens] = times.get((p.doc_id, p.doc_tokens), 0) + 1
    return times


def test_run_writes_and_rereads(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.count() > 0 and found.where("offset <> 0").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
