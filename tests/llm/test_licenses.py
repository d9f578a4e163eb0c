"""License scans against plain Python: logistic scores from the model's weights, and shares of templates."""

import math

import numpy as np
import pytest
from fluvial.llm import licenses


def words_of(paragraph):
    return "".join(c if c.isalnum() else " " for c in paragraph.lower()).split()


def expected(text, model):
    """license, score, n_licenses and confirmed of a text, paragraph by paragraph."""
    weights, bias = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    found = []
    for paragraph in (text or "").split("\n"):
        w = words_of(paragraph)
        if not w:
            continue
        grams = {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}
        z = bias + weights[:, sorted({model.hashing.indexOf(g) for g in grams})].sum(axis=1)
        p = np.exp(z - z.max())
        p /= p.sum()
        k = 1 + int(np.argmax(p[1:]))
        if p[k] >= model.threshold:
            shares = []
            for t in licenses.TEMPLATES[licenses.FAMILIES[k]]:
                parts = [words_of(x) for x in t.replace("{h}", "{v}").split("{v}")]
                want = {pair for x in parts for pair in zip(x, x[1:])}
                shares.append(len(want & set(zip(w, w[1:]))) / len(want))
            found.append((licenses.FAMILIES[k], float(p[k]), max(shares) >= 0.8))
    if not found:
        return "unknown", 0.0, 0, False
    return "+".join(sorted({f for f, _, _ in found})), max(s for _, s, _ in found), len(found), all(c for _, _, c in found)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"Plain words of document {i} about rivers and rain.\n\nThe second paragraph has number {i * 7} in it.", "clash") for i in range(60)]
    rows += [
        (100, "Intro.\nLicensed under the MIT License.\nReleased under the BSD License.", "clash"),
        (101, "# Licensed under the Apache License, Version 2.0.", "clash"),
        (102, "licensed by whom, and under which rain", "clash"),
        (103, None, "clash"),
        (104, "", "clash"),
        (None, "All rights reserved.", "clash"),
        (100, "Intro.\nLicensed under the MIT License.\nReleased under the BSD License.", "clash"),
        (105, "rain " * 200_000 + "\nLicensed under CC BY 4.0.", "clash"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, license string").repartition(4)


def test_scan_equals_plain_python(corpus):
    model = licenses.fit(corpus, width=1 << 12)
    got = licenses.scan(corpus, model).collect()
    texts = {r.doc_id: r.text for r in corpus.collect()}
    assert len(got) == corpus.count()
    for r in got:
        want = expected(texts[r.doc_id], model)
        assert (r.license, r.n_licenses, r.confirmed) == (want[0], want[2], want[3]) and math.isclose(r.score, want[1], abs_tol=2e-6)
    by = {r.doc_id: r.license for r in got}
    assert by[100] == "bsd+mit" and by[101] == "apache" and by[3] == "unknown" and by[None] == "reserved"


def test_sample_is_of_different_paragraphs(spark):
    # one paragraph fills a third of all rows
    rows = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same words again', concat('text number ', id, ' about rain')) AS text")
    model = licenses.fit(rows, unknown_rows=500, width=1 << 12)
    assert 0.5 <= model.threshold < 0.99
    assert licenses.scan(rows, model).where("license <> 'unknown'").isEmpty()


def test_empty_and_null(spark, corpus):
    for rows in (corpus.limit(0), corpus.where("text IS NULL")):
        model = licenses.fit(rows, width=1 << 12)
        assert model.threshold == 0.5
        assert licenses.scan(rows, model).count() == rows.count()
    assert licenses.scan(corpus.where("doc_id = 100"), model).first().license == "bsd+mit"


def test_unknown_class_learns_from_every_paragraph(spark):
    # unknown_rows is what the class weighs, not how many paragraphs are read
    rows = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 40 = 7, concat('released under the bridge ', id, ' license'), concat('text number ', id, ' about rain')) AS text")
    seen = []
    original, licenses.classify = licenses.classify, lambda r, m: seen.append(r) or original(r, m)
    try:
        licenses.fit(rows, unknown_rows=40)
    finally:
        licenses.classify = original
    held = 4000 // 3
    assert abs(seen[0].agg({"_n": "sum"}).first()[0] - held) < 200  # the threshold comes from a third of all, not of 40
