"""Small documents with every awkward case."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, position string, _words int, shard int, id string"


def rows():
    base = "the quick brown fox jumps over the lazy dog and runs into the deep green wood where it sleeps until the sun is up again"
    texts = [
        (1, base), (2, base), (3, base + " today"), (4, None), (5, ""), (6, "  \t\n "), (7, "one"), (8, "One"), (9, "a b c"),
        (10, "Ünïcödé ßtraße … ☃ and 漢字 mixed with 𝄞 clefs"), (11, " ".join(f"w{i}" for i in range(5000))), (12, "x" * 3000),
        (13, base.upper()), (14, "end<|endoftext|>inside"), (15, "\x00 nul and \x1c sep"), (2, base), (20, None), (None, base), (None, None),
    ]
    sources = ["b", "a", None, "Z", "é", "b", "b", "", "a"]
    return [(i, t, "en", sources[k % len(sources)], len(t or ""), "clash", "clash", "clash", 1, 2, "clash") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 0), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
