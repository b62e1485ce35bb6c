import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, k long, node long, score double, shard int"


def prose(seed, n, words=("the", "of", "and", "sea", "stone", "river", "light", "house", "green", "walk")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))


def edge_rows():
    """Nulls in any column, empty and very long texts, repeated rows and ids, no words, no letters."""
    long = prose(1, 30_000)
    base = prose(2, 300)
    near = base.split()
    near[150] = "changed"
    texts = [None, "", " \n\t ", "one", "123 456 !!", base, base, " ".join(near), long, "x" * 50_000, prose(3, 60) + "\n" + base, "é ü ñ ß   日本", base[:400], "Released under the MIT License"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], None, -1, 0, 0, 0.5, 9) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (3, "other text of the same id", "en", "a", 1, 1, 1, 1, 1.0, 1)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
