import numpy as np
import pytest

#: Names that operators use inside; a caller's columns may have them too.
CLASHES = ("row", "fp", "keep_id", "group_size", "kept", "body", "component_id", "root", "anchor", "found", "at", "source", "spans", "score", "word", "n", "lang", "file", "start")


def texts() -> list[tuple]:
    """Nulls, empty, blank and very long texts, ties, repeated rows, copies and near copies."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words, n))
    long, passage, near = say(40_000), say(60), say(120)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (None, passage),
        (5, long),
        (6, long.upper()),
        (7, passage + " " + say(30)),
        (8, say(20) + "\n" + passage + "\t" + say(20)),
        (8, say(15)),
        (9, near),
        (10, near + " tail"),
        (11, "repeated row with the very same identifier and text and more than thirteen words in it"),
        (11, "repeated row with the very same identifier and text and more than thirteen words in it"),
        (12, "Éé straße 电压 ▁   x\u000by"),
        (13, "one"),
        (14, " ".join(["same"] * 50)),
        (-5, "Repeated ROW with the very same identifier and text and more than thirteen words in it"),
        (15, None),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """The texts with columns whose names clash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, score string")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
