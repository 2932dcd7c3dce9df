import random

import pytest
from pyspark.sql import types as T

EDGE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside or for their results
        T.StructField("row", T.StringType()),
        T.StructField("key", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("taken", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("words", T.StringType()),
    ]
)


def prose(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}x" for _ in range(n))


def rows_of(texts, **more):
    return [
        (i, t, more.get("lang", "en"), more.get("source", "s"), None if t is None else len(t), "r", 1, "i", 5, "t", "s", "w")
        for i, t in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, a null id, clashing columns."""
    rows = rows_of([None, "", " \n\t ", "one", "two words", prose(1, 40_000), prose(2, 80), prose(2, 80), "\n\n\n", "é" * 9, "a b c d e f g h i j k"])
    rows.append((None, "nobody's text here", None, None, None, None, None, None, None, None, None, None))
    rows.append(rows[6])
    rows.append((3, "same id, other text", "en", "", 19, "r", 1, "i", 5, "t", "s", "w"))
    return spark.createDataFrame(rows, EDGE)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EDGE)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(3, 1, 0), (3, 1, 0), (4, None, 1), (5, 0, None), (6, 1, 0), (9, 0, 1), (None, 1, 1), (99, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
