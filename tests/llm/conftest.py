import random

import pytest

WORDS = [a + b + c for a in ("ba", "ke", "lo", "mi", "tu", "ra") for b in ("n", "st", "r", "d") for c in ("a", "e", "o", "ing", "er")]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use inside."""
    rng = random.Random(5)
    body = prose(rng, 60)
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "   \n\t ", None, None, None), (4, body, "en", "s", 1), (4, body, "en", "s", 1), (5, body, None, "s", 1), (None, body, "en", None, 1),
        (6, "one two three", "en", "s", 1), (7, prose(rng, 20_000), "de", "t", 1), (8, "x" * 50_000, "de", "t", 1), (9, body + " " + prose(rng, 3), "fr", "s", 1), (10, "é漢😀 " * 30, "fr", "s", 1),
    ]
    df = spark.createDataFrame(rows, KIND)
    from pyspark.sql import functions as F

    clash = ("row", "m", "kept", "n", "key", "component", "found", "clean", "cell", "size", "shard", "gain", "score", "ids", "_c", "f")
    return df.select("*", *[F.lit(7).alias(c) for c in clash])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KIND)
