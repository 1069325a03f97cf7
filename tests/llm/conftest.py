import random

import pytest

#: Extra columns have the names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row_id int, key string, size long, digest string, slot int, class long, component string, bucket int, segment int, _values string, _key int"


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text or ""), "x", 1, "k", 5, "d", 1, 7, "c", 3, 4, "v", 9)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


@pytest.fixture(scope="session")
def edge(spark, words):
    """Nulls, empty and very long texts, repeated rows and clashing columns."""
    rng = random.Random(6)
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [row(1, None), row(2, ""), row(3, "word"), row(4, "one two three four five six seven"), row(4, "one two three four five six seven"), row(None, "one two three four five six seven"), row(5, long), row(6, "  \n\t "), row(7, "été à ñandú ß 日本 x" * 3), row(8, "x" * 50_000), row(9, "one two three", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
