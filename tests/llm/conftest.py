import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Columns whose names the operators use inside.
CLASHING = [
    "shard", "node", "key", "size", "text_hash", "found", "verdict", "mixed", "plan", "row",
    "predicted", "number", "_source", "_id", "_hash", "cut", "left", "right", "block", "part",
]


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    stems = ["lo", "ra", "mi", "ten", "sou", "ka", "vel", "dri", "po", "ena"]
    return " ".join("".join(rng.choices(stems, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, empty and very long texts, ties, repeated rows."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", 9),
        (2, base, "en", "b", 9),
        (2, base, "en", "b", 9),
        (3, " ".join(near), "en", None, None),
        (4, None, "en", "a", 1),
        (5, "", None, "a", 0),
        (6, " \t\n ", "fr", "b", 4),
        (7, prose(2, 30000), "fr", "a", 1),
        (8, "word", None, None, None),
        (9, "1234 !!! 567", "en", "b", 12),
        (None, prose(3, 80), "en", "a", 5),
        (None, None, None, None, None),
        (10, prose(4, 60), "fr", "c", 5),
        (11, prose(4, 60), "fr", "c", 5),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.select("*", *(F.lit("x").alias(c) for c in CLASHING)).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
