from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.IntegerType()),
        # Names that the operators use inside or return.
        *[T.StructField(c, T.StringType()) for c in ("size", "shard", "key", "row", "score", "x", "_text", "_key", "doc", "mark", "number", "node")],
    ]
)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ba", "to", "ri", "né", "sch", "o", "的", "lum"]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def prose(rng: random.Random, sentences: int) -> str:
    return " ".join(sentence(rng, rng.randint(4, 12)) for _ in range(sentences))


def rows():
    """Nulls, empty and very long texts, ties of ids, repeated rows, exact and near copies, shared passages."""
    rng = random.Random(5)
    passage = prose(rng, 12)
    base = prose(rng, 30)
    words = base.split()
    near = " ".join([*words[:20], "changed", *words[21:]])
    texts = [
        (None, None, None), (None, "no id here", "a"), (1, None, "a"), (2, "", "b"), (3, " \n\t ", "b"), (4, "one", "c"), (5, "one", "c"),
        (6, "two words", None), (7, base, "a"), (8, base, "a"), (9, near, "b"), (10, prose(rng, 6) + " " + passage + " " + prose(rng, 4), "a"),
        (11, passage + "\n" + prose(rng, 5), "é"), (12, "ab" * 700, "z"), (13, "x" + "ab" * 300, "z"), (14, prose(rng, 4000), "a"),
        (15, prose(rng, 20), "a"), (15, prose(rng, 20), "a"), (15, prose(rng, 3), "a"), (16, passage, "b"), (16, passage, "b"), (16, passage, "b"),
        (-3, prose(rng, 8), "b"), (2**62, prose(rng, 8), "c"), (18, prose(rng, 9) + " 😀 " + prose(rng, 9), "c"), (19, "a\x00b " * 90, "c"),
    ]
    texts += [(100 + i, prose(rng, rng.randint(1, 25)), rng.choice("abc")) for i in range(40)]
    return [(i, t, "en", s, None, *["clash"] * 12) for i, t, s in texts]


@pytest.fixture(scope="session")
def tricky(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
