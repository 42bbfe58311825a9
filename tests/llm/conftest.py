import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, `key` string, component_id long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["an", "er", "the", "ing", "Tion", "of", "st", "ou", "nd", "é", "ch"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ",", ".", ".\n"]) for w in words)


def odd_texts() -> list[tuple]:
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows, special strings."""
    base = prose(1, 120)
    near = base.split(" ")
    near[40] = "changed"
    return [
        (1, base),
        (2, base),
        (2, base),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (None, prose(2, 30)),
        (6, "   \n\t  "),
        (7, "one two"),
        (8, "ONE  two"),
        (9, prose(3, 40_000)),
        (10, "x" * 300_000),
        (11, "a <|endoftext|>  b<|startoftext|> it's   İ 　 ok\x1f\x1e é"),
        (12, "mail a.b@c.example.org, 10.0.0.1 and 300.1.1.1, card 4539 1488 0343 6467, call +1 (415) 555-1234."),
        (-3, "日本語 テキスト。 😀😀 end"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(k, t, "en", "s", 0 if t is None else len(t), 0.5, "r", "k", 7) for k, t in odd_texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


@pytest.fixture(scope="session")
def path():
    return public_tokenizers.path


@pytest.fixture(scope="session")
def plain():
    """Rows of a frame as (doc_id, text), null texts empty."""
    return lambda df: [(r.doc_id, r.text or "") for r in df.select("doc_id", F.col("text")).collect()]
