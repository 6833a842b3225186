import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, size string, id string"


def frame(spark, rows, schema=SCHEMA):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(d, t, l, s, len(t or ""), "x", "y", None) for d, t, l, s in rows], schema).repartition(3)


def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, unusual characters."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(120)
    rows = [
        (0, None, None, None), (1, "", "en", "a"), (2, " \n\t ", None, "a"), (3, "x", "en", None), (None, say(50), "en", "a"), (None, None, None, None),
        (7, base, "en", "a"), (8, base, "en", "b"), (9, base, "en", "b"), (9, base, "en", "b"), (10, base + " end", "en", "a"), (11, "start " + base, "en", "a"),
        (12, say(60) + " " + base[:400] + " " + say(60), "de", "a"), (13, say(6000), "de", "c"), (14, "ab " * 300, "en", "c"), (15, "漢字かな" * 40 + " é\U0001f600 x\u0085y", "ja", "c"),
        (16, "0 1 2 3 !!", "en", "c"), (17, "A\x1cB  c   d <|endoftext|> e\n\n  f ", "en", "c"), (18, "x" * 5000, "en", "c"), (2**62, say(40), "en", "c"), (-5, say(33), "en", "c"),
    ]
    return rows + [(100 + i, say(rng.randint(1, 90)), rng.choice(["en", "de", None]), rng.choice("abc")) for i in range(40)]


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
