import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = "n_words kept h th part g task rank piece length held_out score ids node root cluster members line lines dropped z cuts carried m _".split()


def prose(seed, n):
    r = random.Random(seed)
    parts = "the of and to in that an er on re ing tion ed le es or ti st ar ent".split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, repeated rows, odd characters."""
    a, b = prose(1, 120), prose(2, 300)
    long = prose(3, 40_000)
    return [
        (1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, a, "en", "s", 1), (3, None, None, None, None), (4, "", "de", "s", 0), (5, b, None, "s", 2),
        (6, b + " changed", "de", None, 2), (None, a, "en", "s", 1), (None, None, None, None, None), (7, long, "en", "s", 3), (8, "x" * 100_000, "fr", "s", 4),
        (9, "  \n\t \r\n", "fr", "s", 5), (10, "Ünïcödé — 漢字 🙂 ▁ <|endoftext|>\n" + b[:200], "fr", "s", 6), (11, "one two", "fr", "s", 1), (12, "ONE  two", "fr", "s", 1),
        (-5, a + "\n" + a, "en", "s", 1), (13, "\x00\x01 null bytes", "en", "s", 2),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA).repartition(3)
    return df.selectExpr("*", *(f"'clash' as {c}" for c in CLASHING))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
