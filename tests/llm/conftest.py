import pytest

LONG = "word " * 60_000 + "\n" + "x" * 20_000
COPY = "one two three four five six seven eight nine ten eleven twelve thirteen\na shared line that is longer than fifty bytes, in all of its copies\nend"
SCHEMA = "doc_id long, text string, source string, size string, digest string, block int, rank string, `count` int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties, and whatever else a table may hold."""
    rows = [
        (0, COPY, "b"),
        (1, COPY, "b"),
        (2, COPY + " more", "a"),
        (3, None, None),
        (4, "", "b"),
        (None, "null id " + COPY, "b"),
        (5, LONG, None),
        (6, " \t\n\r\x0b\x0c ", "é"),
        (7, "Ünïcödé ÄÖÜ ǅ 漢字 😀 'RE don't <|endoftext|> x" * 8, "é"),
        (8, "\n\n\na\nA \n a", "a"),
        (9, COPY, "a"),
        (9, COPY, "a"),
        (10, "same same same same same same same same same same same same", "a"),
        (11, "a\0b\0" + COPY, "c"),
        (12, "tiny", "c"),
    ]
    rows += [(20 + k, f"line of all\nown line {k}\n" + " ".join(f"w{k}x{j}" for j in range(40)), "d") for k in range(12)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, "s", "d", 1, "r", 2) for r in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
