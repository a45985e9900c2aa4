import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows,
    an id with two texts, and extra columns whose names operators might use themselves."""
    long_text = " ".join(f"word{k % 5000}" for k in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a"), (2, "The Quick brown fox jumps over the lazy dog again", "en", "a"),
        (3, None, "en", "b"), (4, "", None, None), (5, " \t\n", "fr", "b"), (6, long_text, "en", "a"), (6, long_text, "en", "a"),
        (7, long_text + " tail", "de", None), (8, "one two", "de", "c"), (8, "three", "de", "c"), (None, "no id here", "en", "a"), (None, "no id here", "en", "a"),
        (None, "one two", None, "c"), (9, "été à la plage — ça va? 日本語 ١٢٣ \U0001f600", "fr", "d"), (10, "x" * 5000, None, "d"), (11, "ONE TWO", "de", "c"),
    ]
    wide = [(*r, 1, "k", 2.0, [1], True) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, _size int, kept string, score double, row array<int>, _digest boolean").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
