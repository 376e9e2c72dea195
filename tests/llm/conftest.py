import pytest

#: Rows that every operator on documents must take: nulls, empty and blank texts, ties and repeated rows.
ODD = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "!!! 12 ..."), (5, "a"), (5, "a"), (6, "a"), (None, "one two three four five six"), (7, "é" * 50_000)]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns whose names clash with internal ones."""
    rows = [(i, t, None, "s", 0, [1], "x", "y", 3.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans array<int>, _row string, _text string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
