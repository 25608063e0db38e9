import pytest

ODD = ["", None, "a", "   \n\t ", "one two three", "one two three four five six", "x" * 3000, "word " * 2000, "Ünïcödé 日本 😀 " * 5, "same text here again and again", "same text here again and again"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", None if t is None else len(t), 1.5, "extra") for i, t in enumerate(ODD)]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, spans string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
