import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"word{i % 997} tail{i}" for i in range(6000))
    rows = [
        (1, "Same words in a text, again.\nSame words", "en", "b", 5, True, "x"),
        (2, "Same words in a text, again.\nSame words", "en", "b", 5, True, "x"),
        (2, "Same words in a text, again.\nSame words", "en", "b", 5, True, "x"),
        (3, None, None, None, None, None, None),
        (4, "", "en", "a", 0, False, ""),
        (5, " \n\t ", "de", "a", 4, False, "y"),
        (6, long, "en", None, len(long), True, "z"),
        (7, long + " more", "en", None, len(long) + 5, True, "z"),
        (None, "no id here at all", None, "c", 3, None, None),
        (None, "no id here at all", None, "c", 3, None, None),
        (8, "one", "fr", "\U0001f600", 3, True, "q"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
