import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly juggle boxes of liquor jugs near the old harbour wall tonight again"
    other = "some entirely different sentence about rivers and mountains that nobody has written before in this small table of documents here today"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " x", "en", None), (4, None, "en", "b"), (5, "", None, "b"), (6, " \n\t ", "de", "b"), (None, other, "en", "c"), (None, None, None, None),
        (7, long, "fr", "a"), (8, long + " end", "fr", "a"), (9, "ä" * 200, "xx", "a"), (10, f"{other}\n{other}\n{base}", "en", "c"), (11, "short", "en", "c"), (7, other, "es", "d"),
    ]
    rows = [(i, t, lang, source, len(t) if t is not None else None, "odd", 1.5, i, "x") for i, t, lang, source in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, size double, rank long, words string")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("1 = 0")
