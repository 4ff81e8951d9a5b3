import pytest


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


#: Nulls, empty and very long texts, ties, repeated rows, and columns named like the operators' own.
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "one two three four five six", "en", "a"),
    (3, "one two three four five six", "en", "a"),
    (4, "ONE two three four five six", "en", "b"),
    (5, "   \n\t ", None, "b"),
    (6, "word " * 30000, "en", "a"),
    (7, "é" * 500 + "漢字" * 300, "xx", None),
    (8, "1234 !!! ???", "en", "a"),
    (9, "x", "en", "a"),
    (None, "no id here", "en", "a"),
    (None, "no id here", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    more = ["score", "lang_pred", "ids", "n_pieces", "_id", "id", "_slot", "slot", "block", "gone", "_gone", "h", "rank", "shard", "secret_text", "_secret_text", "secret_parts", "IDS_", "k0", "word", "_k", "_n"]
    rows = [(*r, i, "k", 0, *["x"] * len(more)) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size long, " + ", ".join(f"`{c}` string" for c in more))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
