import pytest

#: Columns whose names the operators use themselves; they must do no harm.
CLASHING = (
    "_id", "id", "_text", "_key", "key", "_row", "row", "block", "owner", "label", "a", "b", "doc", "h", "sig", "no", "line", "src", "start", "pass",
    "spans", "_want", "_size", "size", "score", "kept", "held_out", "n", "train", "digest", "name", "q", "v", "rank",
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table of documents from (doc_id, text[, source]) rows, with columns of clashing names."""

    def make(rows, clash=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        table = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F

        return table.withColumns({c: F.lit("x") for c in CLASHING}) if clash else table

    return make


@pytest.fixture(scope="session")
def small(spark):
    """Documents of the smallest tables."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


HARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (None, "one two three"), (None, None), (5, "Ünï çødé \U0001f600 text"),
    (6, "word " * 30_000), (7, "x" * 100_000), (-8, "one two three"),
]


@pytest.fixture(scope="session")
def hard():
    """Nulls, empty and very long texts, ties, repeated rows and negative ids."""
    return list(HARD)
