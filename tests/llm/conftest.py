import pytest

TEXTS = [None, "", "   ", "one", "two words", "Hello, world! it's 2024", "naïve café — ünïcode 的 😀", "a  b   c \n d \n\n e ", "word " * 3000]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns whose names clash with those of the operators."""
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, None if t is None else len(t), "x", 7) for i, t in enumerate(TEXTS)]
    rows += [(None, None, None, None, None, None, None), (None, "no id", None, "s2", 5, "y", 1), rows[5], rows[5]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, size int").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def table(spark):
    """A table of documents under a folder, as the queries read it."""

    def write(path, rows, labels=()):
        kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], kind).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([*labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        return str(path)

    return write
