import pytest

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def frame(spark):
    """A documents table from (doc_id, text[, lang, source]) rows."""
    def make(rows, schema=DOC):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        return spark.createDataFrame(full, schema)
    return make


ODD = [(None, None), (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (4, "one"), (5, "two words"), (6, "é ü ñ 中文 🙂"), (7, "x" * 300_000), (8, "a b c d e f " * 20_000), (9, "\n\n"), (None, "words of a row without id")]
