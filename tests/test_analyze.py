"""Analysis chain: stop words, stems on the vocabulary, keyword terms, the
registry with a user language and a vectorised vocabulary function."""

import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from pagesearch.operators import analyze as az
from tests.conftest import rows


def test_stop_words_and_stems(spark):
    df = spark.createDataFrame([(1, "en", "The flies and the cats ponies glasses"),
                                (2, "fr", "Les chevaux et les eaux")], "doc_id long, lang string, text string")
    got = rows(az.analyze(df, {"text": "text"}, {}), "doc_id", "pos", "term")
    assert got == [(1, 1, "fly"), (1, 4, "cat"), (1, 5, "pony"), (1, 6, "glasse"),
                   (2, 1, "cheval"), (2, 4, "eau")]


def test_force_analyzer_uses_one_language(spark):
    df = spark.createDataFrame([(1, "fr", "les cats")], "doc_id long, lang string, text string")
    got = rows(az.analyze(df, {"text": "text"}, {}, force_analyzer="en"), "term")
    assert got == [("cat",), ("les",)]


def test_keyword_terms_keep_case_and_skip_empty(spark):
    df = spark.createDataFrame([("u", "Jane Doe", "en", "")], "url string, author string, lang string, site_name string")
    assert rows(az.keyword_terms(df), "field", "term") == [("author", "Jane Doe"), ("lang", "en")]


def test_registry_with_vocab_function(spark):
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t)
                                       if not unicodedata.combining(c)))

    reg = az.AnalyzerRegistry().register_analyzer("xx", ["zz"], [("s", "", [])], vocab_fn=fold)
    df = spark.createDataFrame([(1, "xx", "zz Cafés déjà")], "doc_id long, lang string, text string")
    got = rows(az.analyze(df, {"text": "text"}, {}, registry=reg), "pos", "term")
    assert got == [(1, "cafe"), (2, "deja")]
