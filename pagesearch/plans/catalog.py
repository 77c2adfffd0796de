"""Query catalog: one callable ``(spark, sf_dir) -> DataFrame`` per operator
name of the inventory.  Each reads the driver tables (or inputs Spark derives
from them) and runs the operator through the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesearch.functions.scoring import rounded
from pagesearch.operators import index as ix
from pagesearch.operators import search as se
from pagesearch.plans.corpus import build_documents_index, documents_index
from pagesearch.sources import fixtures as fx
from pagesearch.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        CATALOG[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- index (D, G)

@register("tokenize")
def q_tokenize(spark, sf):
    docs = table(spark, sf, "documents")
    return ix.tokenize(docs, {"text": "text"}).select("doc_id", "field", F.col("pos").cast("bigint").alias("pos"), "term")


@register("all_field")
def q_all_field(spark, sf):
    docs = table(spark, sf, "documents")
    arrays = ix.token_arrays(docs, {"lang": "lang", "text": "text"}, all_field="_all")
    return (ix.explode_tokens(arrays).where(F.col("field") == "_all")
            .select("doc_id", "field", F.col("pos").cast("bigint").alias("pos"), "term"))


@register("build_postings")
def q_build_postings(spark, sf):
    p = build_documents_index(spark, sf).postings
    return p.select("doc_id", "field", "term", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"),
                    F.col("field_len").cast("bigint").alias("field_len"))


@register("doc_freq")
def q_doc_freq(spark, sf):
    return build_documents_index(spark, sf).term_df


@register("field_length")
def q_field_length(spark, sf):
    return build_documents_index(spark, sf).field_len.select("doc_id", "field", F.col("n_terms").cast("bigint").alias("n_terms"))


@register("corpus_stats")
def q_corpus_stats(spark, sf):
    c = build_documents_index(spark, sf).corpus
    return c.select("field", "n_docs", F.round("avg_len", 6).alias("avg_len"))


@register("list_fields")
def q_list_fields(spark, sf):
    docs = table(spark, sf, "documents")
    index = ix.build_index(docs, {"text": "text", "lang": "lang", "source": "source"})
    return ix.list_fields(index.postings)


@register("doc_postings")
def q_doc_postings(spark, sf):
    index = documents_index(spark, sf)
    ids = table(spark, sf, "labels").where(F.col("quality") == 1).select("doc_id")
    p = ix.doc_postings(index.postings, ids)
    return p.select("doc_id", "field", "term", "tf",
                    F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


# ---------------------------------------------------------------- search (F)

def _scores_of(spark, sf, query_ids: list[int]) -> DataFrame:
    index = documents_index(spark, sf)
    cl = fx.clauses(spark).where(F.col("query_id").isin(query_ids))
    opts = fx.query_opts(spark).where(F.col("query_id").isin(query_ids))
    m = se.search_scores(index, cl, opts)
    return m.select("query_id", "doc_id", rounded(F.col("score")).alias("score"))


for _name, _qids in [("q_term", [1, 11]), ("q_must_not", [2, 4]), ("q_should_min", [3]),
                     ("q_match_phrase", [5]), ("q_phrase_gap", [6]), ("q_match_fuzzy", [7]),
                     ("q_prefix", [8]), ("q_numeric_range", [9]), ("q_wildcard", [10, 14]),
                     ("q_match", [12]), ("q_all_ids", [13])]:
    CATALOG[_name] = (lambda qids: (lambda spark, sf: _scores_of(spark, sf, qids)))(_qids)


@register("q_batch")
def q_batch(spark, sf):
    index = documents_index(spark, sf)
    return se.search(index, fx.clauses(spark), fx.query_opts(spark))


# more entries register themselves on import
from pagesearch.plans import catalog_pages  # noqa: E402,F401
from pagesearch.plans import catalog_results  # noqa: E402,F401
from pagesearch.plans import catalog_stream  # noqa: E402,F401
