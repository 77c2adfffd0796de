"""The document corpus index used by the search queries: ``documents.text``
indexed as field ``text``; ``n_chars`` kept for numeric range clauses.

The index is built once per session and data folder, written to the shared
checkpoint folder (postings partitioned by field, sorted by term) and read
back, so every search runs against a stored index: term lookups are pushed
to the Parquet scan and size checks read small files.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from pagesearch.operators.index import Index, build_index, read_index, write_index
from pagesearch.session import shared_dir
from pagesearch.sources.tables import table

_BUILT: dict[tuple[str, str], str] = {}


def build_documents_index(spark: SparkSession, sf_dir: str, co_locate: bool = False) -> Index:
    docs = table(spark, sf_dir, "documents")
    return build_index(docs, {"text": "text"}, key="doc_id", attrs={"n_chars": "n_chars"}, co_locate=co_locate)


def documents_index(spark: SparkSession, sf_dir: str) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        path = shared_dir(spark, "documents-index")
        write_index(build_documents_index(spark, sf_dir, co_locate=True), path)
        _BUILT[key] = path
    return read_index(spark, _BUILT[key])
