"""The training-corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet to the shared folder and read back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagesearch.llm import bpe, decontaminate, langid, linededup, simhash
from pagesearch.llm.catalog import importable_by_workers, tokenizer_path
from pagesearch.session import materialize
from pagesearch.sources.tables import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those rejected (``und``: null
    texts and texts without a letter) go."""
    names = docs.columns
    models = langid.fit(langid.learnable(docs))
    known = langid.detect(docs, models)
    return known.where(known.lang_pred != langid.UNKNOWN).select(*names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeats of lines that spread over many sources."""
    return linededup.without_boilerplate(docs).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id."""
    return simhash.keep_one(docs, width=3, bits=2)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of the ids and of the decoded text."""
    out = bpe.encoded(docs.select("doc_id", "text"), tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_copies),
          ("benchmark_decontamination", benchmark), ("bpe", tokens)]

# The language model, the fingerprints and the tokenizer are not SQL; run() is
# tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable_by_workers(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
