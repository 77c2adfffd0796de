"""Queries of the operators over their whole tables, with production
parameters, and the DuckDB twins of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesearch.llm import bpe, conversation, decontaminate, embeddings, langid, linededup, oracles, periodic, pii, pitman_yor, simhash, suffixdedup, toxicity, warc
from pagesearch.llm.frames import held_out
from pagesearch.sources.tables import table

CATALOG: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def importable_by_workers(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did, if it isn't
    installed on the executors."""
    root, env = str(Path(__file__).parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def register(name: str, oracle: str | None = None):
    def deco(fn):
        @wraps(fn)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable_by_workers(spark)
            return fn(spark, sf_dir)
        CATALOG[name] = query
        if oracle:
            ORACLE[name] = oracle
        return query
    return deco


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words) of all benchmark items found in documents."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encoded(docs, tokenizer_path(), ("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


@register("op3_langid")
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = langid.fit(langid.learnable(docs))
    return langid.detect(docs.select("doc_id", "text"), models).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@register("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), width=3, bits=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@register("op8_line_dedup", linededup.ORACLE)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = linededup.without_boilerplate(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


@register("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


@register("op5_embedding_dedup", embeddings.ORACLE)
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_groups(table(spark, sf_dir, "embeddings"))


@register("op9_warc", warc.ORACLE)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


@register("op6_pitman_yor")
def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pitman_yor.scored(table(spark, sf_dir, "documents"), ~held_out("doc_id", 5, 1))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learnable = ~held_out("doc_id", 5, 0) & F.col("doc_id").isNotNull()
    model = toxicity.fit(docs.where(learnable), labels.where(learnable))
    return toxicity.scored(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


@register("op13_suffix_array", oracles.REPEATS)
def op13_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixdedup.repeats(docs, length=400, digest=True).drop("spans")


@register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digest(periodic.periodic_runs(periodic.with_planted_periods(docs)))


@register("op11_conversation_repair", oracles.CONVERSATION)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repaired_digest(table(spark, sf_dir, "conversations"))
