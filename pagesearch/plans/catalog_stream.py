"""Catalog entries for the streaming jobs (L01-L05).  Each entry writes its
input files into a fresh folder under the shared checkpoint location, runs
the stream to completion with its own checkpoint and returns the read-back
result as a plain DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from pagesearch.functions.scoring import rounded
from pagesearch.operators import search as se
from pagesearch.operators.language import train_profiles
from pagesearch.plans.catalog import register
from pyspark.sql import types as T

from pagesearch.plans.catalog_results import INGESTED_CLAUSES
from pagesearch.schemas import LINKS, with_field
from pagesearch.session import shared_dir
from pagesearch.sources import fixtures as fx
from pagesearch.sources.tables import table
from pagesearch.streaming import ingest as si
from pagesearch.streaming.runner import drain, file_stream, write_parts
from pagesearch.streaming.ticks import run_change_ticks

N_FILES = 3


def _links_files(spark, sf, with_ts: bool = False) -> str:
    links = fx.links(spark, sf)
    if with_ts:
        links = links.withColumn("ts", F.timestamp_seconds("seq"))
    path = shared_dir(spark, "links-stream")
    write_parts([links.where(F.col("seq") % N_FILES == i) for i in range(N_FILES)], path)
    return path


def _profiles(spark, sf):
    path = shared_dir(spark, "profiles")
    train_profiles(table(spark, sf, "documents")).write.parquet(path)
    return spark.read.parquet(path)


def _ingest(spark, sf) -> str:
    root = shared_dir(spark, "ingest")
    si.stream_ingest(spark, _links_files(spark, sf), root, fx.captures(spark, sf), _profiles(spark, sf))
    return root


@register("change_ticks")
def q_change_ticks(spark, sf):
    ev = fx.change_events(spark, sf).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    q1, q2 = ev.approxQuantile("us", [1 / 3, 2 / 3], 0.001)
    src = shared_dir(spark, "ticks-src")
    parts = [ev.where(F.col("us") < q1), ev.where((F.col("us") >= q1) & (F.col("us") < q2)),
             ev.where(F.col("us") >= q2)]
    write_parts([p.drop("us") for p in parts], src)
    schema = fx.change_events(spark, sf).schema
    return run_change_ticks(spark, src, shared_dir(spark, "ticks-out"), shared_dir(spark, "ticks-ckpt"), schema)


@register("stream_ingest")
def q_stream_ingest(spark, sf):
    root = _ingest(spark, sf)
    return si.current_store(spark, root).select(
        "url", "lang", "title", "text", "excerpt", "author", "site_name", "folder")


@register("stream_index")
def q_stream_index(spark, sf):
    root = _ingest(spark, sf)
    return si.current_postings(spark, root).select(F.col("doc_id").alias("url"), "field", "term", "tf")


@register("search_ingested")
def q_search_ingested(spark, sf):
    """Links to store to index to search: the batch over what the stream ingested."""
    index = si.current_index(spark, _ingest(spark, sf))
    m = se.search_scores(index, fx.clauses(spark, INGESTED_CLAUSES))
    return m.select("query_id", F.col("doc_id").alias("url"), rounded(F.col("score")).alias("score"))


@register("single_flight")
def q_single_flight(spark, sf):
    root = _ingest(spark, sf)
    log = spark.read.parquet(os.path.join(root, "log"))
    return log.select(F.col("batch").cast("bigint").alias("batch"), "n_links", "n_new_docs")


@register("stream_dedupe")
def q_stream_dedupe(spark, sf):
    src = _links_files(spark, sf, with_ts=True)
    out = shared_dir(spark, "dedupe-out")
    stream = file_stream(spark, src, with_field(LINKS, "ts", T.TimestampType()))

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    drain(si.stream_dedupe(stream).writeStream.outputMode("append").foreachBatch(sink),
          shared_dir(spark, "dedupe-ckpt"))
    return spark.read.parquet(out).select("url")
