"""Links arriving as files are ingested and indexed incrementally.

Each micro-batch runs, as Spark jobs: de-duplication inside the batch (H02),
the anti join against what is stored (E01), the whole ingest row (C10), an
append of the new store rows, and a segment of the index with their postings.
The store is log-structured: every batch writes its own folder and readers
keep, per key, the rows of the latest batch (the upsert A06 at read time).  The
index gets a segment a batch (A07), and small segments are merged.  No batch
rewrites what earlier batches wrote.

A batch is committed by its log row, written last.  Readers take committed
batches only, and a batch looks only at those before it, never at its own
folder; so a batch that is run again, also after a crash between its writes,
finds the same links unseen and overwrites its folders with the same rows.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesearch.operators import ingest as ing
from pagesearch.operators.index import Index, build_index, has_version, merge_index, read_index, refresh_index, stored_buckets, write_index
from pagesearch.schemas import STORE
from pagesearch.streaming.runner import drain, file_stream

INDEX_FIELDS = ["title", "text", "excerpt", "folder", "url"]

# Segments that a merge between batches joins at least: pairwise merges would
# write the postings of every batch again with each batch after it.
MERGE_LEAST = 3


def last_committed(spark: SparkSession, root: str) -> int:
    """The highest committed batch, -1 if there is none.  Batches run one after
    another, so all below it are committed too."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(root, "log"))
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return -1
    names = [s.getPath().getName() for s in fs.listStatus(jpath)]
    for batch in sorted((int(n[6:]) for n in names if n.startswith("batch=")), reverse=True):
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(jpath, f"batch={batch}/_SUCCESS")):
            return batch
    return -1


def read_log(spark: SparkSession, root: str, dataset: str, key: str) -> DataFrame | None:
    """Rows of the latest committed batch per key of a log-structured dataset."""
    upto = last_committed(spark, root)
    if upto < 0:
        return None
    df = (spark.read.parquet(os.path.join(root, dataset)).withColumn("batch", F.col("batch").cast("bigint"))
          .where(F.col("batch") <= upto))
    latest = df.groupBy(key).agg(F.max("batch").alias("batch"))
    return df.join(latest, [key, "batch"], "left_semi")


def current_store(spark: SparkSession, root: str, seed: DataFrame | None = None) -> DataFrame:
    logged = read_log(spark, root, "store", "url")
    base = seed if seed is not None else spark.createDataFrame([], STORE)
    if logged is None:
        return base.select(*STORE.fieldNames())
    logged = logged.select(*STORE.fieldNames())
    return base.join(logged.select("url"), "url", "left_anti").select(*STORE.fieldNames()).unionByName(logged)


def stored_urls(spark: SparkSession, root: str, before: int, seed: DataFrame | None = None) -> DataFrame:
    """Every URL stored by the seed and by batches below ``before``: enough for
    the E01 check, with no per-key aggregation over the store."""
    base = (seed if seed is not None else spark.createDataFrame([], STORE)).select("url")
    if last_committed(spark, root) < 0:
        return base
    logged = spark.read.schema("url string, batch bigint").parquet(os.path.join(root, "store"))
    return base.unionByName(logged.where(F.col("batch") < before).select("url"))


def current_index(spark: SparkSession, root: str) -> Index | None:
    """The stored index over everything committed so far, to be searched by
    ``url``; None before the first batch with documents."""
    upto, path = last_committed(spark, root), os.path.join(root, "index")
    return read_index(spark, path, upto) if upto >= 0 and has_version(spark, path, upto) else None


def current_postings(spark: SparkSession, root: str) -> DataFrame | None:
    index = current_index(spark, root)
    return None if index is None else index.postings


def index_batch(spark: SparkSession, new: DataFrame, batch_id: int, root: str) -> None:
    """One segment with the batch's documents on top of the version that
    the batch before left, in the buckets that the index has; then small
    segments are merged, ``MERGE_LEAST`` of them or more.  A batch that is run
    again starts from that version again, and its later version wins."""
    path = os.path.join(root, "index")
    again = has_version(spark, path, batch_id - 1)
    index = build_index(new, {f: f for f in INDEX_FIELDS}, key="url", co_locate=True,
                        buckets=stored_buckets(spark, path, batch_id - 1) if again else None)
    if again:
        refresh_index(spark, path, index, tag=batch_id, base=batch_id - 1)
        merge_index(spark, path, tag=batch_id, least=MERGE_LEAST)
    else:
        write_index(index, path, tag=batch_id)


def ingest_batch(spark: SparkSession, links: DataFrame, batch_id: int, root: str,
                 captures: DataFrame, profiles: DataFrame, seed: DataFrame | None = None,
                 force: bool = False) -> None:
    """One micro-batch: L02 ingest of unseen links, L03 index of the new
    documents; a log row (L04) records what the batch did."""
    stored = stored_urls(spark, root, batch_id, seed)
    new = ing.build_store(spark, links, captures, profiles, store=stored, force=force)
    # the batch id is the partition folder name (batch=N), not a data column
    new.write.mode("overwrite").parquet(os.path.join(root, "store", f"batch={batch_id}"))
    written = spark.read.parquet(os.path.join(root, "store", f"batch={batch_id}"))
    n_new = written.count()
    if n_new:
        index_batch(spark, written, batch_id, root)
    log = spark.createDataFrame([(links.count(), n_new)], "n_links bigint, n_new_docs bigint")
    log.write.mode("overwrite").parquet(os.path.join(root, "log", f"batch={batch_id}"))


def stream_ingest(spark: SparkSession, links_dir: str, root: str, captures: DataFrame,
                  profiles: DataFrame, seed: DataFrame | None = None, fmt: str = "parquet",
                  force: bool = False, timeout_s: int | None = None, max_files: int | None = 1) -> DataFrame:
    """Run the file stream of links to completion.  Micro-batches
    run one after another, never two at once (single flight); each takes up
    to ``max_files`` pending files in arrival order (``None``: all files
    pending at its start, so arrivals in between coalesce into one batch).
    Returns the final store."""
    from pagesearch.schemas import LINKS
    stream = file_stream(spark, links_dir, LINKS, fmt, max_files)

    def each(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(spark, batch, batch_id, root, captures, profiles, seed, force)

    drain(stream.writeStream.foreachBatch(each), os.path.join(root, "_checkpoint"), timeout_s)
    return current_store(spark, root, seed)


def stream_dedupe(links: DataFrame, delay: str = "30 days") -> DataFrame:
    """A URL repeated in the stream goes through once.  Event time is
    ``ts``; state for a URL is kept for ``delay`` after its first row."""
    return (links.withColumn("ts", F.col("ts").cast("timestamp"))
            .withWatermark("ts", delay)
            .dropDuplicatesWithinWatermark(["url"]))
