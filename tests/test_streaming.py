"""Streaming equals batch, restart from checkpoint, late rows dropped."""

import os

import pytest
from pyspark.sql import functions as F

from pagesearch.operators import ingest as ing
from pagesearch.operators import language as lg
from pagesearch.sources import fixtures as fx
from pagesearch.sources.tables import table
from pagesearch.streaming import ingest as si
from pagesearch.streaming.runner import write_parts
from pagesearch.streaming.ticks import change_ticks, run_change_ticks
from tests.conftest import SF_SMALL, rows


def test_ticks_late_row_dropped(spark, tmp_path):
    schema = "ts string, kind string"
    early = spark.createDataFrame([("2024-01-01 00:00:05", "write"), ("2024-01-01 00:00:25", "create"),
                                   ("2024-01-01 00:00:40", "chmod")], schema)
    later = spark.createDataFrame([("2024-01-01 01:00:00", "write")], schema)
    later2 = spark.createDataFrame([("2024-01-01 01:00:05", "chmod")], schema)
    late = spark.createDataFrame([("2024-01-01 00:00:10", "write")], schema)   # behind the watermark
    src = str(tmp_path / "src")
    # Spark drops a row as late against the watermark of the batch before,
    # so one more on-time file comes between the jump and the late row.
    parts = [d.withColumn("ts", F.to_timestamp_ntz("ts")) for d in (early, later, later2, late)]
    write_parts(parts, src)
    out = run_change_ticks(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), parts[0].schema,
                           delay="1 minute")
    assert rows(out, "window_start", "n_events") == [(1704067200, 2), (1704070800, 1)]


def test_ticks_batch_twin(spark):
    ev = fx.change_events(spark, SF_SMALL)
    n = change_ticks(ev).agg(F.sum("n_events")).first()[0]
    assert n == ev.where(F.col("kind").isin("write", "create")).count()


def test_stream_equals_batch_and_restart(spark, tmp_path):
    links = fx.links(spark, SF_SMALL)
    caps = fx.captures(spark, SF_SMALL)
    prof = lg.train_profiles(table(spark, SF_SMALL, "documents")).cache()
    src = str(tmp_path / "links")
    write_parts([links.where(F.col("seq") % 3 == i) for i in range(3)], src)
    root = str(tmp_path / "root")
    out = si.stream_ingest(spark, src, root, caps, prof)
    # batch twin: one batch job over the files in arrival order
    ordered = links.withColumn("seq2", (F.col("seq") % 3) * F.lit(10 ** 9) + F.col("seq"))
    first = ing.dedupe(ordered.drop("seq").withColumnRenamed("seq2", "seq"), "first")
    batch = ing.build_store(spark, first, caps, prof)
    cols = ["url", "lang", "title", "text", "folder"]
    assert rows(out, *cols) == rows(batch, *cols)
    log1 = spark.read.parquet(os.path.join(root, "log")).count()
    assert log1 == 3                       # one micro-batch per file, one after another
    # restart with the same checkpoint: nothing is processed again
    again = si.stream_ingest(spark, src, root, caps, prof)
    assert spark.read.parquet(os.path.join(root, "log")).count() == log1
    assert rows(again, *cols) == rows(out, *cols)
    # index of the stream equals a rebuild over the final store
    from pagesearch.operators.index import build_index
    full = build_index(out, {f: f for f in si.INDEX_FIELDS}, key="url").postings
    inc = si.current_postings(spark, root)
    assert rows(inc, "doc_id", "field", "term", "tf") == rows(full, "doc_id", "field", "term", "tf")


def test_pending_files_coalesce_into_one_batch(spark, tmp_path):
    links = fx.links(spark, SF_SMALL)
    caps = fx.captures(spark, SF_SMALL)
    prof = lg.train_profiles(table(spark, SF_SMALL, "documents")).cache()
    src = str(tmp_path / "links")
    write_parts([links.where(F.col("seq") % 3 == i) for i in range(3)], src)
    root = str(tmp_path / "root")
    out = si.stream_ingest(spark, src, root, caps, prof, max_files=None)
    log = spark.read.parquet(os.path.join(root, "log")).collect()
    assert len(log) == 1 and log[0].n_links == links.count()
    batch = ing.build_store(spark, links, caps, prof)
    assert rows(out, "url", "title") == rows(batch, "url", "title")


def test_a_batch_run_again_or_after_a_crash_loses_nothing(spark, tmp_path, monkeypatch):
    links, caps = fx.links(spark, SF_SMALL), fx.captures(spark, SF_SMALL)
    prof = lg.train_profiles(table(spark, SF_SMALL, "documents")).cache()
    first, second = links.where(F.col("seq") % 2 == 0), links.where(F.col("seq") % 2 == 1)
    root = str(tmp_path / "root")
    si.ingest_batch(spark, first, 0, root, caps, prof)
    store, postings = rows(si.current_store(spark, root), "url", "title"), rows(si.current_postings(spark, root), "doc_id", "field", "term", "tf")
    assert store
    si.ingest_batch(spark, first, 0, root, caps, prof)          # the same batch again
    assert rows(si.current_store(spark, root), "url", "title") == store
    assert rows(si.current_postings(spark, root), "doc_id", "field", "term", "tf") == postings

    def crash(*args, **kw):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:                             # between store and postings
        m.setattr(si, "build_index", crash)
        with pytest.raises(RuntimeError):
            si.ingest_batch(spark, second, 1, root, caps, prof)
    assert rows(si.current_store(spark, root), "url", "title") == store
    si.ingest_batch(spark, second, 1, root, caps, prof)
    whole = ing.build_store(spark, links.withColumn("seq", F.col("seq") % 2 * 10**9 + F.col("seq")), caps, prof)
    assert rows(si.current_store(spark, root), "url", "title") == rows(whole, "url", "title")


def test_a_crash_in_the_first_batch(spark, tmp_path, monkeypatch):
    links, caps = fx.links(spark, SF_SMALL), fx.captures(spark, SF_SMALL)
    prof = lg.train_profiles(table(spark, SF_SMALL, "documents")).cache()
    root = str(tmp_path / "root")
    with monkeypatch.context() as m:
        m.setattr(si, "build_index", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            si.ingest_batch(spark, links, 0, root, caps, prof)
    assert si.current_postings(spark, root) is None and si.current_store(spark, root).count() == 0
    si.ingest_batch(spark, links, 0, root, caps, prof)
    assert si.current_store(spark, root).count() == ing.build_store(spark, links, caps, prof).count()
