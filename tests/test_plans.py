"""Plan properties the scale design relies on."""

import re

from pyspark.sql import functions as F

from pagesearch.operators import index as ix
from pagesearch.operators.analyze import analyze
from pagesearch.operators.language import detect_lang, train_profiles
from pagesearch.session import expand_partitions, materialize
from pagesearch.sources.tables import table
from tests.conftest import SF_SMALL


def _plan(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_postings_and_lengths_are_made_in_the_row(spark):
    docs = table(spark, SF_SMALL, "documents")
    index = ix.build_index(docs, {"text": "text"})
    for df in (index.postings, index.field_len):
        assert "Exchange" not in _plan(spark, df)
    plan = _plan(spark, ix.build_index(docs, {"text": "text"}, co_locate=True).postings)
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(exchanges) == 1 and exchanges[0].startswith("doc_id")     # of the documents, for a stored index
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_detection_and_analysis_shuffle_no_text(spark):
    docs = table(spark, SF_SMALL, "documents")
    detected = _plan(spark, detect_lang(docs, train_profiles(docs), ["doc_id"]))
    for line in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", detected):
        assert "term" not in line and line.startswith("doc_id")
    assert "Exchange" not in _plan(spark, analyze(docs, {"text": "text"}, {}))


def test_exchange_size_from_input_files(spark):
    docs = table(spark, SF_SMALL, "documents")
    n = expand_partitions(docs)
    assert n >= 2 * spark.sparkContext.defaultParallelism
    spark.conf.set("pagesearch.bytesPerTask", "1024")
    try:
        assert expand_partitions(docs) > n
    finally:
        spark.conf.unset("pagesearch.bytesPerTask")


def test_a_task_sorts_postings_of_a_few_megabytes(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(12_000_000).select(F.xxhash64("id").alias("doc_id")).write.parquet(path)      # about 96 MB
    size = sum(f.stat().st_size for f in (tmp_path / "wide").glob("*.parquet"))
    assert size > 90_000_000 and size / expand_partitions(spark.read.parquet(path)) <= 8 * 1024 * 1024


def test_materialize_writes_under_checkpoint_dir(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    df = materialize(spark.range(5), "unit")
    assert df.count() == 5
    from urllib.parse import urlparse
    assert all(urlparse(f).path.startswith(root.rstrip("/") + "/") for f in df.inputFiles())
