"""Set operation identities (J01-J03), folder paths level by level
(A02), stream dedupe (L05)."""

import pytest
from pyspark.sql import functions as F

from pagesearch.operators import results as rs
from pagesearch.operators.folders import folder_paths
from pagesearch.plans.catalog import CATALOG
from pagesearch.schemas import LINKS, with_field
from pagesearch.streaming import ingest as si
from pagesearch.streaming.runner import drain, file_stream, write_parts
from tests.conftest import SF_SMALL, rows


def ids(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "doc_id long")


def test_set_identities(spark):
    a, b = ids(spark, [1, 2, 3, 5]), ids(spark, [2, 3, 4])
    every = ids(spark, range(1, 8))
    assert rows(rs.any_of([a, b])) == [(x,) for x in [1, 2, 3, 4, 5]]
    assert rows(rs.all_of([a, b])) == [(2,), (3,)]
    assert rows(rs.none_of(every, [a, b])) == [(6,), (7,)]
    # identities: A n B subset of A u B; none_of u any_of = all
    assert rs.all_of([a, b]).subtract(rs.any_of([a, b])).count() == 0
    assert rows(rs.none_of(every, [a, b]).union(rs.any_of([a, b]))) == rows(every)


def test_folder_paths_small_fixture(spark):
    got = CATALOG["folder_paths"](spark, SF_SMALL)
    leaves = got.where(F.col("url").isNotNull())
    assert leaves.count() == 50
    assert leaves.where(~F.col("path").startswith("bookmarks/")).count() == 0
    assert set(r.depth for r in got.select("depth").distinct().collect()) == {0, 1, 2}


def test_folder_paths_have_no_depth_limit(spark):
    chain = [("n0", None, None, "r")] + [(f"n{i}", f"n{i-1}", f"u{i}", f"x{i}") for i in range(1, 25)]
    nodes = spark.createDataFrame(chain + [("c1", "c2", None, "c"), ("c2", "c1", None, "c")], "node_id string, parent_id string, url string, name string")
    old = spark.conf.get("spark.sql.cteRecursionLevelLimit", None)
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "5")
    try:
        got = {r.node_id: (r.path, r.depth) for r in folder_paths(nodes).collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionLevelLimit") if old is None else spark.conf.set("spark.sql.cteRecursionLevelLimit", old)
    assert len(got) == 25 and got["n24"] == ("/".join(["r"] + [f"x{i}" for i in range(1, 25)]), 24)
    twice = spark.createDataFrame([("a", None, None, "a"), ("b", "a", None, "b"), ("b", "b", None, "b")], "node_id string, parent_id string, url string, name string")
    with pytest.raises(ValueError):
        folder_paths(twice)


def test_stream_dedupe_once_per_url(spark, tmp_path):
    links = spark.createDataFrame([("u1", "f", "", 1), ("u2", "f", "", 2), ("u1", "g", "", 3), ("u3", "f", "", 4),
                                   ("u2", "h", "", 5)], LINKS).withColumn("ts", F.timestamp_seconds("seq"))
    src = str(tmp_path / "src")
    write_parts([links.where(F.col("seq") <= 2), links.where(F.col("seq") > 2)], src)
    out = str(tmp_path / "out")
    stream = file_stream(spark, src, with_field(LINKS, "ts", __import__("pyspark.sql.types", fromlist=["T"]).TimestampType()))

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    drain(si.stream_dedupe(stream).writeStream.outputMode("append").foreachBatch(sink), str(tmp_path / "ck"))
    got = rows(spark.read.parquet(out), "url", "seq")
    assert got == [("u1", 1), ("u2", 2), ("u3", 4)]          # first arrival wins


def test_facets_top_n(spark):
    m = spark.createDataFrame([(1, i) for i in range(1, 8)], "query_id int, doc_id long")
    docs = spark.createDataFrame([(1, "en", 10), (2, "en", 600), (3, "fr", 700), (4, "de", 10),
                                  (5, "en", 10), (6, "fr", 3000), (7, None, 10)],
                                 "doc_id long, lang string, n_chars long")
    allb = {r.bucket: r.n for r in rs.facets(m, docs, terms={"lang": "lang"}).collect()}
    assert allb == {"en": 3, "fr": 2, "de": 1, None: 1}
    top = rows(rs.facets(m, docs, terms={"lang": "lang"}, bands={"n_chars": [0, 500, 1000, 5000]}, top_n=2),
               "facet", "bucket", "n")
    assert top == [("lang", "en", 3), ("lang", "fr", 2), ("n_chars", "0-500", 4), ("n_chars", "500-1000", 2)]


def test_highlight_marks_every_match_and_escapes(spark):
    hits = spark.createDataFrame([(1, 1, 10)], "query_id int, rank bigint, doc_id long")
    store = spark.createDataFrame([(10, 'a<b The the end "x" there')], "doc_id long, text string")
    qterms = spark.createDataFrame([(1, ["the"])], "query_id int, qterms array<string>")
    frag = rs.highlight(hits, store, qterms).first().fragment
    assert frag == 'a&lt;b <mark>The</mark> <mark>the</mark> end &quot;x&quot; there'
