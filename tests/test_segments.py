"""Segments of a stored index: refreshed and merged ones equal a rebuild."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pagesearch.operators import index as ix
from pagesearch.operators import search as se
from pagesearch.sources import fixtures as fx
from tests.conftest import rows
from tests.test_index_search import _plan, clause

SCHEMA = "doc_id long, text string, size long"
CLAUSES = [clause(1, 1, "should", "term", ["a"]), clause(2, 1, "must", "match", ["b c"]), clause(3, 1, "must", "prefix", ["w1"]),
           clause(4, 1, "must", "match_phrase", ["a b"]), clause(5, 1, "must", "numeric_range", None, "size", min=10.0, max=60.0),
           clause(6, 1, "must_not", "term", ["a"]), clause(7, 1, "must", "all", None, None), clause(8, 1, "should", "match", ["w12"], fuzziness=1)]


def documents(spark, ids, seed):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(rng.choices(["a", "b", "c", *[f"w{k}" for k in range(30)]], k=rng.randint(0, 12))), rng.randint(0, 100)) for i in ids], SCHEMA)


def built(df, **how):
    return ix.build_index(df, {"text": "text"}, attrs={"size": "size"}, **how)


def tables(index):
    return {"postings": rows(index.postings.select("doc_id", "field", "term", "tf", F.col("positions").cast("string"), "field_len")),
            "term_df": rows(index.term_df, "field", "term", "df"), "field_len": rows(index.field_len, "doc_id", "field", "n_terms"),
            "corpus": [(f, n, pytest.approx(a)) for f, n, a in rows(index.corpus, "field", "n_docs", "avg_len")],
            "docs": rows(index.docs, "doc_id", "field", "value"), "ids": rows(index.ids, "doc_id")}


def found(spark, index):
    return [(q, d, round(s, 9)) for q, d, s in rows(se.search_scores(index, fx.clauses(spark, CLAUSES)), "query_id", "doc_id", "score")]


def test_refreshed_and_merged_index_equals_rebuild(spark, tmp_path):
    path = str(tmp_path / "i")
    now = {i: r for i, r in ((r.doc_id, r) for r in documents(spark, range(200), 1).collect())}
    ix.write_index(built(documents(spark, range(200), 1), co_locate=True), path)
    for step, ids in enumerate([range(70, 85), [3, 4, 84, 90], [3], range(60, 75)]):
        new = documents(spark, ids, 10 + step)
        now |= {r.doc_id: r for r in new.collect()}
        ix.refresh_index(spark, path, built(new))
        rebuilt = built(spark.createDataFrame(list(now.values()), SCHEMA))
        stored = ix.read_index(spark, path)
        assert tables(stored) == tables(rebuilt)
        if step in (1, 3):
            want = found(spark, rebuilt)
            assert found(spark, stored) == want and len(want) > 50
    before = ix.read_index(spark, path)
    assert ix.merge_index(spark, path) == 4                       # all but the first, large one
    assert len(ix._version_meta(spark, path)["segments"]) == 2
    merged = ix.read_index(spark, path)
    assert tables(merged) == tables(rebuilt) and found(spark, merged) == want
    assert ix.merge_index(spark, path) == 0
    ix.refresh_index(spark, path, built(documents(spark, [1, 300], 30)))
    now |= {r.doc_id: r for r in documents(spark, [1, 300], 30).collect()}
    assert ix.merge_index(spark, path, everything=True) == 3
    whole = ix.read_index(spark, path)
    assert tables(whole) == tables(built(spark.createDataFrame(list(now.values()), SCHEMA)))
    assert tables(before) == tables(rebuilt)                      # readers keep what they opened


def _bytes(path, part):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f"/{part}" in d + "/" and f.endswith(".parquet"))


def test_refresh_of_few_documents_writes_little(spark, tmp_path):
    path = str(tmp_path / "i")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.col("n_chars").alias("size"))
    ix.write_index(built(docs, co_locate=True), path)
    ix.refresh_index(spark, path, built(docs.where("doc_id % 100 = 7").withColumn("text", F.concat("text", F.lit(" again")))))
    assert rows(ix.read_index(spark, path).term_df.where("term = 'again'"), "df")[0][0] >= docs.where("doc_id % 100 = 7").count()
    rows_of = lambda n: spark.read.parquet(f"{path}/postings/seg={n}").count()
    assert rows_of(2) < 0.03 * rows_of(1)


def test_merge_shuffles_no_postings_and_scan_stays_bucketed(spark, tmp_path):
    path = str(tmp_path / "i")
    ix.write_index(built(documents(spark, range(50), 1), co_locate=True), path)
    ix.refresh_index(spark, path, built(documents(spark, range(40, 60), 2)))
    stored = ix.read_index(spark, path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(se.clause_hits(fx.clauses(spark, CLAUSES[:1]), stored))
        # the one exchange is that of the replaced documents, before their broadcast
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
        assert "partial_max(seg" in plan[plan.index("Exchange hashpartitioning"):].split("\n")[1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_segments_that_are_due():
    assert ix._merge_from([100, 10, 10]) == 1 and ix._merge_from([1000, 10]) == 2
    assert ix._merge_from([30, 10]) == 0 and ix._merge_from([110, 20, 5, 1, 1]) == 1 and ix._merge_from([5]) == 1


def test_an_incomplete_segment_is_passed_over(spark, tmp_path):
    path = str(tmp_path / "i")
    ix.write_index(built(documents(spark, range(10), 1), co_locate=True), path)
    want = tables(ix.read_index(spark, path))
    # a refresh that stopped before its version was complete
    spark.createDataFrame([(1,)], "doc_id long").write.parquet(f"{path}/ids/seg=2")
    assert tables(ix.read_index(spark, path)) == want and ix._next_segment(spark, path) == 3


# ---------------------------------------------------------------- pages

@pytest.fixture(scope="module")
def corpus(spark):
    from pagesearch.plans.corpus import documents_index
    return documents_index(spark, "/root/testdata/sf0.01")


def test_pages_without_totals_equal_the_ranked_list_and_skip_buckets(spark, corpus):
    terms = [r.term for r in corpus.term_df.where("length(term) >= 4").orderBy(F.col("df").desc(), "term").limit(30).collect()]
    rare = [r.term for r in corpus.term_df.where("df between 3 and 6").orderBy("term").limit(10).collect()]
    cls = [clause(i, 1, "should", "term", [t]) for i, t in enumerate(terms + rare)]
    cls += [clause(50, 1, "should", "match", [" ".join(rare[:3])]), clause(51, 1, "must", "term", [terms[0]]), clause(51, 2, "must_not", "term", [terms[1]]),
            clause(52, 1, "must", "match_phrase", [f"{terms[0]} {terms[1]}"]), clause(53, 1, "must", "numeric_range", None, "n_chars", min=100.0),
            clause(54, 1, "must_not", "term", [terms[0]]), clause(55, 1, "should", "prefix", [terms[0][:2]]), clause(55, 2, "must", "term", [rare[0]])]
    cl = fx.clauses(spark, cls)
    want = se.search(corpus, cl, size=3).drop("total_hits")
    got, decided = se.search_leaders(corpus, cl, size=3)
    assert rows(got) == rows(want) and got.count() > 60
    assert decided.where("NOT scored").count() > 20


def test_bounds_are_bounds(spark, corpus):
    cl = se.with_implicit_all(fx.clauses(spark))
    batch = se.batch_of(cl)
    qterms = se.query_terms(cl, corpus, batch)
    bounds = se.bucket_bounds(cl, corpus, qterms, batch)
    top = (se.search_scores(corpus, fx.clauses(spark), fx.query_opts(spark)).withColumn("bucket", F.pmod(F.hash("doc_id"), F.lit(corpus.buckets)))
           .groupBy("query_id", "bucket").agg(F.max("score").alias("top")))
    j = top.join(bounds, ["query_id", "bucket"], "left")
    assert j.where("bound IS NULL OR top > bound * (1 + 1e-9) + 1e-9").count() == 0 and j.count() > 50


def test_totals_and_pages_come_from_one_pass(spark, corpus):
    m = se.search_scores(corpus, fx.clauses(spark), fx.query_opts(spark))
    page = se.topk(m, None, size=4)
    totals = {r.query_id: r["count"] for r in m.groupBy("query_id").count().collect()}
    assert {r.query_id: r.total_hits for r in page.collect()} == totals
    assert _plan(page).count("MapInArrow") >= 1


def test_ties_and_text_keys_in_pages(spark):
    m = spark.createDataFrame([(q, f"d{i:03d}", 1.0 if i % 2 else 0.5) for q in (1, 2) for i in range(50)], "query_id int, doc_id string, score double").repartition(7)
    got = rows(se.topk(m, None, size=3, from_=24), "query_id", "rank", "doc_id", "total_hits")
    assert got == [(q, r, d, 50) for q in (1, 2) for r, d in ((25, "d049"), (26, "d000"), (27, "d002"))]
