"""Work of a refreshed and merged index that must not grow beyond its rows."""

from pagesearch.operators import index as ix
from pagesearch.plans import catalog  # noqa: F401  first, as the parts of the catalog import it
from pagesearch.plans import catalog_results as cr
from tests.conftest import rows
from tests.test_index_search import _plan
from tests.test_segments import built, documents, tables


def test_postings_are_cut_from_sorted_arrays_after_the_explode(spark):
    df = spark.createDataFrame([(1, "b a b c a b"), (2, ""), (3, None), (None, "a a"), (4, "z")], "doc_id long, text string")
    post = ix.build_index(df, {"text": "text"}).postings
    plan = _plan(post)
    assert "posexplode" in plan and plan.count("sort_array") == 1   # a second one would sort the tokens for each place
    assert rows(post.where("doc_id > 0"), "doc_id", "term", "tf", "positions", "field_len") == [
        (1, "a", 2, [1, 4], 6), (1, "b", 3, [0, 2, 5], 6), (1, "c", 1, [3], 6), (4, "z", 1, [0], 1)]
    assert [tuple(r) for r in post.where("doc_id is null").select("term", "tf", "positions").collect()] == [("a", 2, [0, 1])]


def test_postings_of_one_field_reach_the_write_in_order(spark):
    df = documents(spark, range(40), 1)
    one, two = ix.build_index(df, {"text": "text"}, co_locate=True), ix.build_index(df, {"text": "text", "more": "text"}, co_locate=True)
    sorts = lambda i: _plan(ix._postings_of(i, i.buckets).sortWithinPartitions("field", "doc_id", "term")).count("Sort [")
    assert sorts(one) == 2 and sorts(two) == 1
    assert rows(ix._postings_of(one, one.buckets), "doc_id", "term", "tf") == rows(one.postings, "doc_id", "term", "tf")


def test_many_replaced_documents_are_hashed_not_sorted(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    monkeypatch.setattr(ix, "fits", lambda df: False)
    monkeypatch.setattr(ix, "broadcast_if_small", lambda df: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ix.write_index(built(documents(spark, range(60), 1), co_locate=True), path)
        ix.refresh_index(spark, path, built(documents(spark, range(10, 70), 2)))
        plan = _plan(ix.read_index(spark, path).postings)
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert ix.merge_index(spark, path, everything=True) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    now = documents(spark, range(10), 1).union(documents(spark, range(10, 70), 2))
    assert tables(ix.read_index(spark, path)) == tables(built(now))


def test_index_merge_builds_the_refresh_in_the_buckets_of_the_index(spark, tmp_path, monkeypatch):
    docs = [(i, f"w{i % 7} cat cat") for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(0, 30, 3)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    sizes, found, build = iter([3, 5]), [], ix.build_index

    def spy(*args, **how):
        with monkeypatch.context() as m:
            m.setattr(ix, "expand_partitions", lambda df, n=next(sizes): n)
            found.append(build(*args, **how))
        return found[-1]
    monkeypatch.setattr(cr, "build_index", spy)
    out = cr.q_index_merge(spark, str(tmp_path))
    assert [i.buckets for i in found] == [3, 3]                     # other buckets: all new postings shuffled
    want = {(i, t, n) for i, _ in docs for t, n in [(f"w{i % 7}", 1), ("cat", 2)]}
    want |= {(i, t, 1) for i in range(0, 30, 3) for t in ("quality", str(i % 2))}
    df = {t: sum(1 for _, u, _ in want if u == t) for _, t, _ in want}
    assert rows(out, "doc_id", "field", "term", "tf", "df") == sorted((i, "text", t, n, df[t]) for i, t, n in want)
