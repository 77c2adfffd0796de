"""Index build and search on hand-made rows: positions, phrases at the
edges, boolean rules, expansion properties, paging and plan shape."""

import dataclasses
import math

import pytest
from pyspark.sql import functions as F

from pagesearch.operators import index as ix
from pagesearch.operators import results as rs
from pagesearch.operators import search as se
from pagesearch.sources import fixtures as fx
from tests.conftest import rows

DOCS = [
    (1, "The cat sat on the mat.", 120),
    (2, "Cats and dogs; the dog barks.", 1500),
    (3, "in the beginning of time", 1999),
    (4, "one", 2000),
    (5, "end of the end", 10),
    (6, "", 0),
]


def clause(q, c, occur, kind, terms=None, field="text", **kw):
    return (q, c, occur, kind, field, terms, kw.get("min"), kw.get("max"), kw.get("incl_min"),
            kw.get("incl_max"), kw.get("fuzziness"), kw.get("prefix_length"), kw.get("boost", 1.0))


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, n_chars long")
    return ix.build_index(df, {"text": "text"}, attrs={"n_chars": "n_chars"})


def run(spark, index, clauses, opts=None):
    cl = fx.clauses(spark, clauses)
    o = fx.query_opts(spark, opts) if opts else None
    return se.search_scores(index, cl, o)


def test_tokens_and_positions(spark):
    df = spark.createDataFrame([(1, "Hello, World! héllo 42")], "doc_id long, text string")
    got = rows(ix.tokenize(df, {"text": "text"}), "pos", "term")
    assert got == [(0, "hello"), (1, "world"), (2, "héllo"), (3, "42")]


def test_postings_and_stats(spark, index):
    p = {(r.doc_id, r.term): (r.tf, list(r.positions), r.field_len) for r in index.postings.collect()}
    assert p[(1, "the")] == (2, [0, 4], 6)
    assert p[(5, "end")] == (2, [0, 3], 4)
    assert rows(index.corpus, "field", "n_docs") == [("text", 5)]     # empty doc has no tokens
    df = {r.term: r.df for r in index.term_df.collect()}
    assert df["the"] == 4


def test_term_score_formula(spark, index):
    got = {r.doc_id: r.score for r in run(spark, index, [clause(1, 1, "should", "term", ["cat"])]).collect()}
    idf = 1 + math.log(5 / (1 + 1))
    assert got.keys() == {1}
    assert got[1] == pytest.approx(math.sqrt(1) * idf / math.sqrt(6))


def test_phrase_at_first_and_last_position(spark, index):
    first = run(spark, index, [clause(1, 1, "should", "match_phrase", ["in the"])])
    last = run(spark, index, [clause(1, 1, "should", "match_phrase", ["the end"])])
    assert rows(first, "doc_id") == [(3,)]
    assert rows(last, "doc_id") == [(5,)]


def test_phrase_gap(spark, index):
    got = run(spark, index, [clause(1, 1, "should", "phrase", ["end", None, "the"])])
    assert rows(got, "doc_id") == [(5,)]                          # end of the end
    got = run(spark, index, [clause(1, 1, "should", "phrase", ["the", None, "on"])])
    assert rows(got, "doc_id") == []
    got = run(spark, index, [clause(1, 1, "should", "phrase", ["cat", None, "on"])])
    assert rows(got, "doc_id") == [(1,)]


def test_only_negative_query_is_all_minus(spark, index):
    got = run(spark, index, [clause(1, 1, "must_not", "term", ["the"])])
    assert rows(got, "doc_id") == [(4,), (6,)]


def test_min_should_edges(spark, index):
    cls = [clause(1, 1, "should", "term", ["the"]), clause(1, 2, "should", "term", ["end"]),
           clause(1, 3, "should", "term", ["of"])]
    zero = run(spark, index, cls, [(1, 0, 10, 0)])
    two = run(spark, index, cls, [(1, 2, 10, 0)])
    three = run(spark, index, cls, [(1, 3, 10, 0)])
    assert rows(zero, "doc_id") == [(1,), (2,), (3,), (5,)]      # 0 alone = at least one
    assert rows(two, "doc_id") == [(3,), (5,)]
    assert rows(three, "doc_id") == [(5,)]
    must = cls + [clause(1, 4, "must", "term", ["one"])]
    assert rows(run(spark, index, must, [(1, 0, 10, 0)]), "doc_id") == [(4,)]   # should optional


def test_fuzzy_zero_is_exact_and_prefix_length(spark, index):
    exact = run(spark, index, [clause(1, 1, "should", "term", ["cat"])])
    fz0 = run(spark, index, [clause(1, 1, "should", "match", ["cat"], fuzziness=0)])
    assert rows(exact) == rows(fz0)
    fz1 = run(spark, index, [clause(1, 1, "should", "match", ["cat"], fuzziness=1)])
    assert rows(fz1, "doc_id") == [(1,), (2,)]                      # cat, cats
    fzp = run(spark, index, [clause(1, 1, "should", "match", ["bat"], fuzziness=1, prefix_length=1)])
    assert rows(fzp, "doc_id") == []


def test_empty_prefix_matches_every_term(spark, index):
    vocab = index.term_df.count()
    q = fx.clauses(spark, [clause(1, 1, "should", "prefix", [""])])
    assert se.expand_terms(q, index).count() == vocab


def test_wildcard(spark, index):
    got = run(spark, index, [clause(1, 1, "should", "wildcard", ["d?g*"])])
    assert rows(got, "doc_id") == [(2,)]


def test_ranges_open_and_flags(spark, index):
    r = run(spark, index, [clause(1, 1, "must", "numeric_range", None, "n_chars", min=1500.0, max=2000.0)])
    assert rows(r, "doc_id") == [(2,), (3,)]
    r = run(spark, index, [clause(1, 1, "must", "numeric_range", None, "n_chars", min=1500.0, max=2000.0,
                                  incl_min=False, incl_max=True)])
    assert rows(r, "doc_id") == [(3,), (4,)]
    r = run(spark, index, [clause(1, 1, "must", "numeric_range", None, "n_chars", max=100.0)])
    assert rows(r, "doc_id") == [(5,), (6,)]


def test_ids_and_all(spark, index):
    r = run(spark, index, [clause(1, 1, "must", "ids", ["2", "4", "x"], None)])
    assert rows(r, "doc_id") == [(2,), (4,)]
    r = run(spark, index, [clause(1, 1, "must", "all", None, None)])
    assert r.count() == 6


def test_empty_clause_table(spark, index):
    assert run(spark, index, []).count() == 0


def test_paging_is_a_slice_of_one_list(spark):
    from pagesearch.plans.corpus import documents_index
    idx = documents_index(spark, "/root/testdata/sf0.001")
    m = se.search_scores(idx, fx.clauses(spark).where("query_id = 3"), fx.query_opts(spark))
    full = se.topk(m, None, size=30).orderBy("rank").collect()
    page = se.topk(m, None, size=10, from_=10).orderBy("rank").collect()
    assert [r.doc_id for r in page] == [r.doc_id for r in full[10:20]]
    single = se.top_hits(m, size=10, from_=10).collect()
    assert [r.doc_id for r in single] == [r.doc_id for r in full[10:20]]


def test_phrase_hits_subset_of_match_hits(spark):
    from pagesearch.plans.corpus import documents_index
    idx = documents_index(spark, "/root/testdata/sf0.001")
    ph = run(spark, idx, [clause(1, 1, "must", "match_phrase", ["in the"])])
    mt = run(spark, idx, [clause(1, 1, "must", "match", ["in"]), clause(1, 2, "must", "match", ["the"])])
    assert ph.select("doc_id").subtract(mt.select("doc_id")).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark, index):
    cl = fx.clauses(spark, [clause(1, 1, "should", "term", ["the"])])
    m = se.search_scores(index, cl)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        topk_plan = _plan(se.topk(m, None, size=3))
        assert "WindowGroupLimit" in topk_plan
        assert "TakeOrderedAndProject" in _plan(se.top_hits(m, 3))
        assert "BroadcastHashJoin" in _plan(m)
        for p in (topk_plan, _plan(m)):
            assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_replace_docs_equals_rebuild(spark):
    a = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    b = spark.createDataFrame([(2, "e f g")], "doc_id long, text string")
    old = ix.build_index(a, {"text": "text"}).postings
    new = ix.build_index(b, {"text": "text"}).postings
    both = spark.createDataFrame([(1, "a b"), (2, "e f g")], "doc_id long, text string")
    full = ix.build_index(both, {"text": "text"}).postings
    cols = ["doc_id", "term", "tf"]
    assert rows(ix.replace_docs(old, new), *cols) == rows(full, *cols)


def test_all_field_offsets(spark):
    df = spark.createDataFrame([(1, "a b", "c")], "doc_id long, t1 string, t2 string")
    arr = ix.token_arrays(df, {"t1": "t1", "t2": "t2"}, all_field="_all")
    got = rows(ix.explode_tokens(arr).where(F.col("field") == "_all"), "pos", "term")
    assert got == [(0, "a"), (1, "b"), (2, "c")]


def test_stored_index_scoring_without_shuffle(spark, index, tmp_path):
    """On the stored, doc-bucketed index, the term list reaches the Parquet
    scan and per-document scoring runs without any exchange."""
    path = str(tmp_path / "idx")
    ix.write_index(index, path)
    stored = ix.read_index(spark, path)
    cl = fx.clauses(spark, [clause(1, 1, "should", "match_phrase", ["the end"]),
                            clause(1, 2, "should", "term", ["cat"])])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(se.clause_hits(cl, stored))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Bucketed: true" in plan or "bucketed" in plan.lower()
    assert "PushedFilters: [In(term" in plan or "In(term" in plan
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    got = {r.doc_id for r in se.search_scores(stored, cl).collect()}
    assert got == {1, 5}


def test_fuzziness_grows_monotone(spark, index):
    vocab = {r.term for r in index.term_df.collect()}
    got = []
    for k in (0, 1, 2):
        for p in (0, 1):
            q = fx.clauses(spark, [clause(1, 1, "should", "match", ["bark"], fuzziness=k, prefix_length=p)])
            got.append(((k, p), {r.term for r in se.expand_terms(q, index).collect()} & vocab))
    d = dict(got)
    assert d[(0, 0)] == set()                      # "bark" itself is not in the vocabulary
    assert d[(1, 0)] >= d[(0, 0)] and d[(2, 0)] >= d[(1, 0)]
    assert "barks" in d[(1, 0)] and "barks" in d[(1, 1)]
    assert all(t.startswith("b") for t in d[(2, 1)])


def test_score_of_several_clauses(spark, index):
    got = run(spark, index, [clause(1, 1, "should", "term", ["cat"], boost=2.0), clause(1, 2, "should", "term", ["one"]),
                             clause(1, 3, "must", "numeric_range", None, "n_chars", max=500.0)])
    one = 1 + math.log(5 / 2)
    norm = 1 / math.sqrt((2 * one) ** 2 + one ** 2)
    assert {r.doc_id: r.score for r in got.collect()} == {
        1: pytest.approx(1 + 2 * one / math.sqrt(6) * one * norm * 0.5), 5: pytest.approx(1.0), 6: pytest.approx(1.0)}


def test_explanation_adds_up_to_the_score(spark, index):
    cl = fx.clauses(spark, [clause(1, 1, "should", "match", ["the dog sat"]), clause(1, 2, "should", "match_phrase", ["the end"]),
                            clause(1, 3, "must", "numeric_range", None, "n_chars", min=0.0), clause(1, 4, "must_not", "term", ["time"]),
                            clause(2, 1, "must", "ids", ["1", "2"], None, boost=1.5), clause(2, 2, "should", "prefix", ["ca"]),
                            clause(3, 1, "must_not", "term", ["the"])])
    page = se.search(index, cl)
    sums = {(r.query_id, r.doc_id): r.s for r in rs.explain(page, index, cl).groupBy("query_id", "doc_id").agg(F.sum("contribution").alias("s")).collect()}
    want = {(r.query_id, r.doc_id): r.score for r in page.collect()}
    assert sums.keys() == want.keys() and len(want) == 9
    assert all(sums[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_wildcards_are_literal_but_two_and_regexp_prefixes(spark):
    df = spark.createDataFrame([(1, "ab abb abbb ac b")], "doc_id long, text string")
    idx = ix.build_index(df, {"text": "text"})

    def terms(kind, pattern):
        return sorted(r.term for r in se.expand_terms(fx.clauses(spark, [clause(1, 1, "should", kind, [pattern])]), idx).collect())
    assert terms("wildcard", "a%") == [] and terms("wildcard", "a_") == [] and terms("wildcard", "a?") == ["ab", "ac"]
    assert terms("regexp", "ab*") == ["ab", "abb", "abbb"] and terms("regexp", "a?b") == ["ab", "b"]
    assert terms("regexp", "ab{2,3}") == ["abb", "abbb"] and terms("regexp", "ac|b") == ["ac", "b"] and terms("regexp", "a") == []


def test_more_clauses_than_fit_a_broadcast(spark, index, monkeypatch):
    cls = [clause(1, 1, "should", "term", ["cat"]), clause(2, 1, "should", "prefix", ["do"]), clause(3, 1, "must", "ids", ["4"], None),
           clause(4, 1, "must", "numeric_range", None, "n_chars", max=100.0), clause(5, 1, "must_not", "term", ["the"])]
    want = rows(run(spark, index, cls), "query_id", "doc_id")
    monkeypatch.setattr(se, "BROADCAST_CLAUSE_BYTES", 0)
    monkeypatch.setattr(se, "PUSHDOWN_MAX_TERMS", 0)
    assert rows(run(spark, index, cls), "query_id", "doc_id") == want == [(1, 1), (2, 2), (3, 4), (4, 5), (4, 6), (5, 4), (5, 6)]


def test_analysed_keyword_and_all_fields(spark, tmp_path):
    df = spark.createDataFrame([("u1", "en", "The cats of Rome", "Jane Doe"), ("u2", "fr", "les chevaux", "jane doe"), ("u3", None, "a cat", "")],
                               "url string, lang string, text string, author string")
    an = ix.Analysis(langs={"text": F.coalesce("lang", F.lit("en"))}, keywords=("author",))
    built = ix.build_index(df, {"text": "text", "author": "author"}, key="url", all_field="_all", analysis=an)
    ix.write_index(built, str(tmp_path / "i"))
    for idx in (built, ix.read_index(spark, str(tmp_path / "i"))):
        def hits(*c):
            return [r[0] for r in rows(run(spark, idx, [clause(*x) for x in c]), "doc_id")]
        assert hits((1, 1, "should", "match", ["Cats"])) == ["u1", "u3"]
        assert hits((1, 1, "should", "match_phrase", ["cat of the rome"])) == []          # one place too many
        assert hits((1, 1, "should", "match_phrase", ["the cat in rome"])) == ["u1"]
        assert hits((1, 1, "should", "match", ["Jane Doe"], "author")) == ["u1"]
        assert hits((1, 1, "should", "match", ["cheval"], None)) == ["u2"]
        assert hits((1, 1, "must_not", "term", ["cat"])) == ["u2"]
        assert hits((1, 1, "must", "ids", ["u2", "nope"], None)) == ["u2"]


def test_refresh_of_a_stored_index(spark, tmp_path):
    path = str(tmp_path / "i")
    df = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    ix.write_index(ix.build_index(df, {"text": "text"}, attrs={"size": F.length("text")}, co_locate=True), path)
    before = ix.read_index(spark, path)
    new = spark.createDataFrame([(2, ""), (3, "c")], "doc_id long, text string")
    ix.refresh_index(spark, path, ix.build_index(new, {"text": "text"}, attrs={"size": F.length("text")}))
    after = ix.read_index(spark, path)
    assert rows(after.postings, "doc_id", "term") == [(1, "a"), (1, "b"), (3, "c")]
    assert rows(after.ids, "doc_id") == [(1,), (2,), (3,)] and rows(after.docs, "doc_id", "value") == [(1, 3.0), (2, 0.0), (3, 1.0)]
    assert rows(before.postings, "doc_id", "term") == [(1, "a"), (1, "b"), (2, "c"), (2, "d")]


def test_an_index_that_is_not_stored_splits_its_texts_once(spark):
    df = spark.createDataFrame([(1, "fr", "the cat of the end"), (2, None, "of the cat cat"), (2, "de", "cat"), (None, "de", "end the"), (5, "fr", None), (6, "en", "")],
                               "doc_id long, lang string, text string").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b
    built = ix.build_index(df.mapInArrow(counted, df.schema), {"lang": "lang", "text": "text"}, all_field="_all")
    cls = [clause(1, 1, "should", "match", ["the cat"], None), clause(2, 1, "must", "phrase", ["of", None, "cat"], "text")]
    got = {(r.query_id, r.doc_id): r.score for r in run(spark, built, cls).collect()}
    assert calls.value == 6
    assert got.keys() == {(1, 1), (1, 2), (1, None), (2, 2)}
    the = 1 + math.log(6 / (3 + 1))      # in three of the six rows with a token
    assert got[(1, None)] == pytest.approx(the / math.sqrt(3) / 2)
