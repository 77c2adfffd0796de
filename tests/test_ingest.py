"""Ingest rules and quirks on hand-made rows: capture choice, de-duplication,
force, title fallback, languages, store upsert, crawl plan, extraction."""

import pytest
from pyspark.sql import functions as F

from pagesearch.operators import extract as ex
from pagesearch.operators import ingest as ing
from pagesearch.operators import language as lg
from pyspark.sql import types as T

from pagesearch.schemas import CAPTURES, LINKS, STORE, with_field
from pagesearch.sources import store as st
from tests.conftest import SF_SMALL, rows

PAGE = ('<html lang="en"><head><title>T &amp; U</title><script>var t="</p>";</script>'
        '<style>p{}</style></head><body><nav>menu</nav><!-- c --><article><p>First para '
        '<b>bold<p>Second &quot;q&quot;</article><footer>&copy; x</footer></body></html>')


@pytest.fixture(scope="module")
def profiles(spark):
    from pagesearch.sources.tables import table
    return lg.train_profiles(table(spark, SF_SMALL, "documents")).cache()


def test_best_capture_rules(spark):
    caps = spark.createDataFrame([
        ("u1", 1, "http", 403, "e1"), ("u1", 2, "http", 200, "ok1"),
        ("u2", 1, "http", 404, "e2"), ("u2", 2, "browser", 200, "br2"),
        ("u3", 1, "http", 503, "e3a"), ("u3", 2, "http", 503, "e3b"), ("u3", 3, "http", 503, "e3c"),
    ], CAPTURES)
    got = rows(ing.best_capture(caps), "url", "html", "status")
    assert got == [("u1", "ok1", 200), ("u2", "br2", 200), ("u3", "e3c", 503)]   # Q4: error page kept


def test_capture_class(spark):
    caps = spark.createDataFrame([("u", 1, "http", 403, ""), ("u", 3, "http", 503, ""),
                                  ("u", 1, "http", 404, ""), ("u", 1, "http", 200, "")], CAPTURES)
    assert rows(ex.capture_class(caps), "status", "attempt", "class") == [
        (200, 1, "ok"), (403, 1, "retry"), (404, 1, "browser"), (503, 3, "browser")]


def test_dedupe_first_and_last(spark):
    links = spark.createDataFrame([("u", "f1", "a", 1), ("u", "f2", "b", 2)], LINKS)
    assert rows(ing.dedupe(links, "first"), "url", "folder") == [("u", "f1")]
    assert rows(ing.dedupe(links, "last"), "url", "folder") == [("u", "f2")]


def test_invalid_url_kept_aside_and_port_userinfo(spark):
    links = spark.createDataFrame([("http://a b", "", "", 1), ("http://u:p@h.example.com:8080/x", "", "", 2)], LINKS)
    got = rows(ex.with_host(links), "seq", "host", "valid")
    assert got == [(1, None, False), (2, "h.example.com", True)]


def test_extraction_edges(spark):
    pages = spark.createDataFrame([(1, "http://x.example.com/a", PAGE), (2, "http://x.example.com/b", ""),
                                   (3, "http://y.example.com/c", "<html><body><nav>n</nav><p>Only body</body></html>"),
                                   (4, "http://y.example.com/d", None)],
                                  "page_id long, url string, html string")
    x = {r.page_id: r for r in ex.extract_all(pages).collect()}
    assert x[1].x_title == "T & U"
    assert x[1].x_text == 'First para bold Second "q"'          # script body with </p> ignored
    assert x[1].x_excerpt == "First para bold"
    assert x[1].x_site == "x.example.com"
    assert x[2].x_title == "" and x[2].x_text == ""
    assert x[3].x_text == "Only body"                            # no article: body minus nav
    assert x[4].x_title is None and x[4].x_text == ""


def test_title_fallback_null_and_empty(spark):
    df = spark.createDataFrame([("a", None, "saved"), ("b", "", "saved"), ("c", "x", "saved")],
                               "url string, x_title string, title string")
    assert rows(ex.coalesce_title(df), "url", "title") == [("a", "saved"), ("b", "saved"), ("c", "x")]


def test_route_unsupported_and_empty(spark):
    df = spark.createDataFrame([("zz",), ("",), (None,), ("de",)], "lang string")
    assert sorted(r.lang for r in lg.route_lang(df, spark).collect()) == ["de", "en", "en", "en"]


def test_lang_priority_title_wins(spark):
    df = spark.createDataFrame([("fr", "de", "es"), (None, "de", "es"), (None, None, None)],
                               "lang_title string, lang_excerpt string, lang_text string")
    assert [r.lang for r in lg.pick_lang(df).collect()] == ["fr", "de", "en"]


def test_detect_language_and_no_profile_terms(spark, profiles):
    texts = spark.createDataFrame([(1, "the of and in to is"), (2, "zzzz qqqq")], "id long, text string")
    got = {r.id: (r.lang, r.confidence) for r in lg.detect_lang(texts, profiles, ["id"]).collect()}
    assert got[1][0] == "en" and got[1][1] > 0.95
    assert got[2] == ("en", 0.0)


def test_build_store_force_and_skip(spark, profiles):
    links = spark.createDataFrame([("http://x.example.com/a", "f1", "s1", 1),
                                   ("http://x.example.com/a", "f2", "s2", 2),
                                   ("http://a b", "bad", "", 3),
                                   ("http://x.example.com/none", "f", "", 4)], LINKS)
    caps = spark.createDataFrame([("http://x.example.com/a", 1, "http", 200, PAGE)], CAPTURES)
    out = ing.build_store(spark, links, caps, profiles)
    assert rows(out, "url", "folder", "title") == [("http://x.example.com/a", "f1", "T & U")]
    forced = ing.build_store(spark, links, caps, profiles, store=out.drop("seq"), force=True)
    assert rows(forced, "url", "folder") == [("http://x.example.com/a", "f2")]
    skipped = ing.build_store(spark, links, caps, profiles, store=out.drop("seq"))
    assert skipped.count() == 0
    assert rows(ing.pending(links, caps), "seq") == [(3,), (4,)]


def test_empty_html_still_a_document(spark, profiles):
    links = spark.createDataFrame([("http://x.example.com/e", "f", "saved", 1)], LINKS)
    caps = spark.createDataFrame([("http://x.example.com/e", 1, "http", 200, "")], CAPTURES)
    out = ing.build_store(spark, links, caps, profiles).collect()
    assert len(out) == 1 and out[0].title == "saved" and out[0].text == "" and out[0].lang == "en"


def test_upsert_twice_equals_once(spark):
    old = spark.createDataFrame([("u1", "en", "old", "", "", "", "", "", "f")], STORE)
    new = spark.createDataFrame([("u1", "fr", "new", "", "", "", "", "", "f", 5),
                                 ("u1", "de", "newer", "", "", "", "", "", "f", 7),
                                 ("u2", "en", "x", "", "", "", "", "", "f", 1)],
                                with_field(STORE, "seq", T.LongType()))
    once = st.upsert(old, new)
    twice = st.upsert(once, new)
    assert rows(once) == rows(twice)
    assert rows(once, "url", "title") == [("u1", "newer"), ("u2", "x")]


def test_store_versions_never_overwrite(spark, tmp_path):
    root = str(tmp_path / "store")
    a = spark.createDataFrame([("u1", "en", "a", "", "", "", "", "", "f")], STORE)
    v1 = st.write_version(a, root)
    v2 = st.write_version(st.upsert(st.read_store(spark, root), a.withColumn("seq", F.lit(1)).withColumn("title", F.lit("b"))), root)
    assert v1 != v2 and v2.endswith("v000002")
    assert rows(st.read_store(spark, root), "title") == [("b",)]


def test_json_round_trip(spark):
    s = spark.createDataFrame([("u1", "fr", "t", "<p>", "x", "e", "a", "s", "f")], STORE)
    back = st.from_lang_json(st.to_lang_json(s))
    assert rows(back) == rows(s)
    keys = st.to_lang_json(s).select(F.from_json("doc", "map<string,string>").alias("m")).select(
        F.array_sort(F.map_keys("m")).alias("k")).first().k
    assert "fr_title" in keys and "siteName" in keys


def test_fetch_slots_hot_host(spark):
    links = spark.createDataFrame([(f"http://h.example.com/{i}", "", "", i) for i in range(50)]
                                  + [("http://o.example.com/x", "", "", 100)], LINKS)
    got = ing.fetch_slots(links).collect()
    hot = sorted((r.seq, r.rn, r.slot) for r in got if r.host == "h.example.com")
    assert [(s, n) for s, n, _ in hot] == [(i, i + 1) for i in range(50)]
    assert [sl for _, _, sl in hot] == [i // 2 for i in range(50)]


def test_uniform_pick_is_stable(spark):
    links = spark.createDataFrame([(f"u{i}", f"f{i % 3}", "", i) for i in range(30)], LINKS)
    a = rows(ing.pick_one(links, ["folder"], "s", "url"), "folder", "url")
    b = rows(ing.pick_one(links.repartition(7), ["folder"], "s", "url"), "folder", "url")
    assert a == b and len(a) == 3


def test_boilerplate_removed(spark):
    common = "<nav>Home About</nav>"
    pages = spark.createDataFrame([
        (1, "http://h.example.com/1", f"<body>{common}<p>unique one</body>"),
        (2, "http://h.example.com/2", f"<body>{common}<p>unique two</body>"),
        (3, "http://g.example.com/3", f"<body>{common}<p>other host</body>")],
        "page_id long, url string, html string")
    got = {r.page_id: r.text for r in ex.strip_boilerplate(pages).collect()}
    assert got == {1: "unique one", 2: "unique two", 3: "Home About other host"}


def block_pages(spark):
    links = lambda n: "<ul>" + "".join(f"<li><a href='/{n}/{i}'>target {n} {i}</a></li>" for i in range(4)) + "</ul>"
    long = " ".join(f"w{i}" for i in range(50))
    return spark.createDataFrame([
        (1, "http://h.example.com/1", f"<body><p>{long}</p>{links(1)}<div>see also</div>{links(2)}<p>The <a href=x>end</a> of this long enough paragraph here</p></body>"),
        (2, "http://h.example.com/2", f"<body>{links(3)}<h1>A heading of the page</h1><p>{long} two</p></body>"),
        (3, "http://h.example.com/3", None), (4, "http://h.example.com/4", ""), (5, None, "<p>no url"),
        (6, "http://h.example.com/6", "<p>open <a href=x>anchor to the end of this block"),
        (7, "http://h.example.com/7", "<p>same</p><p>same</p>")], "page_id long, url string, html string"), long


def test_link_lists_unique_to_a_page_are_dropped_and_every_page_stays(spark):
    pages, long = block_pages(spark)
    got = {r.page_id: (r.n_blocks, r.n_kept, r.text) for r in ex.strip_boilerplate(pages).collect()}
    assert got == {1: (11, 1, long), 2: (6, 2, f"A heading of the page {long} two"),
                   3: (0, 0, ""), 4: (0, 0, ""), 5: (1, 1, "no url"), 6: (1, 0, ""), 7: (2, 2, "same same")}


def test_boilerplate_is_the_same_without_broadcast(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").unionByName(block_pages(spark)[0].withColumn("page_id", F.col("page_id") + 100_000))
    small, large = ex.strip_boilerplate(pages), ex.strip_boilerplate(pages, max_broadcast=0)
    assert rows(small) == rows(large) and small.count() == pages.count()


def test_boilerplate_shuffles_no_html(spark):
    plan = ex.page_blocks(block_pages(spark)[0])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_rank_within_does_not_depend_on_exchange_reuse(spark):
    from pyspark.sql import Window
    from pagesearch.operators.ingest import rank_within
    df = spark.range(20_000).select(F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("h"), (F.col("id") % 50).cast("string"))).alias("host"),
                                    F.xxhash64("id").alias("seq"), "id")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("host").orderBy("seq")).cast("bigint"))
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            got = rank_within(df, "host", "seq", 8)
            for cols in (["id", "rn"], ["host", "rn"]):
                assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
