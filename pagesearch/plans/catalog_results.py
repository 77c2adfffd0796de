"""Catalog entries for analysis, scoring parts, result shaping and set
operations (D02-D05, M01, E04, F09, F12, F13, G05-G07, G09-G11, H05, H07,
H08, J01-J03, K01, B08, B09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesearch.functions.scoring import rounded
from pagesearch.functions.text import tokens
from pagesearch.operators import analyze as az
from pagesearch.operators import extract as ex
from pagesearch.operators import results as rs
from pagesearch.operators import search as se
from pagesearch.operators.index import Analysis, build_index, field_summary, index_summary, merge_index, read_index, refresh_index, stored_buckets, write_index
from pagesearch.plans.catalog import CATALOG, _scores_of, register
from pagesearch.plans.corpus import documents_index
from pagesearch.sources import fixtures as fx
from pagesearch.session import shared_dir
from pagesearch.sources.tables import table

# Custom analyzer used by the registry entry: Spanish with its own stop words
# and suffix rules (a user-registered language replaces the built-in one).
CUSTOM_ES_STOPS = ["de", "la", "el", "en", "y", "que"]
CUSTOM_ES_RULES = [("ción", "cion", []), ("es", "", []), ("s", "", ["ss"])]

FACET_BANDS = [0, 500, 1000, 2000, 5000, 1000000000]

# Search over the saved links: field `url` and `folder`, key `seq`.
LINK_CLAUSES = [(1, 1, "should", "term", "url", ["fr"], None, None, None, None, None, None, 1.0),
                (2, 1, "must", "prefix", "folder", ["folder"], None, None, None, None, None, None, 1.0),
                (2, 2, "should", "term", "url", ["de"], None, None, None, None, None, None, 1.0)]
LINK_OPTS = [(1, 0, 10, 0), (2, 0, 10, 0)]


def _batch(spark, sf):
    index = documents_index(spark, sf)
    cl, opts = fx.clauses(spark), fx.query_opts(spark)
    return index, cl, opts


for _name, _qids in [("q_must", [2, 9]), ("q_boolean", [2, 3, 9, 10, 13]), ("q_boost", [3, 13])]:
    CATALOG[_name] = (lambda qids: (lambda spark, sf: _scores_of(spark, sf, qids)))(_qids)


# ------------------------------------------------------------ F05, F07, F15, F16: analysed, keyword, url-keyed, regexp

def _clause(q, c, occur, kind, field, terms, boost=1.0):
    return (q, c, occur, kind, field, terms, None, None, None, None, None, None, boost)


REGEXP_CLAUSES = [_clause(1, 1, "should", "regexp", "text", ["th(e|re)"]), _clause(2, 1, "must", "regexp", "text", ["thr?e.*"]),
                  _clause(2, 2, "should", "regexp", "text", ["i[nst]"]), _clause(3, 1, "should", "wildcard", "text", ["t%e*"])]
STEMMED_CLAUSES = [_clause(1, 1, "should", "match", "text", ["The thres OF"]), _clause(2, 1, "must", "match_phrase", "text", ["the ta in re"]),
                   _clause(3, 1, "should", "match", "text", ["thres"]), _clause(3, 2, "should", "match", "text", ["rees ings"], 2.0)]
FIELD_LESS_CLAUSES = [_clause(1, 1, "should", "match", None, ["thre en"]), _clause(2, 1, "must", "term", None, ["fr"]),
                      _clause(2, 2, "should", "term", None, ["de"])]
KEYWORD_CLAUSES = [_clause(1, 1, "should", "match", "lang", ["fr"]), _clause(2, 1, "must", "match", "title", ["old"]),
                   _clause(2, 2, "must_not", "term", "lang", ["en"])]
INGESTED_CLAUSES = [_clause(1, 1, "should", "match", "title", ["saved"]), _clause(2, 1, "must", "term", "folder", ["folder3"]),
                    _clause(2, 2, "should", "prefix", "text", ["th"]), _clause(3, 1, "must_not", "prefix", "folder", ["folder"])]


def _scores(index, spark, rows):
    m = se.search_scores(index, fx.clauses(spark, rows))
    return m.select("query_id", "doc_id", rounded(F.col("score")).alias("score"))


@register("q_regexp")
def q_regexp(spark, sf):
    return _scores(documents_index(spark, sf), spark, REGEXP_CLAUSES)


@register("q_match_stemmed")
def q_match_stemmed(spark, sf):
    lang = F.coalesce("lang", F.lit("en"))
    index = build_index(table(spark, sf, "documents"), {"text": "text"}, analysis=Analysis(langs={"text": lang}), co_locate=True)
    path = shared_dir(spark, "analysed-index")
    write_index(index, path)
    return _scores(read_index(spark, path), spark, STEMMED_CLAUSES)


@register("q_field_less")
def q_field_less(spark, sf):
    index = build_index(table(spark, sf, "documents"), {"lang": "lang", "text": "text"}, all_field="_all")
    return _scores(index, spark, FIELD_LESS_CLAUSES)


def _seed_index(spark, sf):
    seed = fx.store_seed(spark, sf)
    index = build_index(seed, {"title": "title", "text": "text", "lang": "lang", "site_name": "site_name"}, key="url",
                        analysis=Analysis(keywords=("lang", "site_name")), co_locate=True)
    path = shared_dir(spark, "url-index")
    write_index(index, path)
    return seed, read_index(spark, path)


@register("q_keyword")
def q_keyword(spark, sf):
    return _scores(_seed_index(spark, sf)[1], spark, KEYWORD_CLAUSES)


@register("q_url_keys")
def q_url_keys(spark, sf):
    """Match-all, ids (the first and the last url) and a query with MUST NOT alone on an index keyed by url."""
    seed, index = _seed_index(spark, sf)
    cl = fx.clauses(spark, [_clause(1, 1, "must", "all", None, None), _clause(3, 1, "must_not", "prefix", "text", ["1"])])
    ends = seed.agg(F.array(F.min("url"), F.max("url")).alias("ends"))
    ids = (fx.clauses(spark, [_clause(2, 1, "must", "ids", None, None, 1.5)]).drop("terms").join(ends)
           .withColumnRenamed("ends", "terms").select(*cl.columns))
    m = se.search_scores(index, cl.unionByName(ids))
    return m.select("query_id", "doc_id", rounded(F.col("score")).alias("score"))


def _refreshed(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    path = shared_dir(spark, "refreshed-index")
    write_index(build_index(docs, {"text": "text"}, co_locate=True), path)
    new = docs.join(labels, "doc_id").withColumn("text", F.concat_ws(" ", "text", F.lit("quality"), F.col("quality").cast("string")))
    refresh_index(spark, path, build_index(new, {"text": "text"}, co_locate=True, buckets=stored_buckets(spark, path)))
    return path


@register("index_refresh")
def q_index_refresh(spark, sf):
    """A07 on a stored index: labelled documents are indexed again, with their quality added."""
    return read_index(spark, _refreshed(spark, sf)).postings.select("doc_id", "field", "term", "tf")


@register("index_merge")
def q_index_merge(spark, sf):
    """The same after its segments are merged, with the counts of the vocabulary."""
    path = _refreshed(spark, sf)
    merge_index(spark, path, everything=True)
    index = read_index(spark, path)
    # the term first: rows are sorted by the first key's leading bytes, and a field is one value in most of them
    return index.postings.join(index.term_df, ["term", "field"]).select("doc_id", "field", "term", "tf", "df")


# ------------------------------------------------------------ F04: date ranges
# Bounds are epoch seconds: 2024-01-01 06:00 to 2024-01-02 00:00 (events), and
# 1995-01-01 to 1996-01-01 inclusive at both ends (orders).
EVENT_RANGE = (1704088800.0, 1704153600.0)
ORDER_RANGE = (788918400.0, 820454400.0)


def _date_range(spark, sf, name, key, text_col, col, lo, hi, incl_max):
    df = table(spark, sf, name)
    index = build_index(df, {text_col: text_col}, key=key, attrs={col: col})
    cl = fx.clauses(spark, [(1, 1, "must", "date_range", col, None, lo, hi, True, incl_max, None, None, 1.0)])
    m = se.search_scores(index, cl)
    return m.select("query_id", "doc_id", rounded(F.col("score")).alias("score"))


@register("q_date_range")
def q_date_range(spark, sf):
    return _date_range(spark, sf, "events", "event_id", "event_type", "ts", *EVENT_RANGE, False)


@register("q_date_range_orders")
def q_date_range_orders(spark, sf):
    return _date_range(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderdate", *ORDER_RANGE, True)


# ------------------------------------------------------------ D, M: analysis

def _doc_tokens(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "lang", F.posexplode(tokens("text")).alias("pos", "term"))


@register("stopword_filter")
def q_stopword_filter(spark, sf):
    kept = az.drop_stopwords(_doc_tokens(spark, sf), az.DEFAULT_REGISTRY.stop_table(spark))
    return kept.select("doc_id", "lang", F.col("pos").cast("bigint").alias("pos"), "term")


@register("stem_vocab")
def q_stem_vocab(spark, sf):
    vocab = _doc_tokens(spark, sf).select("lang", "term").distinct()
    return az.stem_vocab(vocab, az.DEFAULT_REGISTRY.rule_table(spark))


@register("keyword_terms")
def q_keyword_terms(spark, sf):
    return az.keyword_terms(fx.store_seed(spark, sf))


@register("analyze_by_lang")
def q_analyze_by_lang(spark, sf):
    return az.analyze(table(spark, sf, "documents"), {"text": "text"}, {"source": "source"})


@register("analyzer_registry")
def q_analyzer_registry(spark, sf):
    reg = az.AnalyzerRegistry().register_analyzer("es", CUSTOM_ES_STOPS, CUSTOM_ES_RULES)
    docs = table(spark, sf, "documents")
    return az.analyze(docs, {"text": "text"}, {}, registry=reg)


# ------------------------------------------------------------ G: scoring parts

@register("tfidf_score")
def q_tfidf_score(spark, sf):
    index, cl, _ = _batch(spark, sf)
    m = se.term_matches(cl.where(F.col("query_id").isin(1, 3)), index)
    return m.select("query_id", "clause_id", "doc_id", "term", rounded(F.col("w")).alias("weight"))


@register("coord_score")
def q_coord_score(spark, sf):
    index, cl, opts = _batch(spark, sf)
    cl = cl.where(F.col("query_id") == 3)
    out = se.combine(se.clause_hits(cl, index), cl, detail=True)
    return out.select("query_id", "doc_id", "matched", "total", F.round("coord", 6).alias("coord"), rounded(F.col("score")).alias("score"))


@register("total_hits")
def q_total_hits(spark, sf):
    index, cl, opts = _batch(spark, sf)
    return se.total_hits(se.search_scores(index, cl, opts))


@register("index_summary")
def q_index_summary(spark, sf):
    return index_summary(fx.store_seed(spark, sf))


@register("index_field_summary")
def q_index_field_summary(spark, sf):
    index = build_index(table(spark, sf, "documents"), {"text": "text", "source": "source"})
    return field_summary(index)


@register("facets_dates")
def q_facets_dates(spark, sf):
    matches = _date_range(spark, sf, "events", "event_id", "event_type", "ts", *EVENT_RANGE, False)
    events = table(spark, sf, "events").withColumnRenamed("event_id", "doc_id")
    return rs.facets(matches, events, terms={"event_type": "event_type"}, dates={"ts": "hour"})


@register("facets")
def q_facets(spark, sf):
    index, cl, opts = _batch(spark, sf)
    m = se.search_scores(index, cl, opts)
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rs.facets(m, docs, terms={"lang": "lang", "quality": "quality"}, bands={"n_chars": FACET_BANDS})


@register("explain_score")
def q_explain_score(spark, sf):
    index, cl, opts = _batch(spark, sf)
    page = se.search(index, cl, opts)
    return rs.explain(page, index, cl, opts)


# ------------------------------------------------------------ H: ranking, paging

@register("topk_per_query")
def q_topk_per_query(spark, sf):
    index, cl, opts = _batch(spark, sf)
    return se.topk(se.search_scores(index, cl, opts), None, size=5)


@register("topk_pages")
def q_topk_pages(spark, sf):
    """H05 without totals: the pages of the batch, scored only in buckets that can hold a hit."""
    index, cl, opts = _batch(spark, sf)
    return se.search_leaders(index, cl, opts)[0]


@register("top_hits")
def q_top_hits(spark, sf):
    index, cl, opts = _batch(spark, sf)
    m = se.search_scores(index, cl.where(F.col("query_id") == 1), opts)
    return se.top_hits(m, size=10).select("query_id", "doc_id", "score")


@register("page_hits")
def q_page_hits(spark, sf):
    index, cl, opts = _batch(spark, sf)
    m = se.search_scores(index, cl.where(F.col("query_id") == 3), opts)
    return se.top_hits(m, size=10, from_=10).select("query_id", "doc_id", "score")


# ------------------------------------------------------------ J: set operations

def _q3_sets(spark, sf):
    index, cl, _ = _batch(spark, sf)
    cl = cl.where(F.col("query_id") == 3)
    hits = se.clause_hits(cl, index)
    return index, [hits.where(F.col("clause_id") == c) for c in (1, 2, 3)]


@register("disjunct_union")
def q_disjunct_union(spark, sf):
    return rs.any_of(_q3_sets(spark, sf)[1])


@register("conjunct_intersect")
def q_conjunct_intersect(spark, sf):
    return rs.all_of(_q3_sets(spark, sf)[1])


@register("negate_except")
def q_negate_except(spark, sf):
    index, sets = _q3_sets(spark, sf)
    return rs.none_of(table(spark, sf, "documents"), sets)


# ------------------------------------------------------------ E04, K01, B08, B09

@register("hydrate_hits")
def q_hydrate_hits(spark, sf):
    index, cl, opts = _batch(spark, sf)
    page = se.search(index, cl, opts)
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return rs.hydrate(page, docs)


@register("highlight")
def q_highlight(spark, sf):
    index, cl, opts = _batch(spark, sf)
    page = se.search(index, cl, opts)
    out = rs.highlight(page, table(spark, sf, "documents"), rs.query_terms(cl))
    return out.select("query_id", "rank", "doc_id", "fragment")


@register("score_round")
def q_score_round(spark, sf):
    index, cl, opts = _batch(spark, sf)
    return ex.round_score(se.search(index, cl, opts)).select("query_id", "rank", "doc_id", "score")


@register("display_title")
def q_display_title(spark, sf):
    links = fx.links(spark, sf)
    index = build_index(links, {"url": "url", "folder": "folder"}, key="seq")
    page = se.search(index, fx.clauses(spark, LINK_CLAUSES), fx.query_opts(spark, LINK_OPTS))
    store = links.select(F.col("seq").alias("doc_id"), "title", "url")
    return ex.display_title(rs.hydrate(page, store)).select("query_id", "rank", "doc_id", "display_title")
