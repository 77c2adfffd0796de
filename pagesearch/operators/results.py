"""Result shaping after the ranked page.

Everything here runs on the top-k page (bounded by queries x size), which is
broadcast after a size check; the big side (store, matches) is only scanned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesearch.functions import scoring
from pagesearch.operators import search as se
from pagesearch.operators.index import Index
from pagesearch.session import broadcast_if_small, materialize

# FIXED VALUES: highlight marks, fragment size, token boundary and HTML escapes.
MARK_OPEN, MARK_CLOSE = "<mark>", "</mark>"
FRAGMENT_SIZE = 200
NON_TOKEN = r"[^\p{L}\p{N}]"
PIECE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]


def hydrate(hits: DataFrame, store: DataFrame, key: str = "doc_id") -> DataFrame:
    """All stored fields for each hit, joined after the limit (the page
    is written once, then broadcast after its size check)."""
    return broadcast_if_small(materialize(hits, "page")).join(store, key)


def html_escape(col):
    for ch, ent in HTML_ESCAPES:
        col = F.replace(col, F.lit(ch), F.lit(ent))
    return col


def query_terms(clauses: DataFrame) -> DataFrame:
    """Terms to highlight per query: the analysed terms of term, match and
    phrase clauses that are not MUST NOT."""
    from pagesearch.functions.text import tokens
    pos = clauses.where((F.col("occur") != "must_not")
                        & F.col("kind").isin("term", "match", "match_phrase", "phrase"))
    return (pos.select("query_id", F.explode(tokens(F.array_join("terms", " "))).alias("term"))
            .groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("qterms")))


def highlight(hits: DataFrame, store: DataFrame, qterms: DataFrame, field: str = "text",
              size: int = FRAGMENT_SIZE, key: str = "doc_id") -> DataFrame:
    """One fragment of ``size`` characters per hit around the first
    whole-token match of a query term.  The fragment is split into token and
    non-token pieces; every piece is HTML-escaped and every token whose
    lower-case form is a query term is wrapped in ``<mark>``.  Hits without
    query terms get the start of the field."""
    page = broadcast_if_small(materialize(hits.join(F.broadcast(qterms), "query_id", "left"), "page"))
    joined = page.join(store.select(key, F.col(field).alias("_t")), key)
    alt = F.array_join("qterms", "|")
    find = F.concat(F.lit(r"(?s)^(.*?)(?:^|" + NON_TOKEN + ")(?:"), alt, F.lit(r")(?:" + NON_TOKEN + r"|\z)"))
    before = F.length(F.call_function("regexp_extract", F.lower("_t"), find, F.lit(1)))
    start = F.greatest(F.lit(1), before + F.lit(1 - size // 2))
    pieces = F.regexp_extract_all(F.col("_frag"), F.lit(PIECE), 0)
    marked = F.array_join(F.transform(pieces, lambda x: F.when(
        F.coalesce(F.array_contains("qterms", F.lower(x)), F.lit(False)),
        F.concat(F.lit(MARK_OPEN), html_escape(x), F.lit(MARK_CLOSE))).otherwise(html_escape(x))), "")
    return (joined.withColumn("_start", F.when(F.size("qterms") > 0, start).otherwise(F.lit(1)))
            .withColumn("_frag", F.substring(F.col("_t"), F.col("_start"), F.lit(size)))
            .withColumn("fragment", marked)
            .drop("_t", "_start", "_frag", "qterms"))


def facets(matches: DataFrame, docs: DataFrame, terms: dict[str, str] | None = None,
           bands: dict[str, list[float]] | None = None, key: str = "doc_id",
           top_n: int | None = None, dates: dict[str, str] | None = None) -> DataFrame:
    """Matched documents per query counted by the value of a field
    (``terms``: facet name -> column of ``docs``), by numeric bands
    (``bands``: column -> ascending edges; bucket label ``lo-hi``) and by date
    bands (``dates``: column -> year, month, day or hour; label its start).  With
    ``top_n`` only the ``top_n`` largest buckets of each (query, facet) are
    kept (count desc, bucket asc; a literal bound, so WindowGroupLimit)."""
    terms = terms or {}
    bands = bands or {}
    d = matches.select("query_id", key).join(docs, key)
    parts = []
    for name, col in terms.items():
        parts.append(F.struct(F.lit(name).alias("facet"), F.col(col).cast("string").alias("bucket")))
    for col, edges in bands.items():
        expr = None
        for lo, hi in zip(edges[:-1], edges[1:]):
            cond = (F.col(col) >= lo) & (F.col(col) < hi)
            lab = F.lit(f"{_num(lo)}-{_num(hi)}")
            expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
        expr = expr.otherwise(F.lit("other")) if expr is not None else F.lit("other")
        parts.append(F.struct(F.lit(col).alias("facet"), expr.alias("bucket")))
    for col, unit in (dates or {}).items():
        parts.append(F.struct(F.lit(col).alias("facet"), F.date_format(F.date_trunc(unit, F.col(col)), "yyyy-MM-dd HH:mm").alias("bucket")))
    counts = (d.select("query_id", F.inline(F.array(*parts)))
              .groupBy("query_id", "facet", "bucket").agg(F.count(F.lit(1)).alias("n")))
    if top_n is None:
        return counts
    w = Window.partitionBy("query_id", "facet").orderBy(F.col("n").desc(), F.col("bucket").asc_nulls_last())
    return (counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.lit(top_n))
            .drop("_r"))


def _num(x) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def explain(page: DataFrame, index: Index, clauses: DataFrame, opts: DataFrame | None = None) -> DataFrame:
    """Flat score breakdown of each returned hit, for every kind of
    clause: one row per matched term of a term-like clause, one per phrase
    (``tf`` its frequency, ``idf`` the sum) and one per range, id or match-all
    clause.  ``contribution`` is what the row adds to the hit's score, coord
    included; a hit's contributions add up to its score.  MUST NOT clauses
    add nothing and have no rows."""
    page = broadcast_if_small(materialize(page.select("query_id", "doc_id", "rank"), "page"))
    cl = se.with_implicit_all(clauses)
    batch = se.batch_of(cl)
    shown = cl.where(F.col("occur") != "must_not")
    keep = [*se.CKEYS, "doc_id", "term", "tf", "df", "idf", "field_len", "boost", "norm", "weight", "part"]
    parts = []
    m = se.lookup(cl, index, batch)
    if m is not None:
        m = m.where(F.col("occur") != "must_not").join(page.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
        t = m.where(~F.col("_ph")).withColumn("weight", scoring.term_weight(F.col("tf"), F.col("idf"), F.col("field_len")))
        clause = Window.partitionBy("query_id", "clause_id", "doc_id")
        matched = F.size(F.collect_set("slot").over(clause)) / F.col("n_slots")
        part = F.col("boost") * F.col("weight") * scoring.query_factor(F.col("norm"), F.col("idf")) * matched
        parts.append(t.withColumn("part", part).select(*keep))
        p = se.phrase_starts(m).withColumns({"weight": scoring.phrase_weight(F.col("freq"), F.col("idf_sum"), F.col("field_len"))})
        part = F.col("boost") * F.col("weight") * scoring.query_factor(F.col("norm"), F.col("idf_sum"))
        parts.append(p.select(*se.CKEYS, "doc_id", F.lit(None).cast("string").alias("term"), F.col("freq").alias("tf"),
                              F.lit(None).cast("bigint").alias("df"), F.col("idf_sum").alias("idf"), "field_len", "boost", "norm",
                              "weight", part.alias("part")))
    flat = {"range": se.range_hits, "all": se.all_hits, "ids": se.id_hits}
    for hits in flat.values():
        h = hits(shown, index, batch)
        parts.append(h.select(*se.CKEYS, "doc_id", F.lit(None).cast("string").alias("term"), F.lit(None).cast("bigint").alias("tf"),
                              F.lit(None).cast("bigint").alias("df"), F.lit(None).cast("double").alias("idf"),
                              F.lit(None).cast("int").alias("field_len"), F.col("score").alias("boost"),
                              F.lit(None).cast("double").alias("norm"), F.lit(None).cast("double").alias("weight"), F.col("score").alias("part")))
    rows = reduce(DataFrame.unionByName, parts).join(page, ["query_id", "doc_id"])
    totals = batch.side(se.query_info(cl, opts).select("query_id", "n_should"))
    hit = Window.partitionBy("query_id", "doc_id")
    should = F.col("occur") == "should"
    coord = F.size(F.collect_set(F.when(should, F.col("clause_id"))).over(hit)) / F.col("n_should")
    return (rows.join(totals, "query_id").withColumn("coord", F.when(should, coord).otherwise(F.lit(1.0)))
            .select("query_id", "rank", "doc_id", "clause_id", "occur", "term", "tf", "df", F.round("idf", 6).alias("idf"),
                    F.col("field_len").cast("bigint").alias("field_len"), "boost", F.round("norm", 6).alias("norm"),
                    F.round("weight", 6).alias("weight"), F.round("coord", 6).alias("coord"),
                    F.round(F.col("part") * F.col("coord"), 6).alias("contribution")))


def any_of(hit_sets: list[DataFrame]) -> DataFrame:
    """Ids matching any clause (UNION)."""
    return reduce(DataFrame.union, [h.select("doc_id") for h in hit_sets]).distinct()


def all_of(hit_sets: list[DataFrame]) -> DataFrame:
    """Ids matching every clause (INTERSECT)."""
    return reduce(DataFrame.intersect, [h.select("doc_id") for h in hit_sets])


def none_of(all_ids: DataFrame, hit_sets: list[DataFrame]) -> DataFrame:
    """All ids minus the excluded ones (EXCEPT)."""
    return all_ids.select("doc_id").subtract(any_of(hit_sets))
