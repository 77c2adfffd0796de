"""DuckDB twins for analysis, scoring parts, result shaping and set ops."""

from __future__ import annotations

from pagesearch.functions import analysis as an
from pagesearch.operators.results import FRAGMENT_SIZE, HTML_ESCAPES, NON_TOKEN, PIECE
from pagesearch.plans.catalog_results import (CUSTOM_ES_RULES, CUSTOM_ES_STOPS, EVENT_RANGE, FACET_BANDS, FIELD_LESS_CLAUSES,
                                              INGESTED_CLAUSES, KEYWORD_CLAUSES, LINK_CLAUSES, LINK_OPTS, ORDER_RANGE, REGEXP_CLAUSES)
from pagesearch.plans.oracle_pages import LINKS_CTE, SEED_CTE, STREAM_STORE, sq
from pagesearch.plans.oracle_sql import PAT, search_ctes, tok_ctes


def stop_values(stops=None) -> str:
    rows = an.stop_rows(stops)
    return "(VALUES " + ", ".join(f"({sq(lang)}, {sq(w)})" for lang, w in rows) + ") AS sw(lang, term)"


def rule_values(rules=None) -> str:
    rows = an.rule_rows(rules)
    vals = ", ".join(f"({sq(lang)}, {sq(s)}, {sq(r)}, [{', '.join(sq(e) for e in ex)}]::VARCHAR[])"
                     for lang, s, r, ex in rows)
    return f"(VALUES {vals}) AS rl(lang, suffix, repl, excl)"


DOC_TOK = f"""dtok AS (SELECT doc_id, lang, unnest(t) AS term, unnest(range(len(t))) AS pos
    FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), {PAT}) AS t FROM documents))"""


def stem_ctes(vocab: str, rules=None, name: str = "stems") -> str:
    """``vocab`` gives (lang, term); CTE ``name`` (lang, term, stem)."""
    return f"""{name}c AS (SELECT v.lang, v.term, arg_max(rl.suffix, length(rl.suffix)) AS suffix,
              arg_max(rl.repl, length(rl.suffix)) AS repl
       FROM ({vocab}) v JOIN {rule_values(rules)} ON v.lang = rl.lang
       WHERE ends_with(v.term, rl.suffix)
         AND len(list_filter(rl.excl, lambda e: ends_with(v.term, e))) = 0
         AND length(v.term) - length(rl.suffix) + length(rl.repl) >= {an.MIN_STEM}
       GROUP BY v.lang, v.term),
{name} AS (SELECT v.lang, v.term,
       coalesce(left(v.term, length(v.term) - length(c.suffix)) || c.repl, v.term) AS stem
       FROM ({vocab}) v LEFT JOIN {name}c c ON v.lang = c.lang AND v.term = c.term)"""


def analyze_sql(stops=None, rules=None, default_fields: dict[str, str] | None = None) -> str:
    default_fields = default_fields or {}
    parts = [f"SELECT doc_id, 'text' AS field, coalesce(lang, 'en') AS lang, text AS txt FROM documents"]
    parts += [f"SELECT doc_id, '{n}', 'en', {c} FROM documents" for n, c in default_fields.items()]
    src = " UNION ALL ".join(parts)
    return f"""WITH at0 AS (SELECT doc_id, field, lang, unnest(t) AS term, unnest(range(len(t))) AS pos
          FROM (SELECT doc_id, field, lang, regexp_extract_all(lower(txt), {PAT}) AS t FROM ({src}))),
    at1 AS (SELECT * FROM at0 WHERE (lang, term) NOT IN (SELECT lang, term FROM {stop_values(stops)})),
    {stem_ctes("SELECT DISTINCT lang, term FROM at1", rules)}
    SELECT a.doc_id, a.field, a.lang, a.pos, s.stem AS term
    FROM at1 a JOIN stems s ON a.lang = s.lang AND a.term = s.term"""


def html_esc(e: str) -> str:
    for ch, ent in HTML_ESCAPES:
        e = f"replace({e}, {sq(ch)}, {sq(ent)})"
    return e


PAGE = "SELECT query_id, CAST(rnk AS BIGINT) AS rank, doc_id, score, total_hits FROM ranked WHERE rnk > from_ AND rnk <= from_ + size"
HALF = FRAGMENT_SIZE // 2
FIND = "'(?s)^(.*?)(?:^|" + NON_TOKEN + ")(?:' || alt || ')(?:" + NON_TOKEN + r"|\z)'"

HIGHLIGHT = f"""WITH {search_ctes()},
page AS ({PAGE}),
qt AS (SELECT query_id, list_sort(list(DISTINCT term)) AS qterms FROM (
         SELECT query_id, unnest(regexp_extract_all(lower(array_to_string(terms, ' ')), {PAT})) AS term
         FROM cl0 WHERE occur <> 'must_not' AND kind IN ('term', 'match', 'match_phrase', 'phrase'))
       GROUP BY query_id),
h AS (SELECT p.query_id, p.rank, p.doc_id, q.qterms, array_to_string(q.qterms, '|') AS alt, d.text AS t
      FROM page p LEFT JOIN qt q USING (query_id) JOIN documents d USING (doc_id)),
h2 AS (SELECT *, CASE WHEN len(qterms) > 0
                      THEN greatest(1, length(regexp_extract(lower(t), {FIND}, 1)) + {1 - HALF})
                      ELSE 1 END AS st FROM h),
h3 AS (SELECT *, substring(t, st, {FRAGMENT_SIZE}) AS frag FROM h2)
SELECT query_id, rank, doc_id,
       array_to_string(list_transform(regexp_extract_all(frag, {sq(PIECE)}), lambda x:
         CASE WHEN coalesce(list_contains(qterms, lower(x)), false)
              THEN '<mark>' || {html_esc('x')} || '</mark>' ELSE {html_esc('x')} END), '') AS fragment
FROM h3"""

BAND = "CASE " + " ".join(f"WHEN n_chars >= {lo} AND n_chars < {hi} THEN '{lo}-{hi}'"
                          for lo, hi in zip(FACET_BANDS[:-1], FACET_BANDS[1:])) + " ELSE 'other' END"

LINK_SRC = "SELECT seq AS doc_id, 'url' AS field, url AS txt FROM lk UNION ALL SELECT seq, 'folder', folder FROM lk"
NO_ATTRS = "SELECT NULL AS doc_id, NULL AS field, NULL::DOUBLE AS value WHERE false"

ORACLE_RESULTS: dict[str, str] = {
    "stopword_filter": f"""WITH {DOC_TOK} SELECT doc_id, lang, pos, term FROM dtok
        WHERE (lang, term) NOT IN (SELECT lang, term FROM {stop_values()})""",
    "stem_vocab": f"WITH {DOC_TOK}, {stem_ctes('SELECT DISTINCT lang, term FROM dtok')} SELECT * FROM stems",
    "keyword_terms": f"""WITH {SEED_CTE}
        SELECT url AS doc_id, 'author' AS field, 0::BIGINT AS pos, author AS term FROM seed WHERE author <> ''
        UNION ALL SELECT url, 'lang', 0, lang FROM seed WHERE lang <> ''
        UNION ALL SELECT url, 'site_name', 0, site_name FROM seed WHERE site_name <> ''""",
    "analyze_by_lang": analyze_sql(default_fields={"source": "source"}),
    "analyzer_registry": analyze_sql(
        stops={**an.STOP_WORDS, "es": " ".join(CUSTOM_ES_STOPS)},
        rules={**an.SUFFIX_RULES, "es": CUSTOM_ES_RULES}),
    "tfidf_score": f"""WITH {search_ctes([1, 3])} SELECT query_id, clause_id, doc_id, term,
        round(sqrt(tf) * idf / sqrt(field_len), 6) AS weight FROM tm""",
    "coord_score": f"""WITH {search_ctes([3])},
        gg AS (SELECT query_id, doc_id, count(*) AS matched, sum(score) AS raw FROM hits
               WHERE occur = 'should' GROUP BY query_id, doc_id),
        tt AS (SELECT query_id, count(*) AS total FROM cl WHERE occur = 'should' GROUP BY query_id)
        SELECT query_id, doc_id, matched, total, round(matched / total, 6) AS coord,
               round(raw * (matched / total), 6) AS score FROM gg JOIN tt USING (query_id)""",
    "total_hits": f"WITH {search_ctes()} SELECT query_id, count(*) AS total_hits FROM matches GROUP BY query_id",
    "index_summary": f"WITH {SEED_CTE} SELECT lang, count(*) AS n_docs FROM seed GROUP BY lang",
    "facets": f"""WITH {search_ctes()},
        md AS (SELECT m.query_id, d.lang, CAST(l.quality AS VARCHAR) AS quality, d.n_chars
               FROM matches m JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)),
        f AS (SELECT query_id, 'lang' AS facet, lang AS bucket FROM md
              UNION ALL SELECT query_id, 'quality', quality FROM md
              UNION ALL SELECT query_id, 'n_chars', {BAND} FROM md)
        SELECT query_id, facet, bucket, count(*) AS n FROM f GROUP BY query_id, facet, bucket""",
    "explain_score": f"""WITH {search_ctes()}, page AS ({PAGE}),
        parts AS (
          SELECT query_id, clause_id, occur, doc_id, term, tf, df, idf, field_len, boost, norm, sqrt(tf) * idf / sqrt(field_len) AS weight,
                 boost * sqrt(tf) * idf / sqrt(field_len) * coalesce(idf * norm, 1) / n_slots
                 * (SELECT count(DISTINCT slot) FROM tm u WHERE u.query_id = t.query_id AND u.clause_id = t.clause_id AND u.doc_id = t.doc_id) AS part
          FROM tm t
          UNION ALL SELECT query_id, clause_id, occur, doc_id, NULL, freq, NULL, idf_sum, field_len, boost, norm,
                 sqrt(freq) * idf_sum / sqrt(field_len), score FROM ph
          UNION ALL SELECT query_id, clause_id, occur, doc_id, NULL, NULL, NULL, NULL, NULL, score, NULL, NULL, score
          FROM (SELECT * FROM rh UNION ALL SELECT * FROM ah UNION ALL SELECT * FROM ih)),
        share AS (SELECT query_id, doc_id, s / nullif(n_should, 0) AS coord FROM g JOIN qi2 USING (query_id))
        SELECT p.query_id, p.rank, p.doc_id, t.clause_id, t.occur, t.term, t.tf, t.df, round(t.idf, 6) AS idf,
               CAST(t.field_len AS BIGINT) AS field_len, t.boost, round(t.norm, 6) AS norm, round(t.weight, 6) AS weight,
               round(CASE WHEN t.occur = 'should' THEN c.coord ELSE 1 END, 6) AS coord,
               round(t.part * CASE WHEN t.occur = 'should' THEN c.coord ELSE 1 END, 6) AS contribution
        FROM page p JOIN parts t ON p.query_id = t.query_id AND p.doc_id = t.doc_id
        JOIN share c ON c.query_id = p.query_id AND c.doc_id = p.doc_id WHERE t.occur <> 'must_not'""",
    "topk_per_query": f"""WITH {search_ctes()}
        SELECT query_id, CAST(rnk AS BIGINT) AS rank, doc_id, score, total_hits FROM ranked WHERE rnk <= 5""",
    "top_hits": f"""WITH {search_ctes([1])}
        SELECT query_id, doc_id, score FROM matches ORDER BY score DESC, doc_id LIMIT 10""",
    "page_hits": f"""WITH {search_ctes([3])}
        SELECT query_id, doc_id, score FROM matches ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10""",
    "disjunct_union": f"""WITH {search_ctes([3])}
        SELECT doc_id FROM hits WHERE clause_id = 1 UNION SELECT doc_id FROM hits WHERE clause_id = 2
        UNION SELECT doc_id FROM hits WHERE clause_id = 3""",
    "conjunct_intersect": f"""WITH {search_ctes([3])}
        SELECT doc_id FROM hits WHERE clause_id = 1 INTERSECT SELECT doc_id FROM hits WHERE clause_id = 2
        INTERSECT SELECT doc_id FROM hits WHERE clause_id = 3""",
    "negate_except": f"""WITH {search_ctes([3])}
        SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM hits""",
    "hydrate_hits": f"""WITH {search_ctes()}, page AS ({PAGE})
        SELECT p.*, d.lang, d.source, d.n_chars FROM page p JOIN documents d USING (doc_id)""",
    "highlight": HIGHLIGHT,
    "score_round": f"""WITH {search_ctes()}
        SELECT query_id, CAST(rnk AS BIGINT) AS rank, doc_id, round(score, 3) AS score FROM ranked
        WHERE rnk > from_ AND rnk <= from_ + size""",
    "display_title": f"""WITH {LINKS_CTE}, {search_ctes(None, LINK_SRC, NO_ATTRS, LINK_CLAUSES, LINK_OPTS)},
        page AS ({PAGE})
        SELECT p.query_id, p.rank, p.doc_id, coalesce(nullif(lk.title, ''), lk.url) AS display_title
        FROM page p JOIN lk ON lk.seq = p.doc_id""",
    "index_replace": f"""WITH {tok_ctes("SELECT doc_id, 'text' AS field, text AS txt FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT d.doc_id, 'text', concat_ws(' ', d.text, 'quality', CAST(l.quality AS VARCHAR)) FROM documents d JOIN labels l USING (doc_id)")}
        SELECT doc_id, field, term, tf FROM post""",
}

ORACLE_RESULTS["index_refresh"] = ORACLE_RESULTS["index_replace"]
ORACLE_RESULTS["index_merge"] = f"""WITH r AS ({ORACLE_RESULTS["index_replace"]})
    SELECT r.*, df FROM r JOIN (SELECT field, term, count(*) AS df FROM r GROUP BY field, term) USING (field, term)"""
ORACLE_RESULTS["index_field_summary"] = f"""WITH {tok_ctes("SELECT doc_id, 'text' AS field, text AS txt FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents")}
    SELECT field, count(DISTINCT doc_id) AS n_docs, count(DISTINCT term) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens FROM post GROUP BY field"""
ORACLE_RESULTS["facets_dates"] = f"""WITH e AS (SELECT * FROM events
      WHERE epoch_us(ts) / 1e6 >= {EVENT_RANGE[0]} AND epoch_us(ts) / 1e6 < {EVENT_RANGE[1]}),
    f AS (SELECT 'event_type' AS facet, event_type AS bucket FROM e
          UNION ALL SELECT 'ts', strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') FROM e)
    SELECT 1 AS query_id, facet, bucket, count(*) AS n FROM f GROUP BY facet, bucket"""
NO_OPTS = [(0, 0, 10, 0)]
SCORES = "SELECT query_id, doc_id, score FROM matches"
ORACLE_RESULTS["q_regexp"] = f"WITH {search_ctes(clause_rows=REGEXP_CLAUSES, opt_rows=NO_OPTS)} {SCORES}"


def _rows(*clauses):
    return [(q, c, occur, kind, field, terms, None, None, None, None, None, None, boost) for q, c, occur, kind, field, terms, boost in clauses]


# the query side as the contract of the English chain gives it: "the", "of" and
# "in" are stop words, "thres" -> "thre", "rees" -> "ree", "ings" -> "ing"
STEMMED_ROWS = _rows((1, 1, "should", "match", "text", ["thre"], 1.0), (2, 1, "must", "phrase", "text", [None, "ta", None, "re"], 1.0),
                     (3, 1, "should", "match", "text", ["thre"], 1.0), (3, 2, "should", "match", "text", ["ree ing"], 2.0))
ORACLE_RESULTS["q_match_stemmed"] = f"""WITH {search_ctes(clause_rows=STEMMED_ROWS, opt_rows=NO_OPTS, tok="SELECT doc_id, field, term, pos FROM (" + analyze_sql() + ")")} {SCORES}"""
_all = f"""SELECT doc_id, '_all' AS field, unnest(t) AS term, unnest(range(len(t))) AS pos
    FROM (SELECT doc_id, list_concat(regexp_extract_all(lower(lang), {PAT}), regexp_extract_all(lower(text), {PAT})) AS t FROM documents)"""
ORACLE_RESULTS["q_field_less"] = f"WITH {search_ctes(clause_rows=FIELD_LESS_CLAUSES, opt_rows=NO_OPTS, tok=_all)} {SCORES}"
_seed_src = "SELECT url AS doc_id, 'title' AS field, title AS txt FROM seed UNION ALL SELECT url, 'text', text FROM seed"
_seed_tok = f"""SELECT doc_id, field, unnest(t) AS term, unnest(range(len(t))) AS pos
      FROM (SELECT doc_id, field, regexp_extract_all(lower(txt), {PAT}) AS t FROM ({_seed_src}))
    UNION ALL SELECT url, 'lang', lang, 0 FROM seed WHERE lang <> '' UNION ALL SELECT url, 'site_name', site_name, 0 FROM seed WHERE site_name <> ''"""
ORACLE_RESULTS["q_keyword"] = f"WITH {SEED_CTE}, {search_ctes(src=_seed_src, attrs=NO_ATTRS, clause_rows=KEYWORD_CLAUSES, opt_rows=NO_OPTS, tok=_seed_tok)} {SCORES}"
ORACLE_RESULTS["q_url_keys"] = f"""WITH {SEED_CTE}
    SELECT 1 AS query_id, url AS doc_id, CAST(1 AS DOUBLE) AS score FROM seed
    UNION ALL SELECT 2, url, 1.5 FROM seed WHERE url IN (SELECT min(url) FROM seed UNION ALL SELECT max(url) FROM seed)
    UNION ALL SELECT 3, url, 1 FROM seed WHERE len(list_filter(regexp_extract_all(lower(text), {PAT}), lambda t: starts_with(t, '1'))) = 0"""

for _name, _qids in [("q_must", [2, 9]), ("q_boolean", [2, 3, 9, 10, 13]), ("q_boost", [3, 13])]:
    ORACLE_RESULTS[_name] = f"WITH {search_ctes(_qids)}\nSELECT query_id, doc_id, score FROM matches"

_STREAM_FIELDS = " UNION ALL ".join(
    f"SELECT url AS doc_id, '{f}' AS field, {f} AS txt FROM ({STREAM_STORE})"
    for f in ["title", "text", "excerpt", "folder", "url"])
ORACLE_RESULTS["stream_index"] = f"WITH {tok_ctes(_STREAM_FIELDS)} SELECT doc_id AS url, field, term, tf FROM post"

ORACLE_RESULTS["search_ingested"] = f"""WITH {search_ctes(src=_STREAM_FIELDS, attrs=NO_ATTRS, clause_rows=INGESTED_CLAUSES, opt_rows=NO_OPTS)}
    SELECT query_id, doc_id AS url, score FROM matches"""

ORACLE_RESULTS["q_date_range"] = f"""SELECT 1 AS query_id, event_id AS doc_id, CAST(1.0 AS DOUBLE) AS score FROM events
    WHERE epoch_us(ts) / 1e6 >= {EVENT_RANGE[0]} AND epoch_us(ts) / 1e6 < {EVENT_RANGE[1]}"""
ORACLE_RESULTS["q_date_range_orders"] = f"""SELECT 1 AS query_id, o_orderkey AS doc_id, CAST(1.0 AS DOUBLE) AS score FROM orders
    WHERE epoch_us(o_orderdate) / 1e6 >= {ORDER_RANGE[0]} AND epoch_us(o_orderdate) / 1e6 <= {ORDER_RANGE[1]}"""
