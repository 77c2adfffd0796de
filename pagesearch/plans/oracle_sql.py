"""DuckDB twins of the catalog queries (the differential check).

Only the driver tables are views on the DuckDB side, so oracles on derived
inputs carry the fixture SQL as CTEs and token-based oracles carry the
tokenise CTE.  Written independently of the Spark code, from the contracts.
"""

from __future__ import annotations

from pagesearch.sources import fixtures as fx

PAT = r"'[\p{L}\p{N}]+'"

DOCS_SRC = "SELECT doc_id, 'text' AS field, text AS txt FROM documents"
DOCS_ATTRS = "SELECT doc_id, 'n_chars' AS field, CAST(n_chars AS DOUBLE) AS value FROM documents"


def tok_ctes(src: str = DOCS_SRC, tok: str | None = None) -> str:
    """Token, postings and statistics CTEs over ``src`` (doc_id, field, txt), or
    over the tokens that ``tok`` gives (doc_id, field, term, pos)."""
    plain = f"""SELECT doc_id, field, unnest(t) AS term, unnest(range(len(t))) AS pos
  FROM (SELECT doc_id, field, regexp_extract_all(lower(txt), {PAT}) AS t FROM ({src}))"""
    return f"""tok AS (SELECT *, count(*) OVER (PARTITION BY doc_id, field) AS field_len FROM ({tok or plain})),
post AS (SELECT doc_id, field, term, count(*) AS tf, max(field_len) AS field_len,
                list_sort(list(pos)) AS positions
         FROM tok GROUP BY doc_id, field, term),
tdf AS (SELECT field, term, count(*) AS df FROM post GROUP BY field, term),
flen AS (SELECT DISTINCT doc_id, field, field_len AS n_terms FROM tok),
corp AS (SELECT field, count(*) AS n_docs, avg(n_terms) AS avg_len FROM flen GROUP BY field)"""


TOK = tok_ctes()


def _sql_val(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, list):
        return "[" + ", ".join(_sql_val(x) for x in v) + "]::VARCHAR[]"
    return "'" + str(v).replace("'", "''") + "'"


def clauses_values(rows=None) -> str:
    rows = rows if rows is not None else fx.CLAUSE_ROWS
    types = ["INTEGER", "INTEGER", "VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR[]", "DOUBLE",
             "DOUBLE", "BOOLEAN", "BOOLEAN", "INTEGER", "INTEGER", "DOUBLE"]
    vals = ",\n    ".join("(" + ", ".join(f"CAST({_sql_val(v)} AS {t})" for v, t in zip(r, types)) + ")"
                          for r in rows)
    return (f"(VALUES {vals}) AS t(query_id, clause_id, occur, kind, field, terms, min, max, "
            f"incl_min, incl_max, fuzziness, prefix_length, boost)")


def opts_values(rows=None) -> str:
    rows = rows if rows is not None else fx.OPTS_ROWS
    vals = ", ".join(f"({a}, {b}, {c}, {d})" for a, b, c, d in rows)
    return f"(VALUES {vals}) AS o(query_id, min_should, size, from_)"


def search_ctes(qids: list[int] | None = None, src: str = DOCS_SRC, attrs: str = DOCS_ATTRS,
                clause_rows=None, opt_rows=None, tok: str | None = None) -> str:
    where = f"WHERE query_id IN ({', '.join(map(str, qids))})" if qids else ""
    return f"""{tok_ctes(src, tok)},
cl0 AS (SELECT * FROM {clauses_values(clause_rows)} {where}),
opts AS (SELECT * FROM {opts_values(opt_rows)} {where}),
cl1 AS (SELECT query_id, clause_id, occur, kind, coalesce(field, '_all') AS field, terms, min, max,
               coalesce(incl_min, true) AS incl_min, coalesce(incl_max, false) AS incl_max,
               coalesce(fuzziness, 0) AS fuzziness, coalesce(prefix_length, 0) AS prefix_length,
               coalesce(boost, 1.0) AS boost FROM cl0),
cl AS (SELECT * FROM cl1 UNION ALL
       SELECT query_id, -1, 'must', 'all', '_all', NULL, NULL, NULL, true, false, 0, 0, 1.0
       FROM cl1 GROUP BY query_id
       HAVING sum(CASE WHEN occur <> 'must_not' THEN 1 ELSE 0 END) = 0),
mq AS (SELECT query_id, clause_id, occur, field, boost, fuzziness, prefix_length,
              unnest(qt) AS qterm, unnest(range(len(qt))) AS slot, len(qt) AS n_slots
       FROM (SELECT *, regexp_extract_all(lower(array_to_string(terms, ' ')), {PAT}) AS qt
             FROM cl WHERE kind = 'match')),
qterm AS (
  SELECT query_id, clause_id, occur, field, boost, 0 AS slot, 1 AS n_slots, terms[1] AS term
  FROM cl WHERE kind = 'term'
  UNION ALL
  SELECT query_id, clause_id, occur, field, boost, slot, n_slots, qterm FROM mq WHERE fuzziness = 0
  UNION ALL
  SELECT m.query_id, m.clause_id, m.occur, m.field, m.boost, m.slot, m.n_slots, v.term
  FROM mq m JOIN tdf v ON v.field = m.field
  WHERE m.fuzziness > 0 AND left(v.term, m.prefix_length) = left(m.qterm, m.prefix_length)
    AND levenshtein(v.term, m.qterm) <= m.fuzziness
  UNION ALL
  SELECT c.query_id, c.clause_id, c.occur, c.field, c.boost, 0, 1, v.term
  FROM cl c JOIN tdf v ON v.field = c.field
  WHERE c.kind = 'prefix' AND starts_with(v.term, c.terms[1])
  UNION ALL
  SELECT c.query_id, c.clause_id, c.occur, c.field, c.boost, 0, 1, v.term
  FROM cl c JOIN tdf v ON v.field = c.field
  WHERE c.kind = 'wildcard' AND regexp_full_match(v.term,
    replace(replace(regexp_replace(c.terms[1], '([.+^$|()\\[\\]{{}}\\\\])', '\\\\\\1', 'g'), '*', '.*'), '?', '.'))
  UNION ALL
  SELECT c.query_id, c.clause_id, c.occur, c.field, c.boost, 0, 1, v.term
  FROM cl c JOIN tdf v ON v.field = c.field
  WHERE c.kind = 'regexp' AND regexp_full_match(v.term, c.terms[1])),
ps AS (SELECT *, count(*) OVER (PARTITION BY query_id, clause_id) AS n_slots
       FROM (SELECT query_id, clause_id, occur, field, boost,
                    unnest(qt) AS term, unnest(range(len(qt))) AS slot
             FROM (SELECT *, CASE WHEN kind = 'match_phrase'
                                  THEN regexp_extract_all(lower(array_to_string(terms, ' ')), {PAT})
                                  ELSE terms END AS qt
                   FROM cl WHERE kind IN ('match_phrase', 'phrase')))
       WHERE term IS NOT NULL),
qidf AS (SELECT q.query_id, q.clause_id, q.occur, q.boost, q.ph, 1 + ln(c.n_docs / (d.df + 1)) AS idf
         FROM (SELECT query_id, clause_id, occur, field, boost, term, false AS ph FROM qterm
               UNION ALL SELECT query_id, clause_id, occur, field, boost, term, true FROM ps) q
         JOIN tdf d ON d.field = q.field AND d.term = q.term JOIN corp c ON c.field = q.field),
qn AS (SELECT query_id, CASE WHEN sum(x) > 0 THEN 1 / sqrt(sum(x)) ELSE 0 END AS norm
       FROM (SELECT query_id, clause_id, any_value(boost) ** 2 * CASE WHEN any_value(ph) THEN sum(idf) ** 2 ELSE sum(idf ** 2) END AS x
             FROM qidf WHERE occur <> 'must_not' GROUP BY query_id, clause_id)
       WHERE query_id IN (SELECT query_id FROM cl WHERE occur <> 'must_not' GROUP BY query_id HAVING count(*) > 1)
       GROUP BY query_id),
tm AS (SELECT q.query_id, q.clause_id, q.occur, q.boost, q.slot, q.n_slots, q.term, p.doc_id, n.norm,
              p.tf, d.df, 1 + ln(c.n_docs / (d.df + 1)) AS idf, p.field_len
       FROM qterm q JOIN tdf d ON d.field = q.field AND d.term = q.term
       JOIN corp c ON c.field = q.field
       JOIN post p ON p.field = q.field AND p.term = q.term
       LEFT JOIN qn n ON n.query_id = q.query_id),
th AS (SELECT query_id, clause_id, occur, doc_id,
              any_value(boost) * sum(sqrt(tf) * idf / sqrt(field_len) * coalesce(idf * norm, 1)) * count(DISTINCT slot)
              / any_value(n_slots) AS score
       FROM tm GROUP BY query_id, clause_id, occur, doc_id),
pm AS (SELECT s.query_id, s.clause_id, s.occur, s.boost, s.n_slots, s.slot, p.doc_id, p.field_len, n.norm,
              1 + ln(c.n_docs / (d.df + 1)) AS idf, unnest(p.positions) AS pos
       FROM ps s LEFT JOIN qn n ON n.query_id = s.query_id JOIN tdf d ON d.field = s.field AND d.term = s.term
       JOIN corp c ON c.field = s.field
       JOIN post p ON p.field = s.field AND p.term = s.term),
po AS (SELECT query_id, clause_id, occur, doc_id, pos - slot AS start, any_value(boost) AS boost,
              sum(idf) AS idf_sum, any_value(field_len) AS field_len, any_value(norm) AS norm
       FROM pm GROUP BY query_id, clause_id, occur, doc_id, pos - slot
       HAVING count(*) = any_value(n_slots)),
ph AS (SELECT query_id, clause_id, occur, doc_id, count(*) AS freq, any_value(idf_sum) AS idf_sum, any_value(field_len) AS field_len,
              any_value(boost) AS boost, any_value(norm) AS norm,
              any_value(boost) * (sqrt(count(*)) * any_value(idf_sum) / sqrt(any_value(field_len)))
              * coalesce(any_value(idf_sum) * any_value(norm), 1) AS score
       FROM po GROUP BY query_id, clause_id, occur, doc_id),
attrs AS ({attrs}),
rc AS (SELECT *, field AS rfield FROM cl WHERE kind IN ('numeric_range', 'date_range')),
every AS (SELECT DISTINCT doc_id FROM ({src})),
rh AS (SELECT c.query_id, c.clause_id, c.occur, a.doc_id, c.boost AS score
       FROM attrs a JOIN rc c ON a.field = c.rfield
       WHERE a.value IS NOT NULL
         AND (c.min IS NULL OR CASE WHEN c.incl_min THEN a.value >= c.min ELSE a.value > c.min END)
         AND (c.max IS NULL OR CASE WHEN c.incl_max THEN a.value <= c.max ELSE a.value < c.max END)),
ah AS (SELECT c.query_id, c.clause_id, c.occur, e.doc_id, c.boost AS score FROM every e, cl c WHERE c.kind = 'all'),
ic AS (SELECT query_id, clause_id, occur, boost, id
       FROM (SELECT *, unnest(terms) AS id FROM cl WHERE kind = 'ids')),
ih AS (SELECT DISTINCT c.query_id, c.clause_id, c.occur, d.doc_id, c.boost AS score
       FROM ic c JOIN every d ON CAST(d.doc_id AS VARCHAR) = c.id),
hits AS (SELECT * FROM th UNION ALL SELECT query_id, clause_id, occur, doc_id, score FROM ph UNION ALL SELECT * FROM rh UNION ALL SELECT * FROM ah UNION ALL SELECT * FROM ih),
qi AS (SELECT query_id, sum(CASE WHEN occur = 'must' THEN 1 ELSE 0 END) AS n_must,
              sum(CASE WHEN occur = 'should' THEN 1 ELSE 0 END) AS n_should
       FROM cl GROUP BY query_id),
qi2 AS (SELECT qi.*, CASE WHEN coalesce(o.min_should, 0) > 0 THEN o.min_should
                          WHEN n_must > 0 THEN 0 WHEN n_should > 0 THEN 1 ELSE 0 END AS min_eff,
               coalesce(o.size, 10) AS size, coalesce(o.from_, 0) AS from_
        FROM qi LEFT JOIN opts o USING (query_id)),
g AS (SELECT query_id, doc_id,
             sum(CASE WHEN occur = 'must' THEN 1 ELSE 0 END) AS m,
             sum(CASE WHEN occur = 'should' THEN 1 ELSE 0 END) AS s,
             sum(CASE WHEN occur = 'must_not' THEN 1 ELSE 0 END) AS neg,
             sum(CASE WHEN occur = 'must' THEN score ELSE 0.0 END) AS musts,
             sum(CASE WHEN occur = 'should' THEN score ELSE 0.0 END) AS shoulds
      FROM hits GROUP BY query_id, doc_id),
matches AS (SELECT g.query_id, g.doc_id, round(musts + shoulds * coalesce(s / nullif(n_should, 0), 0), 6) AS score
            FROM g JOIN qi2 USING (query_id)
            WHERE m = n_must AND neg = 0 AND s >= min_eff AND m + s > 0),
ranked AS (SELECT m.*, row_number() OVER (PARTITION BY m.query_id ORDER BY m.score DESC, m.doc_id) AS rnk,
                  count(*) OVER (PARTITION BY m.query_id) AS total_hits, q.size, q.from_
           FROM matches m JOIN qi2 q USING (query_id))"""


def search_scores_sql(qids: list[int]) -> str:
    return f"WITH {search_ctes(qids)}\nSELECT query_id, doc_id, score FROM matches"


def search_page_sql(qids: list[int] | None = None) -> str:
    return (f"WITH {search_ctes(qids)}\nSELECT query_id, CAST(rnk AS BIGINT) AS rank, doc_id, score, total_hits "
            f"FROM ranked WHERE rnk > from_ AND rnk <= from_ + size")


ORACLE: dict[str, str] = {
    "tokenize": f"WITH {TOK} SELECT doc_id, field, pos, term FROM tok",
    "all_field": f"""SELECT doc_id, '_all' AS field, unnest(range(len(t))) AS pos, unnest(t) AS term
      FROM (SELECT doc_id, list_concat(regexp_extract_all(lower(lang), {PAT}),
                                       regexp_extract_all(lower(text), {PAT})) AS t FROM documents)""",
    "build_postings": f"""WITH {TOK} SELECT doc_id, field, term, tf,
        array_to_string(positions, ',') AS positions, field_len FROM post""",
    "doc_freq": f"WITH {TOK} SELECT field, term, df FROM tdf",
    "field_length": f"WITH {TOK} SELECT doc_id, field, n_terms FROM flen",
    "corpus_stats": f"WITH {TOK} SELECT field, n_docs, round(avg_len, 6) AS avg_len FROM corp",
    "list_fields": """SELECT DISTINCT field FROM (
        SELECT 'text' AS field FROM documents WHERE len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) > 0
        UNION ALL SELECT 'lang' FROM documents WHERE len(regexp_extract_all(lower(lang), '[\\p{L}\\p{N}]+')) > 0
        UNION ALL SELECT 'source' FROM documents WHERE len(regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+')) > 0)""",
    "doc_postings": f"""WITH {TOK} SELECT doc_id, field, term, tf, array_to_string(positions, ',') AS positions
        FROM post WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "q_batch": search_page_sql(),
    "topk_pages": f"SELECT query_id, rank, doc_id, score FROM ({search_page_sql()})",
}

from pagesearch.plans.oracle_pages import ORACLE_PAGES  # noqa: E402

ORACLE.update(ORACLE_PAGES)

for _name, _qids in [("q_term", [1, 11]), ("q_must_not", [2, 4]), ("q_should_min", [3]),
                     ("q_match_phrase", [5]), ("q_phrase_gap", [6]), ("q_match_fuzzy", [7]),
                     ("q_prefix", [8]), ("q_numeric_range", [9]), ("q_wildcard", [10, 14]),
                     ("q_match", [12]), ("q_all_ids", [13])]:
    ORACLE[_name] = search_scores_sql(_qids)

from pagesearch.plans.oracle_results import ORACLE_RESULTS  # noqa: E402

ORACLE.update(ORACLE_RESULTS)
