"""Stand-in inputs derived from the driver tables (FIXTURES.md §2).

These only shape rows into the schemas the jobs expect (links, captures,
stored documents, a folder tree, change events, a clause batch); they do none
of the jobs' work.  The SQL is the same text the DuckDB oracles carry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagesearch.schemas import CLAUSES, QUERY_OPTS
from pagesearch.sources.tables import table

LINKS_SQL = """
select url, concat('folder', cast(page_id % 7 as string)) as folder,
       case when page_id % 4 = 0 then '' else concat('saved ', cast(page_id as string)) end as title,
       page_id as seq
from pages
union all
select url, 'again', concat('again ', cast(page_id as string)), page_id + 1000000
from pages where page_id % 10 = 0
union all
select 'http://a b', 'bad', 'invalid url', cast(2000000 as bigint)
union all
select 'http://never.example.com/x', 'bad', 'never captured', cast(2000001 as bigint)
"""

ERROR_PAGE = "'<html><head><title>error</title></head><body>error page</body></html>'"

CAPTURES_SQL = f"""
select url, 1 as attempt, 'http' as renderer,
       case page_id % 6 when 0 then 403 when 1 then 404 when 2 then 503 else 200 end as status,
       case when page_id % 6 <= 2 then {ERROR_PAGE} else html end as html
from pages
union all
select url, 2, 'http', case page_id % 6 when 0 then 200 else 503 end,
       case page_id % 6 when 0 then html else {ERROR_PAGE} end
from pages where page_id % 6 in (0, 2)
union all
select url, 3, 'http', 503, {ERROR_PAGE}
from pages where page_id % 6 = 2
union all
select url, 2, 'browser', 200, html from pages where page_id % 6 = 1
"""

STORE_SEED_SQL = """
select url, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, concat('old ', cast(page_id as string)) as title,
       html, concat('old text ', cast(page_id as string)) as text, '' as excerpt, '' as author,
       regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) as site_name, 'seed' as folder
from pages where page_id % 3 = 0
"""

NODES_SQL = """
select 'root' as node_id, cast(null as string) as parent_id, 'bookmarks' as name, cast(null as string) as url
union all
select distinct concat('h:', regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), 'root',
       regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1), cast(null as string)
from pages
union all
select concat('p:', cast(page_id as string)), concat('h:', regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)),
       concat('page ', cast(page_id as string)), url
from pages
"""

CHANGE_EVENTS_SQL = """
select ts, case event_type when 'click' then 'write' when 'purchase' then 'create'
                           when 'error' then 'remove' else 'chmod' end as kind
from events
"""


def _derived(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {source}", "from {src}"), src=table(spark, sf_dir, source))


def links(spark, sf_dir): return _derived(spark, sf_dir, LINKS_SQL, "pages")
def captures(spark, sf_dir): return _derived(spark, sf_dir, CAPTURES_SQL, "pages")
def store_seed(spark, sf_dir): return _derived(spark, sf_dir, STORE_SEED_SQL, "pages")
def nodes(spark, sf_dir): return _derived(spark, sf_dir, NODES_SQL, "pages")
def change_events(spark, sf_dir): return _derived(spark, sf_dir, CHANGE_EVENTS_SQL, "events")


# Clause batch over the `documents` corpus (field `text`).  Columns:
# query_id, clause_id, occur, kind, field, terms, min, max, incl_min, incl_max,
# fuzziness, prefix_length, boost
CLAUSE_ROWS = [
    (1, 1, "should", "term", "text", ["thre"], None, None, None, None, None, None, 1.0),
    (2, 1, "must", "term", "text", ["in"], None, None, None, None, None, None, 1.0),
    (2, 2, "must_not", "term", "text", ["the"], None, None, None, None, None, None, 1.0),
    (3, 1, "should", "term", "text", ["in"], None, None, None, None, None, None, 2.0),
    (3, 2, "should", "term", "text", ["of"], None, None, None, None, None, None, 1.0),
    (3, 3, "should", "term", "text", ["thre"], None, None, None, None, None, None, 1.0),
    (4, 1, "must_not", "term", "text", ["the"], None, None, None, None, None, None, 1.0),
    (5, 1, "should", "match_phrase", "text", ["in the"], None, None, None, None, None, None, 1.0),
    (6, 1, "should", "phrase", "text", ["in", None, "of"], None, None, None, None, None, None, 1.0),
    (7, 1, "should", "match", "text", ["thre"], None, None, None, None, 1, 2, 1.0),
    (8, 1, "should", "prefix", "text", ["thre"], None, None, None, None, None, None, 1.0),
    (9, 1, "must", "numeric_range", "n_chars", None, 1000.0, 2000.0, True, False, None, None, 1.0),
    (9, 2, "should", "term", "text", ["thre"], None, None, None, None, None, None, 1.0),
    (10, 1, "must", "all", None, None, None, None, None, None, None, None, 1.0),
    (10, 2, "must_not", "wildcard", "text", ["th*"], None, None, None, None, None, None, 1.0),
    (11, 1, "should", "term", "text", ["zzzqqqxxx"], None, None, None, None, None, None, 1.0),
    (12, 1, "should", "match", "text", ["The thre OF"], None, None, None, None, 0, 0, 1.0),
    (13, 1, "must", "ids", None, ["1", "2", "3", "5", "8", "13", "21"], None, None, None, None, None, None, 1.5),
    (13, 2, "should", "term", "text", ["the"], None, None, None, None, None, None, 1.0),
    (14, 1, "should", "wildcard", "text", ["th?e*"], None, None, None, None, None, None, 1.0),
]

# query_id, min_should, size, from
OPTS_ROWS = [(1, 0, 10, 0), (2, 0, 10, 0), (3, 2, 10, 0), (4, 0, 10, 0), (5, 0, 10, 0),
             (6, 0, 10, 0), (7, 0, 10, 0), (8, 0, 10, 0), (9, 0, 10, 0), (10, 0, 10, 0),
             (11, 0, 10, 0), (12, 0, 20, 0), (13, 0, 10, 0), (14, 0, 10, 10)]


def clauses(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else CLAUSE_ROWS, CLAUSES)


def query_opts(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else OPTS_ROWS, QUERY_OPTS)
