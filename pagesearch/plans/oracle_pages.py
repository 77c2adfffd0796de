"""DuckDB twins for sources, extraction, language and ingest entries."""

from __future__ import annotations

from pagesearch.functions import text as tx
from pagesearch.operators.language import LANG_TOKEN_PATTERN, PROB_FLOOR, PROFILE_SIZE
from pagesearch.plans.catalog_pages import NEW_STORE_SQL
from pagesearch.schemas import SUPPORTED_LANGS, TEXT_FIELDS
from pagesearch.sources import fixtures as fx


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d_decode(e: str) -> str:
    for ent, ch in tx.ENTITIES:
        e = f"replace({e}, {sq(ent)}, {sq(ch)})"
    return e


def d_squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, {sq(tx.SPACE_RE)}, ' ', 'g'))"


def d_text(e: str) -> str:
    return d_decode(d_squeeze(f"regexp_replace({e}, {sq(tx.TAG_RE)}, ' ', 'g')"))


def d_clean(h: str) -> str:
    e = f"regexp_replace(coalesce({h}, ''), {sq(tx.COMMENT_RE)}, ' ', 'g')"
    e = f"regexp_replace({e}, {sq(tx.SCRIPT_RE)}, ' ', 'g')"
    return f"regexp_replace({e}, {sq(tx.STYLE_RE)}, ' ', 'g')"


def d_meta(h: str, pat: str) -> str:
    return d_decode(d_squeeze(f"regexp_extract(coalesce({h}, ''), {sq(pat)}, 1)"))


VALID_URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/?#@]+(?:[/?#]\S*)?$"
HOST_PART = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]+)"


def d_host(u: str) -> str:
    return f"CASE WHEN regexp_matches({u}, {sq(VALID_URL)}) THEN regexp_extract({u}, {sq(HOST_PART)}, 1) END"


def extract_ctes(src: str, name: str = "px") -> str:
    """``src`` gives (key columns..., url, html).  Produces CTE ``name`` with
    x_title, content, x_text, x_excerpt, x_author, x_site."""
    site = d_meta("html", tx.META_SITE_RE)
    meta_desc = d_meta("html", tx.META_DESC_RE)
    return f"""{name}0 AS (SELECT *, {d_clean('html')} AS clean FROM ({src})),
{name}1 AS (SELECT *, regexp_extract(clean, {sq(tx.ARTICLE_RE)}, 1) AS art,
                  regexp_extract(clean, {sq(tx.BODY_RE)}, 1) AS bod FROM {name}0),
{name}2 AS (SELECT *, trim(CASE WHEN art <> '' THEN art ELSE regexp_replace(
                  CASE WHEN bod <> '' THEN bod ELSE clean END, {sq(tx.CHROME_RE)}, ' ', 'g') END) AS content
           FROM {name}1),
{name} AS (SELECT * EXCLUDE (clean, art, bod),
                 {d_decode(d_squeeze(f"regexp_extract(html, {sq(tx.TITLE_RE)}, 1)"))} AS x_title,
                 {d_text('content')} AS x_text,
                 CASE WHEN {meta_desc} <> '' THEN {meta_desc}
                      ELSE {d_text(f"regexp_extract(content, {sq(tx.FIRST_P_RE)}, 1)")} END AS x_excerpt,
                 {d_meta('html', tx.META_AUTHOR_RE)} AS x_author,
                 CASE WHEN {site} <> '' THEN {site} ELSE coalesce({d_host('url')}, '') END AS x_site
          FROM {name}2)"""


PAGES_X = extract_ctes("SELECT page_id, url, html FROM pages")

LPAT = sq(LANG_TOKEN_PATTERN)
PROFILE_CTES = f"""lt AS (SELECT lang, unnest(regexp_extract_all(lower(text), {LPAT})) AS term
        FROM documents WHERE lang IS NOT NULL),
cnts AS (SELECT lang, term, count(*) AS cnt FROM lt GROUP BY lang, term),
tot AS (SELECT lang, sum(cnt) AS total FROM cnts GROUP BY lang),
prof AS (SELECT c.lang, c.term, c.cnt, c.rank, c.cnt / t.total AS p
         FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, term) AS rank FROM cnts) c
         JOIN tot t USING (lang) WHERE c.rank <= {PROFILE_SIZE}),
nl AS (SELECT count(DISTINCT lang) AS n_langs FROM prof)"""


def detect_ctes(src: str, keys: list[str], name: str = "det") -> str:
    """``src`` gives keys and ``txt``; CTE ``name`` has keys, best, confidence, lang."""
    k = ", ".join(keys)
    return f"""{name}t AS (SELECT {k}, unnest(regexp_extract_all(lower(txt), {LPAT})) AS term FROM ({src})),
{name}f AS (SELECT {k}, term, count(*) AS tf FROM {name}t WHERE term IN (SELECT term FROM prof)
          GROUP BY {k}, term),
{name}l AS (SELECT {k}, p.lang, sum(tf * (ln(p.p) - ln({PROB_FLOOR!r}))) AS s
          FROM {name}f JOIN prof p USING (term) GROUP BY {k}, p.lang),
{name}r AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY s DESC, lang) AS rn,
                 max(s) OVER (PARTITION BY {k}) AS s_hit, count(*) OVER (PARTITION BY {k}) AS n_hit
          FROM {name}l),
{name}m AS (SELECT r.*, nl.n_langs,
                 CASE WHEN nl.n_langs - r.n_hit > 0 THEN greatest(r.s_hit, 0.0) ELSE r.s_hit END AS s_max
          FROM {name}r r, nl),
{name} AS (SELECT {k}, any_value(CASE WHEN rn = 1 THEN lang END) AS best,
                 1.0 / (sum(exp(s - s_max)) + (any_value(n_langs) - any_value(n_hit)) * exp(-any_value(s_max)))
                 AS confidence
          FROM {name}m GROUP BY {k})"""


def det_lang(conf: str = "confidence", best: str = "best") -> str:
    return f"CASE WHEN {conf} > 0.95 THEN {best} ELSE 'en' END"


LANGS_IN = ", ".join(sq(x) for x in SUPPORTED_LANGS)

LINKS_CTE = f"lk AS ({fx.LINKS_SQL})"
CAPS_CTE = f"cap AS ({fx.CAPTURES_SQL})"
SEED_CTE = f"seed AS ({fx.STORE_SEED_SQL})"
NODES_CTE = f"nodes AS ({fx.NODES_SQL})"
BEST_CTE = """best AS (SELECT url, attempt, renderer, status, html FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY
        CASE WHEN renderer = 'http' AND status = 200 THEN 0 WHEN renderer = 'browser' THEN 1 ELSE 2 END,
        attempt DESC) AS rn FROM cap) WHERE rn = 1)"""
DEDUPE_FIRST = """SELECT url, arg_min(folder, seq) AS folder, arg_min(title, seq) AS title, min(seq) AS seq
                  FROM {src} GROUP BY url"""
LINKS_PAGES = f"""WITH {PAGES_X}, {LINKS_CTE}
SELECT lk.url, lk.seq, lk.title AS saved, px.x_title, px.x_excerpt, px.x_author, px.x_site
FROM lk LEFT JOIN px ON lk.url = px.url"""

def doc_build_sql(order: str = "seq", with_seed: bool = True) -> str:
    """C10 in SQL; ``order`` decides which copy of a repeated URL is kept
    (the stream keeps the first file, then the lowest seq)."""
    valid = "(SELECT * FROM lk WHERE " + d_host("url") + " IS NOT NULL)"
    return f"""WITH {LINKS_CTE}, {CAPS_CTE}, {SEED_CTE}, {BEST_CTE}, {PROFILE_CTES},
dd AS (SELECT url, arg_min(folder, {order}) AS folder, arg_min(title, {order}) AS title,
              arg_min(seq, {order}) AS seq FROM {valid} GROUP BY url),
todo AS (SELECT * FROM dd WHERE {"url NOT IN (SELECT url FROM seed)" if with_seed else "true"}),
rws AS (SELECT t.url, t.folder, t.title, t.seq, b.html FROM todo t JOIN best b USING (url)),
{extract_ctes("SELECT * FROM rws", "bx")},
sx AS (SELECT url, coalesce(folder, '') AS folder, seq,
              coalesce(coalesce(nullif(x_title, ''), title), '') AS title, coalesce(content, '') AS html,
              coalesce(x_text, '') AS text, coalesce(x_excerpt, '') AS excerpt,
              coalesce(x_author, '') AS author, coalesce(x_site, '') AS site_name FROM bx),
fl AS (SELECT url, 'title' AS fname, title AS txt FROM sx WHERE title <> ''
       UNION ALL SELECT url, 'excerpt', excerpt FROM sx WHERE excerpt <> ''
       UNION ALL SELECT url, 'text', text FROM sx WHERE text <> ''),
{detect_ctes("SELECT * FROM fl", ["url", "fname"])},
wide AS (SELECT url, max(CASE WHEN fname = 'title' THEN {det_lang()} END) AS lt,
                max(CASE WHEN fname = 'excerpt' THEN {det_lang()} END) AS le,
                max(CASE WHEN fname = 'text' THEN {det_lang()} END) AS ltx
         FROM det GROUP BY url),
picked AS (SELECT sx.*, coalesce(lt, le, ltx, 'en') AS lang0 FROM sx LEFT JOIN wide USING (url))
SELECT url, CASE WHEN lang0 IN ({LANGS_IN}) THEN lang0 ELSE 'en' END AS lang, title, text, excerpt,
       author, site_name, folder, seq FROM picked"""


DOC_BUILD = doc_build_sql()
STREAM_STORE = doc_build_sql(order="(seq % 3, seq)", with_seed=False)

LANG_COLS = ", ".join(f"CASE WHEN lang = {sq(code)} THEN {f} END AS {code}_{f}"
                      for code in SUPPORTED_LANGS for f in TEXT_FIELDS)

ORACLE_PAGES: dict[str, str] = {
    "link_scan": f"WITH {LINKS_CTE} SELECT url, folder, title, seq FROM lk",
    "folder_paths": f"""WITH RECURSIVE {NODES_CTE},
        t (node_id, url, path, depth) AS (
          SELECT node_id, url, name, 0 FROM nodes WHERE parent_id IS NULL
          UNION ALL
          SELECT n.node_id, n.url, concat(t.path, '/', n.name), t.depth + 1
          FROM nodes n JOIN t ON n.parent_id = t.node_id)
        SELECT node_id, url, path, CAST(depth AS BIGINT) AS depth FROM t""",
    "capture_scan": f"WITH {CAPS_CTE} SELECT url, attempt, renderer, status FROM cap",
    "store_scan": f"WITH {SEED_CTE} SELECT * FROM seed",
    "store_lookup": f"""WITH {SEED_CTE}, {LINKS_CTE}
        SELECT url, title, lang FROM seed WHERE url IN (SELECT url FROM lk)""",
    "store_upsert": f"""WITH {SEED_CTE}, nw AS ({NEW_STORE_SQL}),
        u AS (SELECT url, lang, title, text, excerpt, author, site_name, folder, 0 AS isnew, NULL::BIGINT AS o FROM seed
              UNION ALL SELECT url, lang, title, text, excerpt, author, site_name, folder, 1, seq FROM nw)
        SELECT url, lang, title, text, excerpt, author, site_name, folder FROM (
          SELECT *, row_number() OVER (PARTITION BY url ORDER BY isnew DESC, o DESC NULLS LAST) AS rn FROM u)
        WHERE rn = 1""",
    "doc_to_json": f"""WITH {SEED_CTE}
        SELECT url, coalesce(lang, '') || '_title' AS key, coalesce(title, '') AS value FROM seed
        UNION ALL SELECT url, coalesce(lang, '') || '_html', coalesce(html, '') FROM seed
        UNION ALL SELECT url, coalesce(lang, '') || '_text', coalesce(text, '') FROM seed
        UNION ALL SELECT url, coalesce(lang, '') || '_excerpt', coalesce(excerpt, '') FROM seed
        UNION ALL SELECT url, 'lang', coalesce(lang, '') FROM seed
        UNION ALL SELECT url, 'author', coalesce(author, '') FROM seed
        UNION ALL SELECT url, 'siteName', coalesce(site_name, '') FROM seed
        UNION ALL SELECT url, 'url', coalesce(url, '') FROM seed
        UNION ALL SELECT url, 'folder', coalesce(folder, '') FROM seed""",
    "doc_from_json": f"WITH {SEED_CTE} SELECT * FROM seed",
    "drop_html": f"""WITH {SEED_CTE} SELECT url, array_to_string(list_sort(['author', 'folder', 'lang',
        'siteName', 'url', lang || '_excerpt', lang || '_text', lang || '_title']), ',') AS keys FROM seed""",
    "host_of": f"""WITH {LINKS_CTE} SELECT url, seq, {d_host('url')} AS host,
        {d_host('url')} IS NOT NULL AS valid FROM lk""",
    "title_fallback": f"""SELECT url, seq, coalesce(nullif(x_title, ''), saved) AS title FROM ({LINKS_PAGES})""",
    "null_to_empty": f"""SELECT url, seq, coalesce(x_title, '') AS title, coalesce(x_excerpt, '') AS excerpt,
        coalesce(x_author, '') AS author, coalesce(x_site, '') AS site_name FROM ({LINKS_PAGES})""",
    "capture_class": f"""WITH {CAPS_CTE} SELECT url, attempt, renderer, status,
        CASE WHEN status = 200 THEN 'ok' WHEN status IN (403, 503) AND attempt < 3 THEN 'retry'
             ELSE 'browser' END AS class FROM cap""",
    "lang_route": f"""SELECT page_id, raw, CASE WHEN raw IN ({LANGS_IN}) THEN raw ELSE 'en' END AS lang
        FROM (SELECT page_id, lower(regexp_extract(html, {sq(tx.HTML_LANG_RE)}, 1)) AS raw FROM pages)""",
    "lang_columns": f"WITH {SEED_CTE} SELECT url, lang, {LANG_COLS} FROM seed",
    "page_title": f"WITH {PAGES_X} SELECT page_id, x_title AS title FROM px",
    "page_content": f"WITH {PAGES_X} SELECT page_id, content FROM px",
    "page_text": f"WITH {PAGES_X} SELECT page_id, x_text AS text FROM px",
    "page_excerpt": f"WITH {PAGES_X} SELECT page_id, x_excerpt AS excerpt FROM px",
    "page_meta": f"WITH {PAGES_X} SELECT page_id, x_author AS author, x_site AS site_name FROM px",
    "boilerplate_blocks": f"""WITH b0 AS (
          SELECT page_id, coalesce({d_host('url')}, '') AS host, {d_clean('html')} AS clean FROM pages),
        b1 AS (SELECT page_id, host, regexp_split_to_array(CASE WHEN regexp_extract(clean, {sq(tx.BODY_RE)}, 1) <> ''
                 THEN regexp_extract(clean, {sq(tx.BODY_RE)}, 1) ELSE clean END, {sq(tx.BLOCK_SPLIT_RE)}) AS parts
               FROM b0),
        b2 AS (SELECT page_id, host, unnest(parts) AS block, unnest(range(len(parts))) AS pos FROM b1),
        b3 AS (SELECT page_id, host, pos, {d_text('block')} AS btext,
                 {d_text("array_to_string(regexp_extract_all(block, " + sq(tx.LINK_RE) + ", 1), ' ')")} AS link FROM b2),
        b4 AS (SELECT *, md5(btext) AS h, length(link) / length(btext) AS share, len(string_split(btext, ' ')) AS words
               FROM b3 WHERE btext <> ''),
        b5 AS (SELECT *, share > {tx.LINK_SHARE} OR (coalesce(lag(share) OVER w, 0) > {tx.BEFORE_LINK_SHARE}
                 AND words <= {tx.SHORT_WORDS} AND coalesce(lead(words) OVER w, 0) <= {tx.NEXT_WORDS}) AS dense
               FROM b4 WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
        rep AS (SELECT host, h FROM b4 GROUP BY host, h HAVING count(DISTINCT page_id) >= 2),
        b6 AS (SELECT b5.*, r.h IS NULL AND NOT dense AS kept FROM b5 LEFT JOIN rep r ON b5.host = r.host AND b5.h = r.h)
        SELECT p.page_id, count(btext) AS n_blocks, count(btext) FILTER (kept) AS n_kept,
               coalesce(string_agg(btext, ' ' ORDER BY pos) FILTER (kept), '') AS text
        FROM pages p LEFT JOIN b6 USING (page_id) GROUP BY p.page_id""",
    "lang_profiles": f"WITH {PROFILE_CTES} SELECT lang, term, cnt, rank, round(p, 9) AS p FROM prof",
    "lang_detect": f"""WITH {PROFILE_CTES}, {detect_ctes("SELECT doc_id, text AS txt FROM documents", ["doc_id"])}
        SELECT doc_id, {det_lang()} AS lang, best, round(coalesce(confidence, 0.0), 6) AS confidence
        FROM documents LEFT JOIN det USING (doc_id)""",
    "lang_field_priority": f"""WITH {PAGES_X}, {PROFILE_CTES},
        fl AS (SELECT page_id, 'title' AS fname, x_title AS txt FROM px WHERE x_title IS NOT NULL AND x_title <> ''
               UNION ALL SELECT page_id, 'excerpt', x_excerpt FROM px WHERE x_excerpt IS NOT NULL AND x_excerpt <> ''
               UNION ALL SELECT page_id, 'text', x_text FROM px WHERE x_text IS NOT NULL AND x_text <> ''),
        {detect_ctes("SELECT * FROM fl", ["page_id", "fname"])},
        wide AS (SELECT page_id, max(CASE WHEN fname = 'title' THEN {det_lang()} END) AS lang_title,
                        max(CASE WHEN fname = 'excerpt' THEN {det_lang()} END) AS lang_excerpt,
                        max(CASE WHEN fname = 'text' THEN {det_lang()} END) AS lang_text
                 FROM det GROUP BY page_id)
        SELECT px.page_id, lang_title, lang_excerpt, lang_text,
               coalesce(lang_title, lang_excerpt, lang_text, 'en') AS lang
        FROM px LEFT JOIN wide USING (page_id)""",
    "doc_build": DOC_BUILD,
    "stream_ingest": f"""SELECT url, lang, title, text, excerpt, author, site_name, folder
        FROM ({STREAM_STORE})""",
    "stream_dedupe": f"WITH {LINKS_CTE} SELECT DISTINCT url FROM lk",
    "single_flight": f"""WITH {LINKS_CTE}, s AS ({STREAM_STORE}),
        l AS (SELECT seq % 3 AS batch, count(*) AS n_links FROM lk GROUP BY 1),
        n AS (SELECT seq % 3 AS batch, count(*) AS n_new FROM s GROUP BY 1)
        SELECT l.batch, l.n_links, coalesce(n.n_new, 0) AS n_new_docs FROM l LEFT JOIN n USING (batch)""",
    "change_ticks": f"""WITH ce AS ({fx.CHANGE_EVENTS_SQL})
        SELECT (epoch_us(ts) // 30000000) * 30 AS window_start, (epoch_us(ts) // 30000000) * 30 + 30 AS window_end,
               count(*) AS n_events FROM ce WHERE kind IN ('write', 'create') GROUP BY 1, 2""",
    "unseen_links": f"""WITH {LINKS_CTE}, {SEED_CTE}
        SELECT url, seq FROM lk WHERE url NOT IN (SELECT url FROM seed)""",
    "force_refresh": f"""WITH {LINKS_CTE} SELECT url, max(seq) AS seq, arg_max(folder, seq) AS folder
        FROM lk GROUP BY url""",
    "links_with_capture": f"""WITH {LINKS_CTE}, {CAPS_CTE}, {BEST_CTE},
        dd AS ({DEDUPE_FIRST.format(src="lk")})
        SELECT dd.url, dd.seq, b.status, length(b.html)::BIGINT AS html_len FROM dd JOIN best b USING (url)""",
    "pending_links": f"""WITH {LINKS_CTE}, {CAPS_CTE}
        SELECT url, seq FROM lk WHERE url NOT IN (SELECT url FROM cap)""",
    "best_capture": f"""WITH {CAPS_CTE}, {BEST_CTE}
        SELECT url, attempt, renderer, status, md5(html) AS html_md5 FROM best""",
    "dedupe_links_first": f"WITH {LINKS_CTE} {DEDUPE_FIRST.format(src='lk')}",
    "dedupe_links_last": f"""WITH {LINKS_CTE} SELECT url, arg_max(folder, seq) AS folder,
        arg_max(title, seq) AS title, max(seq) AS seq FROM lk GROUP BY url""",
    "fetch_slots": f"""WITH {LINKS_CTE}, h AS (SELECT url, {d_host('url')} AS host, seq FROM lk)
        SELECT url, host, seq, rn, CAST(floor((rn - 1) / 2) AS BIGINT) AS slot FROM (
          SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) AS rn FROM h WHERE host IS NOT NULL)""",
    "uniform_pick": f"""WITH {LINKS_CTE} SELECT folder, arg_min(url, md5('s1' || url)) AS url,
        arg_min(seq, md5('s1' || url)) AS seq FROM lk GROUP BY folder""",
}
