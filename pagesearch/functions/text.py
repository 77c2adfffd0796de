"""Tokens, URL hosts, HTML extraction and entity decoding as Column
expressions.  Every pattern is plain regex without look-around or
back-references, so the same pattern runs in other SQL engines too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesearch.schemas import TOKEN_PATTERN

# --------------------------------------------------------------------------
# FIXED VALUES: HTML entities decoded, in this order ("&amp;" always last so
# that "&amp;lt;" becomes "&lt;", not "<").
# --------------------------------------------------------------------------
ENTITIES = [
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", " "),
    ("&middot;", "·"),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&amp;", "&"),
]

# FIXED VALUES: extraction patterns.
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"
SCRIPT_RE = r"(?is)<script[^>]*>.*?</script>"
STYLE_RE = r"(?is)<style[^>]*>.*?</style>"
COMMENT_RE = r"(?s)<!--.*?-->"
ARTICLE_RE = r"(?is)<article[^>]*>(.*?)</article>"
BODY_RE = r"(?is)<body[^>]*>(.*?)</body>"
CHROME_RE = r"(?is)<(nav|footer|header|aside)[^>]*>.*?</(nav|footer|header|aside)>"
TAG_RE = r"<[^>]*>"
SPACE_RE = r"[ \t\n\r\f]+"
FIRST_P_RE = r"(?is)<p(?:[ \t\n\r\f][^>]*)?>(.*?)(?:</p>|<p[ \t\n\r\f>]|</article>|</body>|\z)"
META_DESC_RE = r'(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"'
META_AUTHOR_RE = r'(?is)<meta[^>]*name="author"[^>]*content="([^"]*)"'
META_SITE_RE = r'(?is)<meta[^>]*property="og:site_name"[^>]*content="([^"]*)"'
HTML_LANG_RE = r'(?is)<html[^>]*lang="([a-zA-Z]+)'
BLOCK_SPLIT_RE = r"(?i)<(?:p|div|li|h[1-6]|tr|br|section|article|nav|footer|header|aside|ul|ol|table)(?:[ \t\n\r\f][^>]*)?/?>"

LINK_RE = r"(?is)<a(?:[ \t\n\r\f][^>]*)?>(.*?)(?:</a>|\z)"

# FIXED VALUES: thresholds of the published decision tree on link density and
# number of words (Kohlschuetter, Fankhauser, Nejdl: Boilerplate Detection
# using Shallow Text Features, 2010).
LINK_SHARE = 0.333333
BEFORE_LINK_SHARE = 0.555556
SHORT_WORDS = 40
NEXT_WORDS = 17


def tokens(col: Column | str) -> Column:
    """array<string> of tokens of ``col`` (lower-cased letter/digit runs)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def decode_entities(col: Column) -> Column:
    out = col
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, SPACE_RE, " "))


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, TAG_RE, " ")


def html_to_text(col: Column) -> Column:
    """Tags to spaces, whitespace squeezed, entities decoded."""
    return decode_entities(squeeze(strip_tags(col)))


def strip_code(html: Column) -> Column:
    """Remove comments, scripts and styles first: script bodies may hold
    closing tags (``var t="</p>"``) that would fool any later split."""
    out = F.regexp_replace(html, COMMENT_RE, " ")
    out = F.regexp_replace(out, SCRIPT_RE, " ")
    return F.regexp_replace(out, STYLE_RE, " ")


def title_of(html: Column) -> Column:
    return decode_entities(squeeze(F.regexp_extract(html, TITLE_RE, 1)))


def content_of(html: Column) -> Column:
    """Main content HTML: the first <article>, else the <body> without
    navigation, header, footer and aside blocks, else the whole cleaned page."""
    clean = strip_code(F.coalesce(html, F.lit("")))
    article = F.regexp_extract(clean, ARTICLE_RE, 1)
    body = F.regexp_extract(clean, BODY_RE, 1)
    fallback = F.regexp_replace(F.when(body != "", body).otherwise(clean), CHROME_RE, " ")
    return F.trim(F.when(article != "", article).otherwise(fallback))


def excerpt_of(html: Column, content: Column) -> Column:
    """Meta description, else the text of the first paragraph of the content."""
    meta = decode_entities(squeeze(F.regexp_extract(F.coalesce(html, F.lit("")), META_DESC_RE, 1)))
    first_p = html_to_text(F.regexp_extract(content, FIRST_P_RE, 1))
    return F.when(meta != "", meta).otherwise(first_p)


def meta_of(html: Column, pattern: str) -> Column:
    return decode_entities(squeeze(F.regexp_extract(F.coalesce(html, F.lit("")), pattern, 1)))


def host_of(url: Column) -> Column:
    """Host of a URL (no port, no user info); null for an invalid URL."""
    return F.try_parse_url(url, F.lit("HOST"))

