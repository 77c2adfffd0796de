"""Schemas of the data model and the fixed values the engine relies on."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# FIXED VALUES (must stay as written for results to match)
# --------------------------------------------------------------------------

# Supported analysis languages (ISO 639-1); anything else is routed to "en".
SUPPORTED_LANGS = ["en", "ar", "da", "nl", "fi", "fr", "hu", "it", "de", "fa",
                   "pt", "ro", "ru", "es", "sv", "tr"]
DEFAULT_LANG = "en"

# Language detection: accept the best language only above this confidence.
LANG_MIN_CONFIDENCE = 0.95

# Capture handling: HTTP 403 and 503 are retried while attempt < 3.
RETRY_STATUSES = [403, 503]
MAX_ATTEMPTS = 3

# Crawl plan: at most this many fetches per host per second.
FETCH_PER_HOST_PER_SEC = 2

# Search defaults: result size 10, from 0; range bounds min/start inclusive,
# max/end exclusive; fuzziness 0 and prefix_length 0; boost 1.0.
DEFAULT_SIZE = 10
DEFAULT_FROM = 0

# Watch tick.
WATCH_INTERVAL = "30 seconds"

# Token: maximal run of Unicode letters or digits in the lower-cased text.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"

# Index fields and their analysis: text fields are analysed in the row's
# language, folder and url with the default language, keyword fields are
# indexed whole.
TEXT_FIELDS = ["title", "text", "excerpt"]
DEFAULT_ANALYZED_FIELDS = ["folder", "url"]
KEYWORD_FIELDS = ["author", "lang", "site_name"]

# --------------------------------------------------------------------------
# Schemas
# --------------------------------------------------------------------------

LINKS = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("folder", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("seq", T.LongType()),
])

CAPTURES = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("renderer", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("html", T.StringType()),
])

STORE_COLUMNS = ["url", "lang", "title", "html", "text", "excerpt", "author",
                 "site_name", "folder"]
STORE = T.StructType([T.StructField(c, T.StringType()) for c in STORE_COLUMNS])

NODES = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()),
])

CLAUSES = T.StructType([
    T.StructField("query_id", T.IntegerType()),
    T.StructField("clause_id", T.IntegerType()),
    T.StructField("occur", T.StringType()),      # must | should | must_not
    T.StructField("kind", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("terms", T.ArrayType(T.StringType())),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("incl_min", T.BooleanType()),
    T.StructField("incl_max", T.BooleanType()),
    T.StructField("fuzziness", T.IntegerType()),
    T.StructField("prefix_length", T.IntegerType()),
    T.StructField("boost", T.DoubleType()),
])

QUERY_OPTS = T.StructType([
    T.StructField("query_id", T.IntegerType()),
    T.StructField("min_should", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("from", T.IntegerType()),
])

CLAUSE_KINDS = ["term", "prefix", "numeric_range", "date_range", "match",
                "match_phrase", "phrase", "wildcard", "regexp", "all", "ids"]


def with_field(schema: T.StructType, name: str, dtype: T.DataType) -> T.StructType:
    """A copy of ``schema`` with one more field (``StructType.add`` mutates)."""
    return T.StructType(list(schema.fields) + [T.StructField(name, dtype)])
