"""Page-to-document extraction as column expressions and corpus jobs
(C01-C06) and the scalar document rules (B01-B05, B09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesearch.functions import text as tx
from pagesearch.schemas import MAX_ATTEMPTS, RETRY_STATUSES
from pagesearch.session import BROADCAST_MAX_ROWS, fits, materialize


def extract_title(pages: DataFrame, html: str = "html") -> DataFrame:
    """Page title, whitespace squeezed, entities decoded."""
    return pages.withColumn("title", tx.title_of(F.col(html)))


def extract_content(pages: DataFrame, html: str = "html") -> DataFrame:
    """Main content HTML (article, else body without page chrome)."""
    return pages.withColumn("content", tx.content_of(F.col(html)))


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Plain text of the main content."""
    return pages.withColumn("text", tx.html_to_text(tx.content_of(F.col(html))))


def extract_excerpt(pages: DataFrame, html: str = "html") -> DataFrame:
    """Meta description, else the first paragraph of the content."""
    return pages.withColumn("excerpt", tx.excerpt_of(F.col(html), tx.content_of(F.col(html))))


def extract_meta(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Author and site name from meta tags; site falls back to the host."""
    site = tx.meta_of(F.col(html), tx.META_SITE_RE)
    return (pages.withColumn("author", tx.meta_of(F.col(html), tx.META_AUTHOR_RE))
            .withColumn("site_name", F.when(site != "", site)
                        .otherwise(F.coalesce(tx.host_of(F.col(url)), F.lit("")))))


def extract_all(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Title, content, text, excerpt, author and site name in one projection
    (the content expression is computed once and reused)."""
    h = F.col(html)
    with_content = pages.withColumn("content", tx.content_of(h))
    site = tx.meta_of(h, tx.META_SITE_RE)
    return with_content.select(
        "*",
        tx.title_of(h).alias("x_title"),
        tx.html_to_text(F.col("content")).alias("x_text"),
        tx.excerpt_of(h, F.col("content")).alias("x_excerpt"),
        tx.meta_of(h, tx.META_AUTHOR_RE).alias("x_author"),
        F.when(site != "", site).otherwise(F.coalesce(tx.host_of(F.col(url)), F.lit(""))).alias("x_site"))


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, host, blocks) of every page: code and comments removed, the
    body split on block tags, one array entry (pos, btext, h, words, share) for
    each block with text.  ``words`` counts its words and ``share`` is the part
    of its characters that lies inside anchors.  No shuffle; the regexes run
    once, in projections before the array is read again."""
    cleaned = pages.select(F.col(key).alias("page_id"), F.coalesce(tx.host_of(F.col(url)), F.lit("")).alias("host"),
                           tx.strip_code(F.coalesce(F.col(html), F.lit(""))).alias("clean"))
    body = F.regexp_extract("clean", tx.BODY_RE, 1)
    parts = cleaned.select("page_id", "host", F.split(F.when(body != "", body).otherwise(F.col("clean")), tx.BLOCK_SPLIT_RE).alias("parts"))
    linked = lambda x: tx.html_to_text(F.array_join(F.regexp_extract_all(x, F.lit(tx.LINK_RE), F.lit(1)), " "))
    texts = parts.select("page_id", "host", F.filter(
        F.transform("parts", lambda x, i: F.struct(i.alias("pos"), tx.html_to_text(x).alias("btext"), linked(x).alias("link"))),
        lambda b: b["btext"] != "").alias("texts"))
    return texts.select("page_id", "host", F.transform("texts", lambda b: F.struct(
        b["pos"].alias("pos"), b["btext"].alias("btext"), F.md5(b["btext"]).alias("h"), F.size(F.split(b["btext"], " ")).alias("words"),
        (F.length(b["link"]) / F.length(b["btext"])).alias("share"))).alias("blocks"))


def link_dense(blocks: Column) -> Column:
    """For each block of a page whether it belongs to a list of links: more
    than a third of its text lies inside anchors, or it is a short block between
    a block made of links and another short one (thresholds in functions.text)."""
    def judge(b, i):
        before, after = F.get(blocks, i - 1), F.get(blocks, i + 1)
        among = ((F.coalesce(before["share"], F.lit(0.0)) > tx.BEFORE_LINK_SHARE) & (b["words"] <= tx.SHORT_WORDS)
                 & (F.coalesce(after["words"], F.lit(0)) <= tx.NEXT_WORDS))
        return (b["share"] > tx.LINK_SHARE) | among
    return F.transform(blocks, judge)


def repeated_blocks(blocks: DataFrame, min_pages: int) -> DataFrame:
    """(host, h) of blocks on at least ``min_pages`` pages of a host.  A page
    counts once (its hashes are made distinct in the row), with map-side partial
    counts, so a footer on every page of a huge host is one row a map task."""
    return (blocks.select("host", F.explode(F.array_distinct("blocks.h")).alias("h"))
            .groupBy("host", "h").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages).select("host", "h"))


def strip_boilerplate(pages: DataFrame, min_pages: int = 2, key: str = "page_id", max_broadcast: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Drop blocks whose text repeats on at least ``min_pages`` pages of
    the same host (navigation, footers, ads) and link-dense blocks; keep the
    rest in page order.  Every page is in the result; one without text (null or
    empty html) has no blocks and an empty text.  ``key`` is unique.

    Blocks are made once and written; html is never shuffled.  The repeated
    set is counted from (host, hash) alone.  Checked small, it is broadcast by
    host and blocks are marked inside the row; else the pairs are joined
    without texts and each page gets the hashes that are repeated in it."""
    blocks = materialize(page_blocks(pages, key), "blocks")
    repeated = materialize(repeated_blocks(blocks, min_pages), "repeated-blocks")
    if fits(repeated, max_broadcast):
        marks = F.broadcast(repeated.groupBy("host").agg(F.collect_list("h").alias("gone")))
        marked = blocks.join(marks, "host", "left")
    else:
        marks = (blocks.select("page_id", "host", F.explode(F.array_distinct("blocks.h")).alias("h"))
                 .join(repeated, ["host", "h"]).groupBy("page_id").agg(F.collect_list("h").alias("gone")))
        marked = blocks.join(marks, "page_id", "left")
    # hashes of this page that are gone: one hashed set operation a page, not a search of the list for each block
    own = marked.withColumn("gone", F.array_intersect("blocks.h", F.coalesce("gone", F.array().cast("array<string>"))))
    kept = F.filter(F.arrays_zip("blocks", link_dense(F.col("blocks")).alias("dense")),
                    lambda z: ~z["dense"] & ~F.array_contains(F.col("gone"), z["blocks"]["h"]))
    return (own.select("page_id", F.size("blocks").cast("bigint").alias("n_blocks"), kept.alias("kept"))
            .select("page_id", "n_blocks", F.size("kept").cast("bigint").alias("n_kept"),
                    F.array_join(F.transform("kept", lambda z: z["blocks"]["btext"]), " ").alias("text")))


# ------------------------------------------------------------------ B rows

def drop_html(store: DataFrame) -> DataFrame:
    """B01 (tall form): the html column is never indexed."""
    return store.drop("html")


def drop_html_keys(raw: DataFrame, col: str = "doc") -> DataFrame:
    """B01 (map form): remove every ``{lang}_html`` key of a decoded document."""
    return raw.withColumn(col, F.map_filter(col, lambda k, v: ~k.endswith("_html")))


def with_host(links: DataFrame) -> DataFrame:
    """Host of each link; an invalid URL gets a null host and
    ``valid = false`` instead of failing the run."""
    h = tx.host_of(F.col("url"))
    return links.withColumn("host", h).withColumn("valid", h.isNotNull())


def coalesce_title(df: DataFrame, extracted: str = "x_title", saved: str = "title") -> DataFrame:
    """Extracted title, else the saved title (for null and empty)."""
    return df.withColumn("title", F.coalesce(F.nullif(F.col(extracted), F.lit("")), F.col(saved)))


def fill_empty(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing extraction results become ''."""
    return df.na.fill("", subset=cols)


def capture_class(captures: DataFrame) -> DataFrame:
    """200 is ok; 403/503 retry while attempt < 3; anything else goes to
    the browser renderer."""
    return captures.withColumn(
        "class",
        F.when(F.col("status") == 200, F.lit("ok"))
        .when(F.col("status").isin(RETRY_STATUSES) & (F.col("attempt") < MAX_ATTEMPTS), F.lit("retry"))
        .otherwise(F.lit("browser")))


def display_title(hits: DataFrame) -> DataFrame:
    """A hit's title, else its URL."""
    return hits.withColumn("display_title", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url")))


def round_score(hits: DataFrame, decimals: int = 3) -> DataFrame:
    """Score rounded for display."""
    return hits.withColumn("score", F.round("score", decimals))


