"""Link ingest: capture choice, de-duplication, skip of stored links, crawl
plan, and the whole ingest row (E01-E05, H01-H04, H06, C10).

Per-key choices use ``min_by``/``max_by`` aggregations (partial aggregation
map-side), never a window over the key, so a URL or host holding a large
share of the rows is reduced before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesearch.operators import extract as ex
from pagesearch.operators import language as lg
from pagesearch.schemas import FETCH_PER_HOST_PER_SEC, STORE_COLUMNS
from pagesearch.session import broadcast_if_small, materialize

# Rows of URLs alone (or with language codes) that are broadcast, about 50 MB:
# beyond it the html on the other side of the join is shuffled.
BROADCAST_MAX_URLS = 500_000


def best_capture(captures: DataFrame) -> DataFrame:
    """One body per URL: a plain-HTTP 200; else the browser body when it
    came; else the last plain attempt, even an error page (status kept)."""
    pref = (F.when((F.col("renderer") == "http") & (F.col("status") == 200), 0)
            .when(F.col("renderer") == "browser", 1).otherwise(2))
    order = F.struct(pref.alias("pref"), (-F.col("attempt")).alias("na"))
    best = F.min_by(F.struct("attempt", "renderer", "status", "html"), order)
    return (captures.groupBy("url").agg(best.alias("b"))
            .select("url", "b.attempt", "b.renderer", "b.status", "b.html"))


def dedupe(links: DataFrame, keep: str = "first") -> DataFrame:
    """H02 (keep first by seq, the default run) / H03 (keep last, a forced run)."""
    pick = F.min_by if keep == "first" else F.max_by
    cols = [c for c in links.columns if c != "url"]
    return (links.groupBy("url").agg(pick(F.struct(*cols), F.col("seq")).alias("r"))
            .select("url", *[F.col(f"r.{c}").alias(c) for c in cols]))


def unseen(links: DataFrame, store: DataFrame, force: bool = False) -> DataFrame:
    """Links whose URL is not stored yet; E02: with ``force`` all links.

    The store is first cut down to the URLs of this run (semi join with the
    run's keys, broadcast when checked small), so a small run against a huge
    store scans the store once instead of shuffling it."""
    if force:
        return links
    keys = links.select("url").distinct()
    stored = store.select("url").join(broadcast_if_small(keys), "url", "left_semi")
    return links.join(stored, "url", "left_anti")


def attach_capture(links: DataFrame, best: DataFrame) -> DataFrame:
    """Links with their chosen capture (inner: no capture, no document)."""
    return links.join(best.select("url", "status", "html"), "url", "inner")


def pending(links: DataFrame, captures: DataFrame) -> DataFrame:
    """Links with no capture at all (reported, not stored)."""
    return links.join(captures.select("url"), "url", "left_anti")


def rank_within(df: DataFrame, group: str, order: str, n_parts: int | None = None) -> DataFrame:
    """Dense 1-based ``rn`` of each row inside ``group`` by ``order`` (unique
    within the group) without putting a whole group into one task.

    Rows are range-partitioned on (group, order), so a huge group spans
    several partitions; each partition numbers its own rows, and the
    per-(partition, group) counts (one row each) give the offsets.  The
    partitioned rows are written once with their partition's number: range
    bounds are sampled, so a plan that partitions twice could disagree."""
    n = n_parts or df.sparkSession.sparkContext.defaultParallelism
    parted = materialize(df.repartitionByRange(n, group, order).withColumn("_pid", F.spark_partition_id()), "ranges")
    local = parted.withColumn(
        "_lrn", F.row_number().over(Window.partitionBy("_pid", group).orderBy(order)))
    counts = parted.groupBy("_pid", group).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(
            Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(broadcast_if_small(offsets.select("_pid", group, "_off")), ["_pid", group])
            .withColumn("rn", (F.col("_off") + F.col("_lrn")).cast("bigint"))
            .drop("_pid", "_lrn", "_off"))


def fetch_slots(links: DataFrame, per_sec: int = FETCH_PER_HOST_PER_SEC) -> DataFrame:
    """Crawl plan: at most ``per_sec`` fetches per host per second; the
    start second of each link is ``floor((rank in host by seq - 1) / per_sec)``."""
    hosted = ex.with_host(links).where(F.col("valid"))
    ranked = rank_within(hosted, "host", "seq")
    return ranked.select("url", "host", "seq", "rn",
                         F.floor((F.col("rn") - 1) / F.lit(per_sec)).cast("bigint").alias("slot"))


def pick_one(df: DataFrame, by: list[str], seed: str, key: str) -> DataFrame:
    """One uniformly chosen row per group, deterministic for a seed: the
    row with the smallest ``md5(seed || key)`` (stable under retries and any
    partitioning, unlike ``rand()``)."""
    cols = [c for c in df.columns if c not in by]
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    return (df.groupBy(*by).agg(F.min_by(F.struct(*cols), h).alias("r"))
            .select(*by, *[F.col(f"r.{c}").alias(c) for c in cols]))


def build_store(spark: SparkSession, links: DataFrame, captures: DataFrame, profiles: DataFrame,
                store: DataFrame | None = None, force: bool = False) -> DataFrame:
    """The whole ingest row as one job: valid links, de-duplicated
    (first, or last when forced), not yet stored (unless forced), with their
    best capture, extracted, titled, language-detected and routed.  Returns
    new store rows (``STORE_COLUMNS``) carrying ``seq`` for the upsert.
    ``store`` only needs a ``url`` column (the stored keys).

    Pages are extracted once and written: detection and the rows it is joined
    to both read them, and neither runs the patterns over the html again."""
    valid = ex.with_host(links).where(F.col("valid")).drop("host", "valid")
    todo = dedupe(valid, keep="last" if force else "first")
    if store is not None:
        todo = unseen(todo, store, force)
    # captures cut to this run's URLs first: a small run scans captures once
    # with a broadcast semi join; a full run joins on url, and the capture
    # choice and the attach then reuse that partitioning
    todo = materialize(todo, "todo")
    caps = captures.join(broadcast_if_small(todo.select("url"), BROADCAST_MAX_URLS), "url", "left_semi")
    rows = attach_capture(todo, best_capture(caps))
    x = ex.extract_all(rows).drop("html")
    x = ex.coalesce_title(x, extracted="x_title", saved="title")
    x = x.select("url", "folder", "seq", F.col("title"), F.col("content").alias("html"),
                 F.col("x_text").alias("text"), F.col("x_excerpt").alias("excerpt"),
                 F.col("x_author").alias("author"), F.col("x_site").alias("site_name"))
    x = ex.fill_empty(x, ["title", "html", "text", "excerpt", "author", "site_name", "folder"])
    x = materialize(x, "extracted")
    langs = materialize(lg.detect_fields(x, profiles, "url"), "languages")
    out = lg.pick_lang(x.join(broadcast_if_small(langs, BROADCAST_MAX_URLS), "url", "left"))
    out = lg.route_lang(out, spark)
    return out.select(*STORE_COLUMNS, "seq")
