"""Line dedup by distinct-site spread.

HyperLogLog sketches of the sites of each line hash merge by aggregation.
Lines whose estimate lies near the threshold get an exact distinct count; the
lines spread over at least ``min_sites`` sites are boilerplate, of which only
the first occurrence in the corpus stays.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesearch.llm.frames import quoted
from pagesearch.session import materialize

MIN_SITES = 5
LG_K = 12            # 2**12 registers: relative error 1.04 / 2**6
_ERRORS = 5          # standard errors on each side that count as near


def _lines(text: str):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_table(docs: DataFrame, key: str, site: str, text: str) -> DataFrame:
    """One row per line that isn't blank: key, version (hash of the whole text,
    which tells rows with one key apart), site, pos and 96 bits of line hash."""
    d = docs.select(F.col(key).alias("key"), F.col(site).cast("string").alias("site"),
                    F.xxhash64(text).alias("version"), _lines(text).alias("lines"))
    return (d.select("key", "site", "version", F.posexplode("lines").alias("pos", "line"))
            .where(F.length(F.trim(F.translate("line", "\t\r\f\x0b", "    "))) > 0)
            .select("key", "site", "version", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first) of the lines found on at least ``min_sites`` distinct
    sites; ``first`` is the smallest (key, pos, version) that has the line."""
    margin = max(1, math.ceil(_ERRORS * 1.04 / math.sqrt(1 << LG_K) * min_sites))
    sketched = materialize(
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"),
             F.min(F.struct("key", "pos", "version")).alias("first"))
        .where(F.col("sites") >= min_sites - margin), "line-sketches")
    near = sketched.where(F.col("sites") <= min_sites + margin)
    exact = (lines.where(F.col("site").isNotNull()).join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
             .groupBy("h1", "h2").agg(F.count_distinct("site").alias("exact")).where(F.col("exact") >= min_sites))
    return (sketched.where(F.col("sites") > min_sites + margin).select("h1", "h2", "first")
            .unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first")))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, key: str = "doc_id",
                        site: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and two columns more:
    ``n_lines`` and ``n_removed``.

    A line is what lies between line feeds; blank lines always stay.  A line on
    ``min_sites`` distinct sites or more is boilerplate: its first occurrence
    (smallest key, then position) stays and all others go.  No row is dropped:
    a text of boilerplate alone becomes empty.  A null text stays null (one
    line, none removed); a null site counts as no site; a null key sorts first.
    Repeated rows (same key and text) are treated alike.  Texts of any length are
    split whole; an empty table gives an empty one.  Columns of ``docs`` named
    n_lines or n_removed are replaced; other columns are kept as they are,
    whatever their names.
    """
    lines = materialize(line_table(docs, key, site, text), "lines")
    boiler = materialize(spread_lines(lines, min_sites), "boilerplate")
    cuts = (lines.join(boiler, ["h1", "h2"])
            .where(~F.struct("key", "pos", "version").eqNullSafe(F.col("first")))
            .groupBy("key", "version").agg(F.collect_set("pos").alias("cut"))
            .withColumnsRenamed({"key": "of_key", "version": "of_version"}))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # the user's columns travel in one struct, so no name of theirs meets one of
    # these; the array is a column below the join, so the text is split once a row
    own = F.struct(F.lit(0), *[quoted(c).alias(c) for c in names if c != text])
    d = docs.select(own.alias("own"), quoted(key).alias("key"), F.xxhash64(text).alias("version"), _lines(text).alias("lines"), quoted(text).isNull().alias("none"))
    j = d.join(cuts, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("version") == F.col("of_version")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("cut"))
    body = F.when(F.col("cut").isNull(), F.col("lines")).otherwise(F.transform(kept, lambda i: F.get("lines", i)))
    clean = F.when(~F.col("none"), F.array_join(body, "\n")).alias(text)
    return j.select(*[clean if c == text else F.col("own").getField(c).alias(c) for c in names],
                    F.size("lines").cast("long").alias("n_lines"),
                    F.when(F.col("cut").isNull(), F.lit(0)).otherwise(F.size("cut")).cast("long").alias("n_removed"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM d),
lines AS (SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
boiler AS (
  SELECT line, min((doc_id, pos)) AS first FROM lines
  WHERE length(trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    '))) > 0
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT l.doc_id, l.line, l.pos, b.line IS NOT NULL AND (l.doc_id, l.pos) <> b.first AS cut
  FROM lines l LEFT JOIN boiler b ON l.line = b.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '')) AS clean_sha256
FROM marked GROUP BY doc_id
"""
