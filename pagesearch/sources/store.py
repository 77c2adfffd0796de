"""Links, captures and the document store on Parquet/JSON.

The store is a Parquet dataset keyed by ``url``, one row per key.  A write
never overwrites the version being read: each upsert writes a new version
folder; readers take the latest complete version.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesearch.schemas import CAPTURES, LINKS, STORE, STORE_COLUMNS
from pagesearch.session import broadcast_if_small, materialize


def read_links(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Saved links with an explicit schema, in list order (``seq``)."""
    return spark.read.schema(LINKS).format(fmt).load(path).select(*LINKS.fieldNames())


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Page captures by URL (replaces fetching)."""
    return spark.read.schema(CAPTURES).format(fmt).load(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Full scan of the latest store version."""
    return spark.read.schema(STORE).parquet(latest_version(spark, path))


def store_lookup(store: DataFrame, urls: DataFrame) -> DataFrame:
    """Stored documents for the given keys (semi join; a small key list
    is broadcast after a size check)."""
    return store.join(broadcast_if_small(urls.select("url").distinct()), "url", "left_semi")


def upsert(store: DataFrame, new: DataFrame, key: str = "url", order: str = "seq") -> DataFrame:
    """Replace on same key, never delete; among new rows the highest
    ``order`` wins and any new row beats the stored one.  Only the new rows
    are aggregated (and written once); stored rows, one per key, go through
    an anti join on the new keys."""
    cols = [c for c in STORE_COLUMNS if c != key]
    fresh = materialize(new.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(order).cast("bigint"))).alias("r"))
                        .select(key, *[F.col(f"r.{c}").alias(c) for c in cols]), "new-rows")
    keep = store.select(key, *cols).join(fresh.select(key), key, "left_anti")
    return keep.unionByName(fresh)


def latest_version(spark: SparkSession, path: str) -> str:
    """Newest complete version folder (``v000001`` ...) of a dataset root."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return path
    done = sorted(st.getPath().getName() for st in fs.listStatus(jvm_path)
                  if st.getPath().getName().startswith("v")
                  and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")))
    return os.path.join(path, done[-1]) if done else path


def write_version(df: DataFrame, path: str) -> str:
    """Write ``df`` as the next version of ``path`` (never in place)."""
    spark = df.sparkSession
    cur = latest_version(spark, path)
    name = os.path.basename(cur)
    nxt = int(name[1:]) + 1 if name.startswith("v") and name[1:].isdigit() else 1
    out = os.path.join(path, f"v{nxt:06d}")
    df.write.mode("errorifexists").parquet(out)
    return out


def to_lang_json(store: DataFrame) -> DataFrame:
    """One JSON object per document with language-prefixed text keys
    (``{lang}_title``, ``{lang}_html``, ``{lang}_text``, ``{lang}_excerpt``)
    plus ``lang``, ``author``, ``siteName``, ``url``, ``folder``."""
    lang = F.coalesce(F.col("lang"), F.lit(""))
    keys = [F.concat(lang, F.lit(f"_{f}")) for f in ["title", "html", "text", "excerpt"]]
    keys += [F.lit("lang"), F.lit("author"), F.lit("siteName"), F.lit("url"), F.lit("folder")]
    vals = [F.col(c) for c in ["title", "html", "text", "excerpt", "lang", "author", "site_name",
                               "url", "folder"]]
    m = F.map_from_arrays(F.array(*keys), F.array(*[F.coalesce(v, F.lit("")) for v in vals]))
    return store.select("url", F.to_json(m).alias("doc"))


def from_lang_json(raw: DataFrame, col: str = "doc") -> DataFrame:
    """Decode stored JSON into the canonical tall columns."""
    m = F.from_json(F.col(col), "map<string,string>")
    d = raw.select(m.alias("m"))
    lang = F.col("m")["lang"]
    out = {"url": F.col("m")["url"], "lang": lang}
    for f in ["title", "html", "text", "excerpt"]:
        out[f] = F.try_element_at("m", F.concat(lang, F.lit(f"_{f}")))
    out["author"] = F.col("m")["author"]
    out["site_name"] = F.col("m")["siteName"]
    out["folder"] = F.col("m")["folder"]
    return d.select(*[out[c].alias(c) for c in STORE_COLUMNS])


