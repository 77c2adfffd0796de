"""Language profiles, detection and routing.

Detection is a corpus job, not a per-row library call: profiles are learned
from labelled text with one aggregation, and every text is scored against all
profiles with one broadcast join on term (the profile table is bounded by
``k`` terms per language).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesearch.session import materialize
from pagesearch.schemas import DEFAULT_LANG, LANG_MIN_CONFIDENCE, SUPPORTED_LANGS, TEXT_FIELDS

# FIXED VALUES: detection tokens are runs of letters; a term missing from a
# profile gets this probability floor; profiles keep this many terms.
LANG_TOKEN_PATTERN = r"\p{L}+"
PROB_FLOOR = 1e-6
PROFILE_SIZE = 300


def lang_tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(LANG_TOKEN_PATTERN), 0)


def languages(spark: SparkSession) -> DataFrame:
    """The 16-row supported-language dimension (fixed size, safe to broadcast)."""
    return spark.createDataFrame([(code,) for code in SUPPORTED_LANGS], "lang string")


def train_profiles(docs: DataFrame, k: int = PROFILE_SIZE, text: str = "text",
                   lang: str = "lang") -> DataFrame:
    """Per language the ``k`` most frequent terms (ties by term) and
    their share ``p`` of all the language's tokens.

    ``rank <= k`` is a literal bound, so Spark keeps only ``k`` rows per
    language in each map task (WindowGroupLimit) and a big language never
    lands whole in one task."""
    toks = (docs.where(F.col(lang).isNotNull())
            .select(F.col(lang).alias("lang"), F.explode(lang_tokens(F.col(text))).alias("term")))
    counts = toks.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("cnt"))
    totals = counts.groupBy("lang").agg(F.sum("cnt").alias("total"))
    w = Window.partitionBy("lang").orderBy(F.col("cnt").desc(), F.col("term").asc())
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.lit(k))
    return (top.join(F.broadcast(totals), "lang")
            .select("lang", "term", "cnt", F.col("rank").cast("bigint").alias("rank"),
                    (F.col("cnt") / F.col("total")).alias("p")))


def detect_lang(texts: DataFrame, profiles: DataFrame, keys: list[str], text: str = "text",
                min_conf: float = LANG_MIN_CONFIDENCE, floor: float = PROB_FLOOR) -> DataFrame:
    """Language and confidence of every text, one row per key: keys,
    ``best``, ``confidence``, ``lang``.

    Score of language l: sum over the text's tokens of ``ln p_l(t)``, ``p``
    floored at ``floor``.  Tokens in no profile add the same amount to every
    language and the confidence ``1 / sum_l exp(s_l - s_max)`` does not change
    under a common shift, so only profile terms count:
    ``s_l = sum (ln p_l(t) - ln floor)``, 0 for a language with no hit.
    The best language (ties: smallest code) is accepted above ``min_conf``,
    else ``en``.  A text without any profile term gets ``en``, confidence 0
    and no best.

    Tokens meet the profiles where they are read and are summed there to one
    row per text and language, which is all that is shuffled."""
    # profiles hold at most k terms per language: written once, then read
    profiles = materialize(profiles.select("lang", "term", "p"), "profiles")
    n_langs = profiles.select("lang").distinct().count()
    prof = profiles.select("lang", "term", (F.log("p") - F.lit(math.log(floor))).alias("lp"))
    per_lang = (texts.select(*keys, F.explode_outer(lang_tokens(F.col(text))).alias("term"))
                .join(F.broadcast(prof), "term", "left")
                .groupBy(*keys, "lang").agg(F.sum("lp").alias("s")))
    per_text = per_lang.groupBy(*keys).agg(
        F.max("s").alias("s_hit"),
        F.min(F.when(F.col("lang").isNotNull(), F.struct((-F.col("s")).alias("ns"), F.col("lang").alias("l"))))["l"].alias("best"),
        F.collect_list("s").alias("ss"),
        F.count("lang").alias("n_hit"))
    missing = F.lit(n_langs) - F.col("n_hit")
    s_max = F.greatest(F.col("s_hit"), F.when(missing > 0, F.lit(0.0)))
    denom = (F.aggregate("ss", F.lit(0.0), lambda acc, x: acc + F.exp(x - s_max))
             + missing * F.exp(-s_max))
    conf = F.when(F.col("n_hit") > 0, F.lit(1.0) / denom).otherwise(F.lit(0.0))
    return per_text.select(*keys, "best", conf.alias("confidence"),
                           F.when(conf > F.lit(min_conf), F.col("best"))
                           .otherwise(F.lit(DEFAULT_LANG)).alias("lang"))


def detect_hits(texts: DataFrame, profiles: DataFrame, keys: list[str], text: str = "text",
                min_conf: float = LANG_MIN_CONFIDENCE, floor: float = PROB_FLOOR) -> DataFrame:
    """``detect_lang`` of the texts that have a profile term."""
    return detect_lang(texts, profiles, keys, text, min_conf, floor).where(F.col("best").isNotNull())


def pick_lang(df: DataFrame, title_l: str = "lang_title", excerpt_l: str = "lang_excerpt",
              text_l: str = "lang_text") -> DataFrame:
    """Every non-empty field's detection overwrites the previous one in
    the order text, excerpt, title, so the title wins, then the excerpt."""
    return df.withColumn("lang", F.coalesce(F.col(title_l), F.col(excerpt_l), F.col(text_l),
                                            F.lit(DEFAULT_LANG)))


def detect_fields(df: DataFrame, profiles: DataFrame, key: str,
                  fields: tuple[str, ...] = ("title", "excerpt", "text")) -> DataFrame:
    """Detect each non-empty field of each row in one job (fields unpivoted,
    one detection, pivoted back with conditional max).  Output: key plus
    ``lang_<field>`` (null when the field is empty or has no profile term)."""
    long = (df.select(F.col(key).alias("_k"),
                      F.inline(F.array(*[F.struct(F.lit(f).alias("fname"), F.col(f).alias("ftext"))
                                         for f in fields])))
            .where(F.col("ftext").isNotNull() & (F.col("ftext") != "")))
    det = detect_hits(long, profiles, ["_k", "fname"], text="ftext")
    wide = det.groupBy("_k").agg(*[F.max(F.when(F.col("fname") == f, F.col("lang"))).alias(f"lang_{f}")
                                   for f in fields])
    return wide.withColumnRenamed("_k", key)


def route_lang(df: DataFrame, spark: SparkSession, col: str = "lang") -> DataFrame:
    """Unsupported or empty language becomes ``en`` (left join to the
    16-row language table)."""
    langs = languages(spark).select(F.col("lang").alias("_supported"))
    return (df.join(F.broadcast(langs), F.col(col) == F.col("_supported"), "left")
            .withColumn(col, F.coalesce(F.col("_supported"), F.lit(DEFAULT_LANG)))
            .drop("_supported"))


def lang_columns(store: DataFrame, langs: list[str] | None = None,
                 fields: list[str] | None = None) -> DataFrame:
    """Wide projection, one ``{lang}_{field}`` column per language and
    text field, null where the row has another language."""
    langs = langs or SUPPORTED_LANGS
    fields = fields or TEXT_FIELDS
    cols = [F.when(F.col("lang") == F.lit(code), F.col(f)).alias(f"{code}_{f}")
            for code in langs for f in fields]
    return store.select("url", "lang", *cols)
