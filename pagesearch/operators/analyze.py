"""Text analysis chains.

Inside a row (``analysed``): stop words and suffix rules are literals, tokens
are filtered and stemmed in the array, and nothing is shuffled.  A registry
with vocabulary functions (pandas UDFs) is applied to the distinct vocabulary
instead, which is joined back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesearch.functions import analysis as an
from pagesearch.functions.text import tokens as token_array
from pagesearch.schemas import DEFAULT_LANG


@dataclass
class AnalyzerRegistry:
    """Languages as data: stop words, suffix rules and an optional
    vocabulary function (``pandas_udf`` over distinct terms only)."""
    stops: dict[str, str] = field(default_factory=lambda: dict(an.STOP_WORDS))
    rules: dict[str, list] = field(default_factory=lambda: {k: list(v) for k, v in an.SUFFIX_RULES.items()})
    vocab_fns: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    min_stem: int = an.MIN_STEM

    def register_analyzer(self, lang: str, stops: list[str] | str, suffixes: list,
                          vocab_fn: Callable[[Column], Column] | None = None) -> "AnalyzerRegistry":
        self.stops[lang] = stops if isinstance(stops, str) else " ".join(stops)
        self.rules[lang] = list(suffixes)
        if vocab_fn is not None:
            self.vocab_fns[lang] = vocab_fn
        return self

    def stop_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(an.stop_rows(self.stops), "lang string, term string")

    def rule_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(an.rule_rows(self.rules),
                                     "lang string, suffix string, repl string, excl array<string>")


DEFAULT_REGISTRY = AnalyzerRegistry()


def placed(toks: Column) -> Column:
    """array<struct<term, pos>> of an array of tokens."""
    return F.transform(toks, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))


def keyword_array(col: Column) -> Column:
    """The value as one token, none if it is null or empty."""
    return F.when(col != "", F.array(col)).otherwise(F.array().cast("array<string>"))


def stem(term: Column, lang: Column, registry: AnalyzerRegistry) -> Column:
    """D03 for one term: the longest applicable suffix rule of the language,
    else the term itself."""
    out = None
    for code, rules in registry.rules.items():
        best = None
        for suffix, repl, excluded in sorted(rules, key=lambda r: -len(r[0])):
            ok = F.endswith(term, F.lit(suffix)) & (F.length(term) >= F.lit(registry.min_stem + len(suffix) - len(repl)))
            for e in excluded:
                ok = ok & ~F.endswith(term, F.lit(e))
            new = F.concat(F.substring(term, F.lit(1), F.length(term) - F.lit(len(suffix))), F.lit(repl))
            best = F.when(ok, new) if best is None else best.when(ok, new)
        if best is not None:
            here, best = lang == code, best.otherwise(term)
            out = F.when(here, best) if out is None else out.when(here, best)
    return term if out is None else out.otherwise(term)


def _without(pairs: Column, words: list[str]) -> Column:
    return F.filter(pairs, lambda x: ~x["term"].isin(words))


def analysed(toks: Column, lang: Column, registry: AnalyzerRegistry = DEFAULT_REGISTRY) -> Column:
    """D02 and D03 inside the row: array<struct<term, pos>> without the stop
    words of ``lang``, the rest stemmed; positions are those of ``toks``."""
    if registry.vocab_fns:
        raise ValueError("vocabulary functions run over a distinct vocabulary: use analyze()")
    out = placed(toks)
    for code, words in registry.stops.items():
        if words.split():
            out = F.when(lang == code, _without(placed(toks), words.split())).otherwise(out)
    return F.transform(out, lambda x: F.struct(stem(x["term"], lang, registry).alias("term"), x["pos"].alias("pos")))


def drop_stopwords(tokens: DataFrame, stops: DataFrame) -> DataFrame:
    """Remove the stop words of each row's language; positions kept."""
    return tokens.join(F.broadcast(stops), ["lang", "term"], "left_anti")


def stem_vocab(vocab: DataFrame, rules: DataFrame, min_stem: int = an.MIN_STEM) -> DataFrame:
    """(lang, term) -> (lang, term, stem) for a distinct vocabulary: the
    longest applicable suffix rule, else the term itself."""
    cand = (vocab.join(F.broadcast(rules), "lang")
            .where(F.endswith("term", "suffix")
                   & ~F.exists("excl", lambda e: F.endswith(F.col("term"), e))
                   & (F.length("term") - F.length("suffix") + F.length("repl") >= F.lit(min_stem)))
            .groupBy("lang", "term")
            .agg(F.max_by(F.struct("suffix", "repl"), F.length("suffix")).alias("r"))
            .select("lang", "term",
                    F.concat(F.expr("substring(term, 1, length(term) - length(r.suffix))"),
                             F.col("r.repl")).alias("stem")))
    return (vocab.join(cand, ["lang", "term"], "left")
            .withColumn("stem", F.coalesce("stem", "term")))


def stem_terms(tokens: DataFrame, rules: DataFrame, min_stem: int = an.MIN_STEM,
               vocab_fns: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Stems computed once per distinct (lang, term), joined back."""
    vocab = tokens.select("lang", "term").distinct()
    stems = stem_vocab(vocab, rules, min_stem)
    for lang, fn in (vocab_fns or {}).items():
        stems = stems.withColumn("stem", F.when(F.col("lang") == lang, fn(F.col("stem"))).otherwise(F.col("stem")))
    return (tokens.join(stems, ["lang", "term"])
            .withColumn("term", F.col("stem")).drop("stem"))


def keyword_terms(store: DataFrame, key: str = "url",
                  fields: tuple[str, ...] = ("author", "lang", "site_name")) -> DataFrame:
    """Keyword fields indexed as one unsplit term, position 0, case kept."""
    long = store.select(F.col(key).alias("doc_id"),
                        F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("term"))
                                           for f in fields])))
    return (long.where(F.col("term").isNotNull() & (F.col("term") != ""))
            .select("doc_id", "field", F.lit(0).cast("bigint").alias("pos"), "term"))


def analyze(df: DataFrame, lang_fields: dict[str, str], default_fields: dict[str, str],
            key: str = "doc_id", lang_col: str = "lang",
            registry: AnalyzerRegistry = DEFAULT_REGISTRY,
            force_analyzer: str | None = None) -> DataFrame:
    """Text fields analysed in the row's language, ``default_fields``
    in ``en``; tokens, stop words, stems.  ``force_analyzer`` analyses every
    field with one language.  Output (doc_id, field, lang, pos, term)."""
    spark = df.sparkSession
    row_lang = F.lit(force_analyzer) if force_analyzer else F.coalesce(F.col(lang_col), F.lit(DEFAULT_LANG))
    dflt = F.lit(force_analyzer or DEFAULT_LANG)
    parts = ([F.struct(F.lit(n).alias("field"), row_lang.alias("lang"), token_array(F.col(c)).alias("toks"))
              for n, c in lang_fields.items()]
             + [F.struct(F.lit(n).alias("field"), dflt.alias("lang"), token_array(F.col(c)).alias("toks"))
                for n, c in default_fields.items()])
    arrays = df.select(F.col(key).alias("doc_id"), F.inline(F.array(*parts)))
    if not registry.vocab_fns:
        return (arrays.select("doc_id", "field", "lang", F.explode(analysed(F.col("toks"), F.col("lang"), registry)).alias("t"))
                .select("doc_id", "field", "lang", F.col("t.pos").cast("bigint").alias("pos"), "t.term"))
    toks = arrays.select("doc_id", "field", "lang", F.posexplode("toks").alias("pos", "term"))
    kept = drop_stopwords(toks, registry.stop_table(spark))
    return (stem_terms(kept, registry.rule_table(spark), registry.min_stem, registry.vocab_fns)
            .select("doc_id", "field", "lang", F.col("pos").cast("bigint").alias("pos"), "term"))
