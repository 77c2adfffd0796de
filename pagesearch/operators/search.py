"""Search clauses over the index tables.

A batch of queries is a ``clauses`` DataFrame (schema ``CLAUSES``) plus an
optional ``query_opts(query_id, min_should, size, from)``; every step works on
all queries of the batch at once.

Leaf clauses give ``(query_id, clause_id, occur, doc_id, score)``, one row per
(query, clause, document).  Term-like clauses first expand against the
vocabulary (``term_df``), never against postings, and then look the expanded
terms up with a broadcast join, so a hot term is never a shuffle key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesearch.functions import scoring
from pagesearch.functions.text import tokens as token_array
from pagesearch.operators.analyze import analysed, keyword_array, placed
from pagesearch.operators import vocabulary
from pagesearch.operators.index import Index, build_postings, corpus_stats, doc_freq, of_terms
from pagesearch.schemas import CLAUSE_KINDS, DEFAULT_FROM, DEFAULT_SIZE
from pagesearch.session import BROADCAST_MAX_ROWS, broadcast_if_small, fits, materialize

CKEYS = ["query_id", "clause_id", "occur"]
TERM_KINDS = ["term", "prefix", "wildcard", "regexp", "match"]
PHRASE_KINDS = ["match_phrase", "phrase"]
RANGE_KINDS = ["numeric_range", "date_range"]

# Up to so many distinct terms are pushed into the scan of a stored index as
# well; the join that gives the result is the same for any number.
PUSHDOWN_MAX_TERMS = 5_000

# A clause batch is the query side of every join here: it and the tables
# derived from it row by row (ranges, ids, per-query counts, paging options)
# are broadcast up to this many bytes of clauses; beyond, the planner chooses.
BROADCAST_CLAUSE_BYTES = 8 << 20
CLAUSE_ROW_BYTES = 100
RANGE_BINS = 256


def _plain(df: DataFrame) -> DataFrame:
    return df


@dataclass
class Batch:
    """Clause kinds present in a batch (``match~`` for fuzzy match, ``prefix-``
    and the like for patterns without three letters in a row) and the join hint
    for its side."""
    kinds: set[str]
    side: Callable[[DataFrame], DataFrame]


def batch_of(clauses: DataFrame) -> Batch:
    """One aggregation over the clauses (a row per kind) for any batch size."""
    size = F.coalesce(F.octet_length(F.array_join("terms", " ")), F.lit(0)) + F.lit(CLAUSE_ROW_BYTES)
    short = F.when(F.col("kind").isin(*PATTERNS), F.coalesce(vocabulary.is_short(_literals()), F.lit(True))).otherwise(F.lit(False))
    rows = (clauses.where(F.col("kind").isin(CLAUSE_KINDS))
            .groupBy("kind", (F.coalesce("fuzziness", F.lit(0)) > 0).alias("fz"), short.alias("short")).agg(F.sum(size).alias("bytes")).collect())
    small = sum(r.bytes for r in rows) <= BROADCAST_CLAUSE_BYTES
    return Batch({r.kind + ("~" if r.kind == "match" and r.fz else "-" if r.short else "") for r in rows}, F.broadcast if small else _plain)


PATTERNS = {"prefix": vocabulary.prefix_literals, "wildcard": vocabulary.wildcard_literals, "regexp": vocabulary.regexp_literals}


def _literals() -> Column:
    """Literal runs of a pattern clause, by its kind."""
    out = F.lit(None).cast("string")
    for kind, of in PATTERNS.items():
        out = F.when(F.col("kind") == kind, of(F.col("terms")[0])).otherwise(out)
    return out


def _kind(clauses: DataFrame, kinds: list[str]) -> DataFrame:
    return clauses.where(F.col("kind").isin(kinds))


def _defaults(clauses: DataFrame) -> DataFrame:
    return (clauses
            .withColumn("boost", F.coalesce("boost", F.lit(1.0)))
            .withColumn("fuzziness", F.coalesce("fuzziness", F.lit(0)))
            .withColumn("prefix_length", F.coalesce("prefix_length", F.lit(0)))
            .withColumn("field", F.coalesce("field", F.lit("_all"))))


def analysed_query(index: Index) -> Column:
    """array<struct<term, pos>> of a match clause's text, by the chain of its field."""
    text = F.array_join("terms", " ")
    out = placed(token_array(text))
    for name, lang in index.query_langs.items():
        out = F.when(F.col("field") == name, analysed(token_array(text), F.lit(lang), index.registry)).otherwise(out)
    return F.when(F.col("field").isin(*index.keywords), placed(keyword_array(text))).otherwise(out) if index.keywords else out


def fuzzy_terms(fz: DataFrame, index: Index, side) -> DataFrame:
    """rows of ``fz`` with each vocabulary term within ``fuzziness`` edits
    that shares the first ``prefix_length`` characters.  Up to
    ``MOST_EDITS`` edits the candidates come from the deletion neighbourhood
    (an equi join on hashes); for more, terms of a like length are compared."""
    names = [c for c in fz.columns if c != "field"]
    keys = (vocabulary.near_keys(fz.where(F.col("fuzziness") <= vocabulary.MOST_EDITS).select("field", "qterm", F.struct(*names).alias("_id")), "qterm")
            .where(F.col("cut") <= F.col("_id.fuzziness")).select("field", "_id", "h").distinct())
    near = vocabulary.near_keys(index.term_df.select("field", "term"))
    close = (near.join(broadcast_if_small(keys), ["field", "h"]).where(F.col("cut") <= F.col("_id.fuzziness"))
             .select("field", "_id.*", "term").distinct())
    wide = (fz.where(F.col("fuzziness") > vocabulary.MOST_EDITS)
            .withColumn("len", F.explode(F.sequence(F.length("qterm") - F.col("fuzziness"), F.length("qterm") + F.col("fuzziness")))))
    far = (index.term_df.select("field", "term", F.length("term").alias("len")).join(side(wide), ["field", "len"])
           .select("field", *names, "term"))
    return close.unionByName(far).where(
        (F.left("term", F.col("prefix_length")) == F.left("qterm", F.col("prefix_length")))
        & (F.levenshtein("term", "qterm") <= F.col("fuzziness")))


def expand_terms(clauses: DataFrame, index: Index, batch: Batch | None = None) -> DataFrame:
    """(query_id, clause_id, occur, field, boost, slot, n_slots, term) for term,
    prefix, wildcard, regexp and match clauses.  ``slot`` numbers the query
    terms of a match clause (for its coord).  Only the expansion joins for the
    kinds in the batch are planned."""
    batch = batch or batch_of(clauses)
    kinds, side = batch.kinds, batch.side
    cl = _defaults(_kind(clauses, TERM_KINDS))
    base = CKEYS + ["field", "boost"]

    exact = (cl.where(F.col("kind") == "term")
             .select(*base, F.lit(0).alias("slot"), F.lit(1).alias("n_slots"),
                     F.col("terms")[0].alias("term")))

    # match: analyse the query text with the index analyser, one slot per token
    analysed = (cl.where(F.col("kind") == "match")
                .select(*base, "fuzziness", "prefix_length",
                        analysed_query(index).alias("qt"))
                .select("*", F.size("qt").alias("n_slots"), F.explode("qt").alias("t"))
                .select(*base, "fuzziness", "prefix_length", "n_slots", F.col("t.pos").alias("slot"), F.col("t.term").alias("qterm")))
    match_exact = (analysed.where(F.col("fuzziness") == 0)
                   .select(*base, "slot", "n_slots", F.col("qterm").alias("term")))

    fuzzy = (fuzzy_terms(analysed.where(F.col("fuzziness") > 0), index, side)
             .select(*base, "slot", "n_slots", "term"))

    def by_grams(kind: str, verify: Column) -> DataFrame | None:
        """Terms that hold all grams of the pattern, then match it.  The lists
        of short grams are only planned for if a pattern needs them."""
        of = PATTERNS[kind](F.col("_p"))
        mine = cl.where(F.col("kind") == kind).withColumn("_p", F.col("terms")[0])
        stored = index.grams if index.grams is not None else vocabulary.gram_keys(index.term_df)
        tables = [(kind, stored, mine.where(~vocabulary.is_short(of))), (kind + "-", vocabulary.gram_keys(index.term_df, short=True), mine.where(vocabulary.is_short(of)))]
        found = [vocabulary.terms_with(t, c, of, [*base, "_p"]) for k, t, c in tables if k in kinds]
        both = found[0] if len(found) == 1 else found[0].unionByName(found[1]) if found else None
        return both.where(verify).select(*base, F.lit(0).alias("slot"), F.lit(1).alias("n_slots"), "term") if found else None

    like = F.col("_p")
    for plain, pattern in [("\\", "\\\\"), ("%", "\\%"), ("_", "\\_"), ("*", "%"), ("?", "_")]:
        like = F.replace(like, F.lit(plain), F.lit(pattern))
    prefix = by_grams("prefix", F.startswith("term", "_p"))
    wild = by_grams("wildcard", F.like(F.col("term"), like))
    regexp = by_grams("regexp", F.regexp_like("term", F.concat(F.lit("^(?:"), F.col("_p"), F.lit(r")\z"))))

    parts = [(exact, "term"), (match_exact, "match"), (fuzzy, "match~")]
    chosen = [df for df, k in parts if k in kinds] + [df for df in (prefix, wild, regexp) if df is not None] or [exact]
    out = chosen[0]
    for df in chosen[1:]:
        out = out.unionByName(df)
    return out


def with_idf(qterms: DataFrame, index: Index) -> DataFrame:
    """Attach df and idf to expanded query terms (terms not in the vocabulary
    drop out here)."""
    n = index.corpus.select("field", "n_docs")
    return (qterms.join(index.term_df, ["field", "term"])
            .join(F.broadcast(n), "field")
            .withColumn("idf", scoring.idf(F.col("df"), F.col("n_docs"))))


def with_norm(qterms: DataFrame, clauses: DataFrame) -> DataFrame:
    """Attach the query norm: 1 / sqrt(sum (boost * idf)^2) over the terms of
    the MUST and SHOULD clauses, a phrase counting once with the sum of its
    idf; null for a query with one such clause, whose score has no norm."""
    scoring_clause = F.col("occur") != "must_not"
    several = (clauses.where(scoring_clause).groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
               .where(F.col("_n") > 1).select("query_id"))
    per_clause = qterms.where(scoring_clause).groupBy("query_id", "clause_id", "_ph").agg(
        F.first("boost").alias("boost"), F.sum("idf").alias("s"), F.sum(F.col("idf") * F.col("idf")).alias("sq"))
    part = F.col("boost") * F.col("boost") * F.when(F.col("_ph"), F.col("s") * F.col("s")).otherwise(F.col("sq"))
    norm = (per_clause.groupBy("query_id").agg(F.sum(part).alias("_sum")).join(several, "query_id")
            .select("query_id", F.when(F.col("_sum") > 0, 1 / F.sqrt("_sum")).otherwise(F.lit(0.0)).alias("norm")))
    return qterms.join(norm, "query_id", "left")


def query_terms(clauses: DataFrame, index: Index, batch: Batch | None = None, phrases: bool = True,
                terms: bool = True) -> DataFrame | None:
    """Expanded terms of the term-like and phrase (``_ph``) clauses with df, idf
    and norm, written: an index that isn't stored would be built again by every
    use of them.  None if the batch has none."""
    batch = batch or batch_of(clauses)
    plain = {k.rstrip("~-") for k in batch.kinds}
    parts = []
    if terms and plain & set(TERM_KINDS):
        parts.append(expand_terms(clauses, index, batch).withColumn("_ph", F.lit(False)))
    if phrases and plain & set(PHRASE_KINDS):
        parts.append(phrase_slots(clauses, index).withColumn("_ph", F.lit(True)))
    if not parts:
        return None
    qterms = with_idf(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), index)
    return materialize(with_norm(materialize(qterms, "query-terms"), clauses), "query-norms")


def listed_terms(qterms: DataFrame) -> list[str] | None:
    """The terms of the batch, or None if there are more than a list takes."""
    keys = qterms.select("term").distinct().limit(PUSHDOWN_MAX_TERMS + 1).collect()
    return [r.term for r in keys] if len(keys) <= PUSHDOWN_MAX_TERMS else None


def pushed_terms(frame: DataFrame, qterms: DataFrame) -> DataFrame:
    """A stored table sorted by term, cut to the terms of the batch if they are
    few enough for a list that reaches the scan."""
    keys = listed_terms(qterms)
    return frame if keys is None else frame.where(F.col("term").isin(keys))


def postings_of(index: Index, qterms: DataFrame) -> DataFrame:
    """Postings that hold at least those of the batch's terms: scanned with the
    terms pushed, or made from the tokens of those terms alone."""
    if index.stored:
        return pushed_terms(index.postings, qterms)
    keys = None if index.arrays is None else listed_terms(qterms)
    return index.postings if keys is None else build_postings(of_terms(index.arrays, keys))


def cut_to_batch(index: Index, clauses: DataFrame, batch: Batch) -> Index:
    """An index that isn't stored, cut to the terms of a batch that needs no
    vocabulary (no pattern, no fuzzy match): the texts are split once, and the
    batch's tokens are written with the length of each field, which give its
    postings, counts and corpus figures.  Any other index stays as it is."""
    if index.stored or index.arrays is None or any(k.rstrip("-") in (*PATTERNS, "match~") for k in batch.kinds):
        return index
    parts = [of for of, kinds in ((expand_terms(clauses, index, batch), TERM_KINDS), (phrase_slots(clauses, index), PHRASE_KINDS)) if batch.kinds & set(kinds)]
    keys = listed_terms(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])) if parts else None
    if keys is None:
        return index
    mine = materialize(of_terms(index.arrays, keys), "batch-tokens")
    postings, lengths = build_postings(mine), mine.select("doc_id", "field", F.col("field_len").alias("n_terms")).where("n_terms > 0")
    return replace(index, postings=postings, term_df=doc_freq(postings), field_len=lengths, corpus=corpus_stats(lengths), arrays=None)


def lookup(clauses: DataFrame, index: Index, batch: Batch | None = None, phrases: bool = True,
           terms: bool = True, qterms: DataFrame | None = None) -> DataFrame | None:
    """Postings of the terms of term-like and phrase (``_ph``) clauses, with
    df, idf and norm; None if the batch has none.  The term side is broadcast
    when its row count is checked small; on a stored index a list of up to
    ``PUSHDOWN_MAX_TERMS`` terms is also pushed to the Parquet scan, so only
    row groups holding those terms are read."""
    qterms = qterms if qterms is not None else query_terms(clauses, index, batch, phrases, terms)
    if qterms is None:
        return None
    postings = postings_of(index, qterms)
    side = F.broadcast(qterms) if fits(qterms, BROADCAST_MAX_ROWS) else qterms
    return postings.join(side, ["field", "term"])


def term_matches(clauses: DataFrame, index: Index) -> DataFrame:
    """Per (query, clause, slot, term, doc) of the term-like clauses: tf, idf,
    field_len, norm and weight."""
    m = lookup(clauses, index, phrases=False)
    return m.select(*CKEYS, "field", "boost", "slot", "n_slots", "term", "doc_id",
                    "tf", "df", "idf", "field_len", "norm",
                    scoring.term_weight(F.col("tf"), F.col("idf"), F.col("field_len")).alias("w"))


def phrase_slots(clauses: DataFrame, index: Index) -> DataFrame:
    """Slots of phrase clauses: (CKEYS, field, boost, slot, n_slots, term).
    Gaps, and stop words of an analysed match_phrase, are no slots but keep
    the places of the others."""
    cl = _defaults(_kind(clauses, PHRASE_KINDS))
    slots = cl.select(*CKEYS, "field", "boost", F.filter(
        F.when(F.col("kind") == "match_phrase", analysed_query(index)).otherwise(placed(F.col("terms"))),
        lambda x: x["term"].isNotNull()).alias("qt"))
    return (slots.select("*", F.size("qt").alias("n_slots"), F.explode("qt").alias("t"))
            .select(*CKEYS, "field", "boost", F.col("t.pos").alias("slot"), "n_slots", F.col("t.term").alias("term")))


def phrase_starts(m: DataFrame) -> DataFrame:
    """F07 match_phrase (analysed text) and F08 phrase (terms with null gaps):
    (query, clause, doc, freq, idf_sum, ...) of the documents with the phrase.

    Each posting's positions are exploded and shifted by the slot of its term;
    a phrase starts where all non-gap slots meet: one ``groupBy`` on
    (query, clause, doc, start), any phrase length, no self-joins."""
    kept = [F.first(c).alias(c) for c in ("field_len", "boost", "norm")]
    occ = (m.where("_ph").select(*CKEYS, "doc_id", "boost", "norm", "n_slots", "field_len", "slot", "idf",
                                 F.explode("positions").alias("pos"))
           .groupBy(*CKEYS, "doc_id", (F.col("pos") - F.col("slot")).alias("start"))
           .agg(F.count(F.lit(1)).alias("k"), F.first("n_slots").alias("n_slots"), F.sum("idf").alias("idf_sum"), *kept)
           .where(F.col("k") == F.col("n_slots")))
    return occ.groupBy(*CKEYS, "doc_id").agg(F.count(F.lit(1)).alias("freq"), F.first("idf_sum").alias("idf_sum"), *kept)


def mixed_hits(m: DataFrame) -> DataFrame:
    """Term-like and phrase clauses of one batch from a single postings scan:
    F01 term, F02 prefix, F05 match, F06 fuzzy match, F07 and F08 phrases, F15.

    Positions are exploded for phrase rows only (a term row keeps one row with
    a null position); the first aggregation groups phrase rows by start (see
    ``phrase_starts``) and term rows by (query, clause, doc); the second folds
    both to one score per (query, clause, doc).  On the doc-bucketed index
    neither step shuffles."""
    w = (scoring.term_weight(F.col("tf"), F.col("idf"), F.col("field_len"))
         * scoring.query_factor(F.col("norm"), F.col("idf")))
    x = m.select(*CKEYS, "doc_id", "_ph", "boost", "norm", "slot", "n_slots", "idf", "field_len", w.alias("w"),
                 F.explode_outer(F.when(F.col("_ph"), F.col("positions"))).alias("pos"))
    start = F.when(F.col("_ph"), F.col("pos") - F.col("slot"))
    kept = [F.first(c).alias(c) for c in ("n_slots", "field_len", "boost", "norm")]
    g1 = (x.groupBy(*CKEYS, "doc_id", "_ph", start.alias("start"))
          .agg(F.count(F.lit(1)).alias("k"), F.sum("idf").alias("idf_sum"), F.sum("w").alias("sw"),
               F.size(F.collect_set("slot")).alias("matched"), *kept)
          .where(~F.col("_ph") | (F.col("k") == F.col("n_slots"))))
    g2 = g1.groupBy(*CKEYS, "doc_id").agg(
        F.first("_ph").alias("_ph"), F.count(F.lit(1)).alias("freq"), F.first("idf_sum").alias("idf_sum"),
        F.first("sw").alias("sw"), F.first("matched").alias("matched"), *kept)
    phrase = (F.col("boost") * scoring.phrase_weight(F.col("freq"), F.col("idf_sum"), F.col("field_len"))
              * scoring.query_factor(F.col("norm"), F.col("idf_sum")))
    term = F.col("boost") * F.col("sw") * F.col("matched") / F.col("n_slots")
    return g2.select(*CKEYS, "doc_id", F.when(F.col("_ph"), phrase).otherwise(term).alias("score"))


def range_hits(clauses: DataFrame, index: Index, batch: Batch | None = None) -> DataFrame:
    """F03 numeric range, F04 date range (bounds in epoch seconds).  Bounds:
    null = open; min inclusive and max exclusive unless the flags say otherwise.

    The bounds of a field's clauses span an axis of equal bins; a clause is
    joined on the bins it covers and checked exactly, so a value meets only
    clauses that reach into its bin."""
    side = (batch or batch_of(clauses)).side
    cl = _defaults(_kind(clauses, RANGE_KINDS))
    cl = (cl.withColumn("incl_min", F.coalesce("incl_min", F.lit(True)))
          .withColumn("incl_max", F.coalesce("incl_max", F.lit(False)))
          .select(*CKEYS, "field", "boost", "min", "max", "incl_min", "incl_max"))
    axis = cl.groupBy("field").agg(F.min(F.least("min", "max")).alias("_lo"), F.max(F.greatest("min", "max")).alias("_hi"))

    def bin_of(x):
        inside = F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(RANGE_BINS))
        return (F.when(x < F.col("_lo"), F.lit(-1)).when(x > F.col("_hi"), F.lit(RANGE_BINS + 1))
                .when(F.col("_hi") > F.col("_lo"), inside).otherwise(F.lit(0)).cast("int"))
    first = F.when(F.col("min").isNull(), F.lit(-1)).otherwise(bin_of(F.col("min")))
    last = F.when(F.col("max").isNull(), F.lit(RANGE_BINS + 1)).otherwise(bin_of(F.col("max")))
    covered = (cl.join(side(axis), "field").where("min IS NULL OR max IS NULL OR min <= max")
               .withColumn("_bin", F.explode(F.sequence(first, last))).drop("_lo", "_hi"))
    values = (index.docs.where(F.col("value").isNotNull()).join(side(axis), "field")
              .withColumn("_bin", bin_of(F.col("value"))))
    v = F.col("value")
    lo = F.col("min").isNull() | F.when(F.col("incl_min"), v >= F.col("min")).otherwise(v > F.col("min"))
    hi = F.col("max").isNull() | F.when(F.col("incl_max"), v <= F.col("max")).otherwise(v < F.col("max"))
    return (values.join(side(covered), ["field", "_bin"]).where(lo & hi)
            .select(*CKEYS, "doc_id", F.col("boost").alias("score")))


def all_hits(clauses: DataFrame, index: Index, batch: Batch | None = None) -> DataFrame:
    """F16 match all: every document, with or without indexed text."""
    side = (batch or batch_of(clauses)).side
    cl = _defaults(_kind(clauses, ["all"])).select(*CKEYS, F.lit(True).alias("_every"), F.col("boost").alias("score"))
    return index.ids.withColumn("_every", F.lit(True)).join(side(cl), "_every").select(*CKEYS, "doc_id", "score")


def id_hits(clauses: DataFrame, index: Index, batch: Batch | None = None) -> DataFrame:
    """F16 ids: documents whose id is listed in ``terms``, in the key's type."""
    side = (batch or batch_of(clauses)).side
    key = index.ids.schema["doc_id"].dataType
    ids = (_defaults(_kind(clauses, ["ids"])).select(*CKEYS, "boost", F.explode("terms").alias("id"))
           .select(*CKEYS, F.col("boost").alias("score"), F.col("id").try_cast(key).alias("doc_id"))
           .where(F.col("doc_id").isNotNull()).distinct())
    return index.ids.join(side(ids), "doc_id").select(*CKEYS, "doc_id", "score")


def with_implicit_all(clauses: DataFrame) -> DataFrame:
    """A query with only MUST NOT clauses matches all documents minus those:
    add a MUST match-all clause (boost 1) to such queries."""
    pos = (clauses.groupBy("query_id")
           .agg(F.sum(F.when(F.col("occur") != "must_not", 1).otherwise(0)).alias("n_pos"))
           .where(F.col("n_pos") == 0))
    extra = pos.select(
        F.col("query_id").cast("int"), F.lit(-1).alias("clause_id"), F.lit("must").alias("occur"),
        F.lit("all").alias("kind"), F.lit(None).cast("string").alias("field"),
        F.lit(None).cast("array<string>").alias("terms"), F.lit(None).cast("double").alias("min"),
        F.lit(None).cast("double").alias("max"), F.lit(None).cast("boolean").alias("incl_min"),
        F.lit(None).cast("boolean").alias("incl_max"), F.lit(None).cast("int").alias("fuzziness"),
        F.lit(None).cast("int").alias("prefix_length"), F.lit(1.0).alias("boost"))
    return clauses.unionByName(extra)


def clause_hits(clauses: DataFrame, index: Index, batch: Batch | None = None, qterms: DataFrame | None = None,
                cut: Callable[[DataFrame], DataFrame] = _plain) -> DataFrame:
    """All leaf clauses of a batch as one tagged union (F14 dispatch).  Only
    the branches for clause kinds present in the batch are planned (the
    clause table is small; its distinct kinds are read once).  ``cut`` is
    applied to the rows of (query_id, doc_id) before they are scored."""
    batch = batch or batch_of(clauses)
    parts = []
    m = lookup(clauses, index, batch, qterms=qterms)
    if m is not None:
        parts.append(mixed_hits(cut(m)))
    if batch.kinds & set(RANGE_KINDS):
        parts.append(cut(range_hits(clauses, index, batch)))
    if "all" in batch.kinds:
        parts.append(cut(all_hits(clauses, index, batch)))
    if "ids" in batch.kinds:
        parts.append(cut(id_hits(clauses, index, batch)))
    if not parts:
        return all_hits(clauses.limit(0), index, batch)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def query_info(clauses: DataFrame, opts: DataFrame | None) -> DataFrame:
    """Per query: MUST and SHOULD counts and the effective SHOULD minimum
    (F10: a given min; else 0 when a MUST is present, else 1)."""
    q = clauses.groupBy("query_id").agg(
        F.sum(F.when(F.col("occur") == "must", 1).otherwise(0)).alias("n_must"),
        F.sum(F.when(F.col("occur") == "should", 1).otherwise(0)).alias("n_should"))
    if opts is not None:
        q = q.join(opts.select("query_id", "min_should"), "query_id", "left")
    else:
        q = q.withColumn("min_should", F.lit(None).cast("int"))
    ms = F.coalesce(F.col("min_should"), F.lit(0))
    eff = (F.when(ms > 0, ms).when(F.col("n_must") > 0, F.lit(0))
           .when(F.col("n_should") > 0, F.lit(1)).otherwise(F.lit(0)))
    return q.select("query_id", "n_must", "n_should", eff.alias("min_eff"))


def combine(hits: DataFrame, clauses: DataFrame, opts: DataFrame | None = None, detail: bool = False,
            batch: Batch | None = None) -> DataFrame:
    """F09 MUST, F10 SHOULD minimum, F11 MUST NOT, F12 boolean, G06 coord: the
    scores of matched MUST clauses, plus those of matched SHOULD clauses times
    the coord, the share of SHOULD clauses that matched.

    With ``detail`` the rows also have the coord and the clauses it is made of
    (``matched``, ``total``, ``coord``; coord 1 without SHOULD clauses).

    One ``groupBy(query_id, doc_id)`` with conditional counts by occur; the
    per-query counts are a side of checked size."""
    is_must = F.col("occur") == "must"
    is_should = F.col("occur") == "should"
    g = hits.groupBy("query_id", "doc_id").agg(
        F.sum(F.when(is_must, 1).otherwise(0)).alias("m"),
        F.sum(F.when(is_should, 1).otherwise(0)).alias("s"),
        F.sum(F.when(F.col("occur") == "must_not", 1).otherwise(0)).alias("neg"),
        F.sum(F.when(is_must, F.col("score")).otherwise(0.0)).alias("musts"),
        F.sum(F.when(is_should, F.col("score")).otherwise(0.0)).alias("shoulds"))
    qi = (batch or batch_of(clauses)).side(query_info(clauses, opts))
    coord = F.when(F.col("n_should") > 0, F.col("s") / F.col("n_should")).otherwise(F.lit(1.0))
    parts = [F.col("s").cast("bigint").alias("matched"), F.col("n_should").cast("bigint").alias("total"), coord.alias("coord")]
    return (g.join(qi, "query_id")
            .where((F.col("m") == F.col("n_must")) & (F.col("neg") == 0)
                   & (F.col("s") >= F.col("min_eff")) & (F.col("m") + F.col("s") > 0))
            .select("query_id", "doc_id", *(parts if detail else []), (F.col("musts") + F.col("shoulds") * coord).alias("score")))


def search_scores(index: Index, clauses: DataFrame, opts: DataFrame | None = None) -> DataFrame:
    """every query of the batch, all matching documents with scores."""
    cl = with_implicit_all(clauses)
    batch = batch_of(cl)
    return combine(clause_hits(cl, cut_to_batch(index, cl, batch), batch), cl, opts, batch=batch)


def total_hits(matches: DataFrame) -> DataFrame:
    """Matches per query before the limit (partial counts map-side)."""
    return matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_hits"))


def _max_window(opts: DataFrame | None, size: int, from_: int) -> int:
    if opts is None:
        return from_ + size
    end = F.coalesce(F.col("from"), F.lit(from_)) + F.coalesce(F.col("size"), F.lit(size))
    return max(from_ + size, opts.agg(F.max(end)).first()[0] or 0)


def _leaders(table: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows of each query by score desc, doc_id asc."""
    table = table.take(pc.sort_indices(table, sort_keys=[("query_id", "ascending"), ("score", "descending"), ("doc_id", "ascending")]))
    q = table.column("query_id").to_numpy()
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return table.filter(pa.array(rank < k))


def leaders(matches: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, n): the best ``k`` matches of each query in
    every task, and one row (doc_id null) with the number of its matches in
    that task.  Matches stream by in Arrow batches and are neither written nor
    shuffled; a task keeps ``k`` rows a query."""
    schema = T.StructType([*(f for f in matches.select("query_id", "doc_id", "score").schema.fields), T.StructField("n", T.LongType())])

    def run(batches):
        best, counts = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            for q, n in zip(*(c.to_pylist() for c in now.group_by("query_id").aggregate([([], "count_all")]).select(["query_id", "count_all"]).columns), strict=True):
                counts[q] = counts.get(q, 0) + n
            best = _leaders(now if best is None else pa.concat_tables([best, now]), k)
        if best is None:
            return
        none = pa.nulls(len(counts))
        sums = pa.table({"query_id": pa.array(list(counts), best.schema.field("query_id").type), "doc_id": none.cast(best.schema.field("doc_id").type),
                         "score": none.cast(pa.float64()), "n": pa.array(list(counts.values()), pa.int64())})
        best = best.append_column("n", pa.nulls(best.num_rows, pa.int64()))
        yield from pa.concat_tables([best, sums.select(best.column_names)]).combine_chunks().to_batches()

    return matches.select("query_id", "doc_id", "score").mapInArrow(run, schema)


def topk(matches: DataFrame, opts: DataFrame | None = None, size: int = DEFAULT_SIZE,
         from_: int = DEFAULT_FROM) -> DataFrame:
    """Hits ``from+1 .. from+size`` of each query, ranked by score
    desc then doc_id; with total_hits.

    Every task reduces its matches to the best few of each query and their
    count (``leaders``), so a query matching a third of the corpus shuffles
    (largest from+size of the batch + 1) rows a task, and the ranked rows and
    the totals come from the same pass over the matches."""
    bound = _max_window(opts, size, from_)
    # rank on the rounded score so equal scores tie-break on doc_id only
    found = leaders(matches.withColumn("score", scoring.rounded(F.col("score"))), bound)
    return _pages(found, bound, opts, size, from_)


def _pages(found: DataFrame, bound: int, opts: DataFrame | None, size: int, from_: int) -> DataFrame:
    w = Window.partitionBy("query_id")
    ranked = (found.withColumn("total_hits", F.sum("n").over(w)).where("doc_id IS NOT NULL")
              .withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), F.col("doc_id").asc())))
              .where(F.col("rank") <= F.lit(bound)))
    if opts is not None:
        o = broadcast_if_small(opts.select("query_id", F.col("size").alias("_size"), F.col("from").alias("_from")))
        ranked = (ranked.join(o, "query_id", "left")
                  .withColumn("_size", F.coalesce("_size", F.lit(size)))
                  .withColumn("_from", F.coalesce("_from", F.lit(from_))))
    else:
        ranked = ranked.withColumn("_size", F.lit(size)).withColumn("_from", F.lit(from_))
    page = ranked.where((F.col("rank") > F.col("_from")) & (F.col("rank") <= F.col("_from") + F.col("_size")))
    return page.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score", "total_hits")


def top_hits(matches: DataFrame, size: int = DEFAULT_SIZE, from_: int = 0) -> DataFrame:
    """H07 / H08 for one query: ``orderBy(score desc, doc_id).offset().limit()``
    plans as one TakeOrderedAndProject."""
    out = (matches.withColumn("score", scoring.rounded(F.col("score")))
           .orderBy(F.col("score").desc(), F.col("doc_id").asc()))
    if from_:
        out = out.offset(from_)
    return out.limit(size)


def search(index: Index, clauses: DataFrame, opts: DataFrame | None = None,
           size: int = DEFAULT_SIZE, from_: int = DEFAULT_FROM) -> DataFrame:
    """F14 + H05: ranked page of every query in the batch."""
    return topk(search_scores(index, clauses, opts), opts, size, from_)


# ------------------------------------------------- ranked pages without totals

# Buckets a query is scored in first, those of its largest bounds: they give
# the score that the others have to reach.
FIRST_BUCKETS = 1
_SLACK = 2e-6     # scores are ranked rounded to six decimals


def bucket_bounds(clauses: DataFrame, index: Index, qterms: DataFrame | None, batch: Batch) -> DataFrame:
    """(query_id, bucket, bound): no document of the bucket scores more for the
    query.  Queries and buckets without a row have no match: a MUST clause has
    no posting there.

    A term scores at most with the largest tf / field_len it has in the bucket
    (``impact``); a phrase occurs at most as often as each of its terms, so its
    least term bounds it.  Range, id and match-all clauses score their boost in
    any bucket.  SHOULD scores count whole (coord is at most 1)."""
    cl = _defaults(clauses.where(F.col("kind").isin(CLAUSE_KINDS)))
    parts = []
    if qterms is not None:
        side = F.broadcast(qterms) if fits(qterms, BROADCAST_MAX_ROWS) else qterms
        tops = pushed_terms(index.impact, qterms).groupBy("field", "term", "bucket").agg(F.max("top").alias("top"))
        # per slot of a phrase, as its terms may repeat
        m = tops.join(side, ["field", "term"]).where("occur <> 'must_not'")
        w = F.sqrt("top") * F.col("boost")
        per = m.groupBy(*CKEYS, "bucket", "_ph").agg(
            F.sum(w * F.col("idf") * scoring.query_factor(F.col("norm"), F.col("idf"))).alias("terms"),
            F.min(w).alias("least"), F.sum("idf").alias("idf_sum"), F.count(F.lit(1)).alias("k"), F.first("n_slots").alias("n_slots"), F.first("norm").alias("norm"))
        phrase = F.col("least") * F.col("idf_sum") * scoring.query_factor(F.col("norm"), F.col("idf_sum"))
        parts.append(per.where(~F.col("_ph") | (F.col("k") == F.col("n_slots")))
                     .select(*CKEYS, "bucket", F.when(F.col("_ph"), phrase).otherwise(F.col("terms")).alias("most")))
    if batch.kinds & {*RANGE_KINDS, "all", "ids"}:
        parts.append(_kind(cl, [*RANGE_KINDS, "all", "ids"]).where("occur <> 'must_not'")
                     .select(*CKEYS, F.explode(F.sequence(F.lit(0), F.lit(index.buckets - 1))).alias("bucket"), F.col("boost").alias("most")))
    if not parts:
        return clauses.select("query_id", F.lit(0).alias("bucket"), F.lit(0.0).alias("bound")).limit(0)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    needs = cl.groupBy("query_id").agg(F.sum(F.when(F.col("occur") == "must", 1).otherwise(0)).alias("n_must"))
    return (found.groupBy("query_id", "bucket").agg(F.sum("most").alias("bound"), F.sum(F.when(F.col("occur") == "must", 1).otherwise(0)).alias("musts"))
            .join(batch.side(needs), "query_id").where("musts = n_must").select("query_id", "bucket", "bound"))


def search_leaders(index: Index, clauses: DataFrame, opts: DataFrame | None = None, size: int = DEFAULT_SIZE,
                   from_: int = DEFAULT_FROM) -> tuple[DataFrame, DataFrame]:
    """F14 + H05 without totals, on a stored index: the same pages as
    ``search`` but only in buckets that can hold one of the hits.  Returns the
    pages (query_id, rank, doc_id, score) and the (query_id, bucket, bound,
    scored) decisions.

    Each query is scored in its best ``FIRST_BUCKETS`` buckets first.  If these
    give from + size hits, the last of them is a floor: buckets whose bound is
    below it are never scored for that query."""
    cl = with_implicit_all(clauses)
    batch = batch_of(cl)
    bound = _max_window(opts, size, from_)
    qterms = query_terms(cl, index, batch)
    bounds = materialize(bucket_bounds(cl, index, qterms, batch), "bucket-bounds")
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "bucket")
    first = materialize(bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.lit(FIRST_BUCKETS)).select("query_id", "bucket"), "first-buckets")

    def scored_in(pairs: DataFrame) -> DataFrame:
        near = broadcast_if_small(pairs.select("query_id", F.col("bucket").alias("_in")))
        cut = lambda h: h.join(near, (h["query_id"] == near["query_id"]) & (F.pmod(F.hash(h["doc_id"]), F.lit(index.buckets)) == near["_in"]), "left_semi")
        hits = clause_hits(cl, index, batch, qterms, cut)
        return leaders(combine(hits, cl, opts, batch=batch).withColumn("score", scoring.rounded(F.col("score"))), bound).where("doc_id IS NOT NULL")

    probe = materialize(scored_in(first), "first-leaders")
    ranked = probe.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))))
    floor = ranked.where(F.col("r") == F.lit(bound)).select("query_id", F.col("score").alias("floor"))
    rest = bounds.join(first, ["query_id", "bucket"], "left_anti").join(batch.side(floor), "query_id", "left")
    reach = F.col("floor").isNull() | (F.col("bound") * (1 + 1e-9) + _SLACK >= F.col("floor"))
    decided = materialize(rest.select("query_id", "bucket", "bound", reach.alias("scored"))
                          .unionByName(bounds.join(first, ["query_id", "bucket"], "left_semi").withColumn("scored", F.lit(True))), "bucket-decisions")
    more = decided.where("scored").join(first, ["query_id", "bucket"], "left_anti")
    found = probe.unionByName(materialize(scored_in(more), "more-leaders"))
    return _pages(found, bound, opts, size, from_).drop("total_hits"), decided
