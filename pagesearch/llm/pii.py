"""Personal data: fixed patterns, and information-theoretic sanitisation.

The patterns give the protected entities (an e-mail address, an IP address, a
card or a phone number).  How much a term reveals of an entity is
estimated from co-occurrence in the corpus: with df as the number of documents
that hold a term or an entity, and joint the number of documents that hold both
(the term outside of entities), the disclosure is the pointwise mutual information
of both over the information content of the entity,

    log(joint * D / (df(term) * df(entity))) / log(D / df(entity)),

1 when the term gives the entity away.  Terms beyond a threshold are
generalised, beyond a higher one removed, wherever they stand in a document that
holds the entity.  An entity of one document alone has no such terms: one
document tells nothing about what goes with it, and each rare word of its text
would seem to give it away.

Everything is DataFrame functions.  No entity spans a line feed, so patterns
run on whole texts; Java's possessive quantifiers stand where backing off can't
change the match, so that long runs need no stack; and a match begins where the
last one ended or where a run of its first characters does, as no later place
of that run can match if the first can't, so that long runs are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesearch.llm.frames import quoted
from pagesearch.session import materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# fixed by the task
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# a text without this can't match
HINTS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
         "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.rlike(r"\+[0-9]")}
LETTERS = r"\p{L}{3,}"       # what counts as a term, lower-cased
HIDDEN = "\uffff"            # stands for a letter of an entity
OUTSIDE = rf"(?<![\p{{L}}{HIDDEN}]){LETTERS}+(?!{HIDDEN})"     # terms that no entity overlaps
SUPPORT = 2                  # documents in which term and entity meet, at least
GENERALISE, REMOVE = 0.6, 0.9
_SPAN = "struct<kind:int,s:int,e:int,value:string>"


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
                        & (F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255))
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def _value(kind: str, m: Column) -> Column:
    """What tells one entity from another."""
    return F.lower(m) if kind == "email" else m if kind == "ip" else F.regexp_replace(m, "[^0-9]", "")


def _walk(text: Column, pattern: str, keep, element: str, make) -> Column:
    """Matches of ``pattern`` that ``keep`` accepts, in order, as ``make(start,
    end, match)``: the pieces between matches and the matches alternate, so
    their lengths add up to the places."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{element}>").alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["p"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        found = F.when(x["m"].isNotNull() & keep(s, e, x["m"]), F.concat(acc["out"], F.array(make(s, e, x["m"]).cast(element)))).otherwise(acc["out"])
        return F.struct(e.alias("at"), found.alias("out"))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """array<struct<kind, s, e, value>> of the patterns: by kind as listed, then start."""
    none = F.array().cast(f"array<{_SPAN}>")
    arrays = []
    for i, kind in enumerate(KINDS):
        found = _walk(text, PATTERNS[kind], lambda s, e, m, k=kind: _valid(k, m), _SPAN,
                      lambda s, e, m, k=kind, n=i: F.struct(F.lit(n), s, e, _value(k, m)))
        arrays.append(F.when(HINTS[kind](text), found).otherwise(none))
    return F.concat(*arrays)


def entities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, version (hash of the text, which tells
    rows with one key apart), spans, and, if there are any, the text with the
    letters of all spans hidden."""
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    s = d.select("key", "text", base_spans(F.col("text")).alias("spans"))
    return s.select("key", F.xxhash64("text").alias("version"), "spans", F.when(F.size("spans") > 0, _hidden(F.translate("text", HIDDEN, " "), F.col("spans"))).alias("outside"))


def _hidden(text: Column, spans: Column) -> Column:
    """``text`` with each letter inside a span as HIDDEN: no character moves."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))

    def step(acc, x):
        s = F.greatest(acc["at"], x["s"])
        part = F.regexp_replace(F.substr(text, s + 1, F.greatest(x["e"] - s, F.lit(0))), r"\p{L}", HIDDEN)
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s - acc["at"]), part).alias("out"))
    return F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["key"].eqNullSafe(b["_key"]) & (a["version"] == b["_version"])


def entity_documents(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, value, df_entity) of the entities of ``SUPPORT`` documents or more,
    and the documents that hold any: key, version, those entities, and the
    distinct terms of the whole text that are no part of an entity."""
    held = found.where(F.size("spans") > 0).dropDuplicates(["key", "version"])
    each = held.select("key", "version", F.explode(F.array_distinct(F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))))).alias("x")).select("key", "version", "x.*")
    entity = materialize(each.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("df_entity")).where(F.col("df_entity") >= SUPPORT), "entity-counts")
    of = (each.join(entity, ["kind", "value"]).groupBy("key", "version").agg(F.collect_list(F.struct("kind", "value")).alias("entities"))
          .withColumnsRenamed({"key": "_key", "version": "_version"}))
    terms = F.array_distinct(F.transform(F.regexp_extract_all("outside", F.lit(OUTSIDE), F.lit(0)), F.lower))
    return entity, materialize(held.join(of, _same(held, of)).select("key", "version", "entities", terms.alias("terms")), "entity-documents")


def together(documents: DataFrame) -> DataFrame:
    """(key, version, kind, value, term): each entity with each term of its documents."""
    return (documents.select("key", "version", "terms", F.explode("entities").alias("x"))
            .select("key", "version", "x.*", F.explode("terms").alias("term")))


def disclosures(docs: DataFrame, entity: DataFrame, documents: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value, term, disclosure) of the pairs that meet in at least
    ``SUPPORT`` documents, from counts over all documents."""
    joint = together(documents).groupBy("kind", "value", "term").agg(F.count(F.lit(1)).alias("joint"))
    pairs = materialize(joint.where(F.col("joint") >= SUPPORT), "entity-terms")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(LETTERS), F.lit(0)))
    # an inner join below: a semi-join would be pushed under the aggregation at
    # small sizes alone, and the plan should be one for all sizes
    df = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_term"))
    total = docs.count()
    information = F.log(F.lit(float(total)) / F.col("df_entity"))
    mutual = F.log(F.col("joint") * F.lit(float(total)) / (F.col("df_term") * F.col("df_entity")))
    return (pairs.join(entity, ["kind", "value"]).join(df, "term")
            .select("kind", "value", "term", F.when(information > 0, mutual / information).otherwise(F.lit(0.0)).alias("disclosure")))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, version, ``base`` and ``revealing``: one row per row of ``docs``.

    ``base`` has the spans of the patterns as (kind, s, e, value), ``revealing``
    the terms beyond the threshold, of any place in the text, as (s, e, disclosure), in code points,
    end exclusive.  A null text counts as empty; empty texts have no spans.
    Rows that repeat key and text count as one document and get equal spans;
    one key with two texts is two documents, a null key is a key like others.
    Extra columns are not read; an empty table gives no rows.
    """
    found = materialize(entities(docs, key, text), "entities")
    entity, documents = entity_documents(found)
    told = materialize(disclosures(docs, entity, documents, text).where(F.col("disclosure") >= GENERALISE), "disclosures")
    terms = (together(documents).join(told, ["kind", "value", "term"])
             .groupBy("key", "version", "term").agg(F.max("disclosure").alias("disclosure"))
             .groupBy("key", "version").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("told"))
             .withColumnsRenamed({"key": "_key", "version": "_version"}))
    term = "struct<s:int,e:int,disclosure:double>"
    places = _walk(F.col("outside"), OUTSIDE, lambda s, e, m: F.map_contains_key("told", F.lower(m)), term,
                   lambda s, e, m: F.struct(s, e, F.try_element_at("told", F.lower(m))))
    j = (found.join(terms, _same(found, terms), "left")
         .select("key", "version", F.col("spans").alias("base"), F.when(F.col("told").isNotNull(), places).alias("revealing")))
    return j.select(F.col("key").alias(key), "version", "base",
                    F.coalesce("revealing", F.array().cast("array<struct<s:int,e:int,disclosure:double>>")).alias("revealing"))


def joined(spans: Column, name) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def kind_name(x: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` sanitised: entities become <kind>, terms beyond the
    lower threshold <term>, beyond the upper one nothing.  Where spans overlap,
    the one that starts first holds.  A null text stays null.  Other columns
    stay as they are, whatever their names; an empty table gives an empty one."""
    marks = spans(docs, key, text)
    cut = F.array_sort(F.concat(
        F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit("<"), kind_name(x), F.lit(">")).alias("by"))),
        F.transform("revealing", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["disclosure"] >= REMOVE, F.lit("")).otherwise(F.lit(f"<{TERM}>")).alias("by")))))
    marks = marks.select(F.col(key).alias("of_key"), F.col("version").alias("of_version"), cut.alias("cut")).where(F.size("cut") > 0).distinct()
    # the user's columns travel in one struct, so no name of theirs meets one of these
    d = docs.select(F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("own"), quoted(key).alias("key"), quoted(text).cast("string").alias("body"),
                    F.xxhash64(F.coalesce(quoted(text).cast("string"), F.lit(""))).alias("version"))
    j = d.join(marks, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("version") == F.col("of_version")), "left")
    body = F.aggregate("cut", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, x: F.when(
        x["s"] >= acc["at"], F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substr("body", acc["at"] + 1, x["s"] - acc["at"]), x["by"]).alias("out"))).otherwise(acc),
        lambda acc: F.concat(acc["out"], F.substr("body", acc["at"] + 1)))
    return j.select(*[F.when(F.col("cut").isNull(), F.col("body")).otherwise(body).alias(c) if c == text else F.col("own").getField(c).alias(c) for c in docs.columns])


def _count(spans: Column, kind: int) -> Column:
    """Spans of a kind.  The lambda has one parameter alone: Spark gives a
    second one the position."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind))


def digest(marks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns of ``spans()``."""
    base = joined(F.col("base"), kind_name)
    counts = [_count(F.col("base"), i).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    terms = joined(F.col("revealing"), lambda x: F.lit(TERM))
    every = F.concat_ws(",", F.when(base != "", base), F.when(terms != "", terms))
    return marks.select(key, *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
