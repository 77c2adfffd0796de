"""Keys of the vocabulary, so that expansion of fuzzy, prefix, wildcard and
regexp clauses is an equi join and no clause is compared with all terms.

* Deletion neighbourhood: if two terms are at most k edits apart, some string
  can be had from both by leaving out at most k characters of their first
  ``HEAD`` ones (of the aligned characters those that lie in both heads stay,
  and each edit or shift costs one character on a side).  So a term has at most
  ``1 + HEAD + HEAD (HEAD - 1) / 2`` keys for two edits, however long it is.
  They are made as the vocabulary is scanned, in generated code, and met with
  the broadcast keys of the query terms; nothing is stored or shuffled.
* Grams: runs of three characters of each term between a start and an end
  mark, stored with the index and sorted, so that a pattern reads the lists of
  its grams alone.  Patterns without three letters in a row use runs of one and
  two, made as the vocabulary is scanned: such a list is most of it anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesearch.session import broadcast_if_small

HEAD = 8          # leading characters that deletion keys are made of
MOST_EDITS = 2    # edits that the stored neighbourhood covers
START, END, GAP = "\x02", "\x03", "\x01"


def near_keys(terms: DataFrame, word: str = "term") -> DataFrame:
    """``terms`` with a row for each of the word's deletion keys: ``h``, the
    hash of its head without ``cut`` (0 .. ``MOST_EDITS``) of its characters.
    Position i is left out, and j too if it is another."""
    head = F.left(F.col(word), F.lit(HEAD))
    rows = terms.withColumn("_i", F.explode(F.sequence(F.lit(0), F.length(head))))
    rows = rows.withColumn("_j", F.explode(F.when(F.col("_i") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.col("_i"), F.length(head)))))
    i, j = F.col("_i"), F.col("_j")
    rest = F.when(i == j, F.substr(head, i + 1)).otherwise(F.concat(F.substr(head, i + 1, j - i - 1), F.substr(head, j + 1)))
    key = F.when(i == 0, head).otherwise(F.concat(F.left(head, i - 1), rest))
    return (rows.withColumn("h", F.xxhash64(key)).withColumn("cut", F.when(i == 0, 0).when(i == j, 1).otherwise(2)).drop("_i", "_j"))


def _marked(word: Column) -> Column:
    return F.concat(F.lit(START), word, F.lit(END))


def gram_keys(terms: DataFrame, short: bool = False) -> DataFrame:
    """(field, gram, term): every run of three characters of the marked term;
    with ``short`` those of one and two."""
    m = _marked(F.col("term"))
    if short:
        return (terms.select("field", "term", F.explode(F.sequence(F.lit(1), F.length(m))).alias("_i"))
                .select("field", "term", "_i", F.explode(F.array(F.lit(1), F.lit(2))).alias("_n"))
                .select("field", F.substr(m, F.col("_i"), F.col("_n")).alias("gram"), "term"))
    return (terms.select("field", "term", F.explode(F.sequence(F.lit(1), F.greatest(F.length(m) - 2, F.lit(1)))).alias("_i"))
            .select("field", F.substr(m, F.col("_i"), F.lit(3)).alias("gram"), "term"))


def _threes(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 2, F.lit(1))), lambda i: F.substr(run, i, F.lit(3)))


def required(literals: Column) -> Column:
    """The grams that a term must have from the literal runs of a pattern
    (between ``GAP`` characters): the runs of three if there are any, else the
    shorter runs as they are.  A pattern without any letter has the start mark,
    which every term has."""
    runs = F.filter(F.split(literals, GAP), lambda r: ~r.isin("", START, END))
    long = F.filter(runs, lambda r: F.length(r) >= 3)
    return F.when(F.size(long) > 0, F.array_distinct(F.flatten(F.transform(long, _threes)))).when(
        F.size(runs) > 0, F.array_distinct(runs)).otherwise(F.array(F.lit(START)))


def is_short(literals: Column) -> Column:
    """Whether a pattern has no run of three characters, marks included."""
    return ~F.exists(F.split(literals, GAP), lambda r: F.length(r) >= 3)


def prefix_literals(prefix: Column) -> Column:
    return F.concat(F.lit(START), prefix)


def wildcard_literals(pattern: Column) -> Column:
    """Runs that a match of a ``*``/``?`` pattern holds, between gaps."""
    return F.concat(F.lit(START), F.translate(pattern, "*?", GAP + GAP), F.lit(END))


def regexp_literals(pattern: Column) -> Column:
    """Runs that every whole match of a regular expression holds: escapes,
    classes, groups and characters that may be left out are gaps.  A pattern
    with alternatives, flags or groups in groups beyond three gives no run."""
    p = F.concat(F.lit(START), pattern, F.lit(END))
    steps = [r"\\(?:[pP]\{[^}]*\}|[\s\S])", r"\[\^?\]?[^\]]*\]", r"\([^()]*\)", r"\([^()]*\)", r"\([^()]*\)",
             r"[\s\S](?:[?*]|\{[^}]*\})[?+]?", r"\+[?+]?", r"[.^$]"]
    for step in steps:
        p = F.regexp_replace(p, step, GAP)
    opaque = F.contains(pattern, F.lit("|")) | F.contains(pattern, F.lit("(?")) | p.rlike(r"[()\[\]{}|?*]")
    return F.when(opaque, F.lit("")).otherwise(p)


def terms_with(gram_table: DataFrame, clauses: DataFrame, literals: Column, keep: list[str]) -> DataFrame:
    """(keep..., term): terms of the clause's field that hold every gram it
    requires.  Only the lists of those grams are read; the caller verifies."""
    wanted = clauses.select(*keep, required(literals).alias("of")).select(*keep, F.size("of").alias("n_of"), F.explode("of").alias("gram"))
    return (gram_table.join(broadcast_if_small(wanted), ["field", "gram"]).groupBy(*keep, "n_of", "term").agg(F.count_distinct("gram").alias("n_has"))
            .where(F.col("n_has") == F.col("n_of")).select(*keep, "term"))
