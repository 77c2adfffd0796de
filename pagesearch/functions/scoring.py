"""The ranking contract, kept in one place so it can be changed.

Vector-space TF-IDF:

* ``idf = 1 + ln(N / (df + 1))`` where ``N`` is the number of documents with
  at least one token in the field and ``df`` the documents holding the term;
* term weight in one document ``w = sqrt(tf) * idf / sqrt(field_len)``;
* a term clause scores ``boost * w``; expansion clauses (prefix, wildcard,
  fuzzy) sum ``w`` over the matched vocabulary terms; ``match`` sums over the
  analysed query terms and multiplies by ``matched / total`` query terms;
* a phrase scores ``boost * sqrt(phrase_freq) * sum(idf) / sqrt(field_len)``;
* range, match-all and id clauses score ``boost``;
* in a query of several MUST and SHOULD clauses the score of each term or
  phrase is also multiplied by ``idf * norm`` (a phrase's idf is the sum of its
  terms'), ``norm = 1 / sqrt(sum((boost * idf)^2))`` over those clauses' terms;
* a boolean query sums the scores of its matched MUST clauses, and those of its
  matched SHOULD clauses times ``coord = matched / total`` SHOULD clauses;
* scores are rounded to ``SCORE_DECIMALS`` on output; ties break on doc id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_DECIMALS = 6


def idf(df_col: Column, n_docs: Column) -> Column:
    return F.lit(1.0) + F.log(n_docs.cast("double") / (df_col + F.lit(1)).cast("double"))


def term_weight(tf: Column, idf_col: Column, field_len: Column) -> Column:
    return F.sqrt(tf.cast("double")) * idf_col / F.sqrt(field_len.cast("double"))


def phrase_weight(freq: Column, idf_sum: Column, field_len: Column) -> Column:
    return F.sqrt(freq.cast("double")) * idf_sum / F.sqrt(field_len.cast("double"))


def query_factor(norm: Column, idf_col: Column) -> Column:
    """What a term's weight is multiplied by in its query; ``norm`` is null in
    a query of one clause."""
    return F.when(norm.isNull(), F.lit(1.0)).otherwise(norm * idf_col)


def rounded(score: Column) -> Column:
    return F.round(score, SCORE_DECIMALS)
