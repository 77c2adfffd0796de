"""Runs of words against a direct definition."""

import hashlib
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from pagesearch.llm import periodic as P
from tests.llm.conftest import DOC, ODD


def brute(words, least, exponent):
    """All maximal stretches by period, from the definition."""
    best = {}
    n = len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in best.items())


def texts(rng, n):
    for _ in range(n):
        letters = rng.choice([b"a", b"ab", b"abc", b"abcdefghij"])
        words = []
        while len(words) < rng.randint(0, 90):
            unit = [bytes([c]) for c in rng.choices(letters, k=rng.randint(1, 9))]
            words += unit * rng.choice([1, 1, 2, 3, 4, 7])
        yield words


@pytest.mark.parametrize("least,exponent", [(24, 3), (6, 2), (9, 3), (4, 4)])
def test_runs_match_definition(least, exponent):
    docs = list(texts(random.Random(least), 400))
    assert P.runs_of(docs, least, exponent) == [brute(w, least, exponent) for w in docs]


def test_long_texts_of_one_word_and_of_repeated_phrases():
    assert P.runs_of([[b"x"] * 200_000, [b"a", b"b"] * 60_000]) == [[(0, 200_000, 1)], [(0, 120_000, 2)]]
    rng = random.Random(2)
    phrase = [b"p%d" % i for i in range(20)]
    words = [w for i in range(2000) for w in [*phrase, b"u%d" % i, *([b"v"] * rng.randint(0, 2))]]
    assert P.runs_of([words]) == [[]]


def plain(doc_id, text):
    """The contract, word by word."""
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and crc32(str(doc_id).encode()) % 10 == 0:
        g = crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words, 24, 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = (None,) * 3
    for r in runs:
        if best[0] is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (str(doc_id), len(runs), *map(str, best), str(1000 * best[1] // best[2] if runs else None),
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def results(docs):
    out = P.digest(P.periodic_runs(P.with_planted_periods(docs))).collect()
    return sorted((str(r.doc_id), r.n_runs, str(r.start), str(r.length), str(r.period), str(r.exponent_milli), r.runs_sha256, r.collapsed_sha256) for r in out)


def test_documents_match_definition(documents):
    docs = documents.where("n_chars < 4000").select("doc_id", "text")
    got = results(docs)
    assert got == sorted(plain(r.doc_id, r.text) for r in docs.collect())
    assert sum(g[1] > 0 for g in got) > 20


def test_odd_texts(spark, frame):
    rows = [r for r in ODD if len(r[1] or "") < 200_000 and r[0] != 8] + [(30, "a b " * 40), (31, " x\x1cy\xa0z " * 30), (16, "w " * 80)]
    assert results(frame(rows)) == sorted(plain(*r) for r in rows)
    assert results(spark.createDataFrame([], DOC)) == []


def test_own_columns_stay(frame):
    df = frame([(1, "a b c " * 20)]).withColumn("best", F.lit(1)).withColumn("words", F.lit(2)).withColumn("runs", F.lit("replaced"))
    (row,) = P.periodic_runs(df).collect()
    assert (row.best, row.words, row.n_words, row.collapsed) == (1, 2, 60, "a b c")
    assert [tuple(r) for r in row.runs] == [(0, 60, 3)]
