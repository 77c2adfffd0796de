"""Periodic runs of words by maximal-pair enumeration.

A run with smallest period q is a stretch of words in which words q apart are
identical and which no neighbouring word extends.  A stretch [start, end) of
period q is the maximal pair (start, start + q): the two suffixes agree in
exactly ``end - start - q`` words (the words after differ) and the words before
differ.  So runs of at least ``exponent`` periods are read off the maximal pairs
whose distance q is at most (common length) / (exponent - 1), with no extension
of candidates.

In each Arrow batch the words of texts that hold a repeated passage are ordered
by suffix; the tree of longest-common-prefix intervals is walked bottom up, and
every interval keeps its positions in text order, each filed under the class of
its left word.  When two children meet, a position of the smaller one pairs
with its next neighbours of the other one if their classes differ.  Neighbours
are enough: an occurrence in between, at distance d < q, would give the common
words (at least 2 q of them) both periods and so a smaller one.  A period that
is a multiple of a smaller one covers the same stretch; the smallest is kept.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesearch.llm.frames import ensure_text, passes, record
from pagesearch.llm.words import mix

LEAST, EXPONENT = 24, 3
PASS_BYTES = 1_000_000
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
NEW = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def repeated_grams(words: list[list[bytes]], first: np.ndarray, width: int) -> np.ndarray:
    """True for each word that lies in a passage of ``width`` words found at
    another place of its text, too (by hash: at times for some more words).
    ``first[d]`` is the number of words before text d."""
    total = int(first[-1])
    covered = np.zeros(total, bool)
    if total < width:
        return covered
    h = np.fromiter((hash(w) for text in words for w in text), np.int64, total).view(np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        h = mix(h[: len(h) - step] * _BASE + h[step:])
        have += step
    doc = np.repeat(np.arange(len(words)), np.diff(first))
    starts = np.flatnonzero(doc[: len(h)] == doc[width - 1 :])
    keys = mix(h[starts] + doc[starts].astype(np.uint64) * _BASE)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return covered
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    hit = starts[twice[at] == keys]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return np.cumsum(edge[:-1]) > 0


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and common prefixes of neighbours (0 first) of an array
    whose suffixes all differ, by doubled ranks."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    ranks, have = [rank.astype(np.int64)], 1
    low = max(1, (n - 1).bit_length())
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - have)] = ranks[-1][have:] + 1
        key = ranks[-1].astype(np.uint64) * np.uint64(n + 1) + second.astype(np.uint64)
        if 3 * low + 1 <= 64:
            packed = np.sort((key << np.uint64(low)) | np.arange(n, dtype=np.uint64))
            order = (packed & np.uint64((1 << low) - 1)).astype(np.int64)
        else:
            order = np.argsort(key, kind="stable")
        value = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([False], value[1:] != value[:-1])))
        if rank[order[-1]] == n - 1:
            break
        ranks.append(rank)
        have *= 2
    common = np.zeros(n, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        padded = np.append(ranks[level], -1)
        a, b = order[:-1] + common[1:], order[1:] + common[1:]
        inside = (a < n) & (b < n)
        same = inside & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
        common[1:] += same.astype(np.int64) << level
    return order, common


def _meet(big: list[int], small: list[int], common: int, reach: int, left: dict, out: list) -> list[int]:
    """Both children's positions in one list; the maximal pairs of neighbours
    with left words of different classes go to ``out``."""
    if len(big) < len(small):
        big, small = small, big
    for x in small:
        p = bisect_left(big, x)
        c = left[x]
        if p < len(big) and big[p] - x <= reach and left[big[p]] != c:
            out.append((x, big[p] - x, common))
        if p and x - big[p - 1] <= reach and left[big[p - 1]] != c:
            out.append((big[p - 1], x - big[p - 1], common))
    if len(small) < 8:
        for x in small:
            insort(big, x)
    else:
        big += small
        big.sort()
    return big


def maximal_pairs(positions: list[int], common: list[int], left: dict, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(position, distance, common words) from suffixes in order: the interval
    tree bottom up.  ``common[k]`` belongs to suffixes k - 1 and k."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []
    for k, at in enumerate(positions):
        border = common[k + 1] if k + 1 < len(positions) else 0
        child = [at]
        while stack and stack[-1][0] > border:
            value, inside = stack.pop()
            child = _meet(inside, child, value, value // (exponent - 1), left, out)
        if border < least:
            if stack and stack[-1][0] == border:
                stack.pop()
        elif stack and stack[-1][0] == border:
            value, inside = stack.pop()
            stack.append((border, _meet(inside, child, border, border // (exponent - 1), left, out)))
        else:
            stack.append((border, child))
    return out


def runs_of(words: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period) by start, then period."""
    found: list[dict] = [{} for _ in words]
    # with period q the pair shares length - q >= max(least - q, (exponent - 1) q) words
    width = -(-least * (exponent - 1) // exponent)
    first = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    covered = repeated_grams(words, first, width)
    at = np.flatnonzero(covered)
    if not len(at):
        return [[] for _ in words]
    doc = np.searchsorted(first, at, side="right") - 1
    ids: dict = {}
    own = np.array([ids.setdefault(words[d][i], len(ids)) for d, i in zip(doc.tolist(), (at - first[doc]).tolist(), strict=True)])
    before = [words[d][i - 1] if i else None for d, i in zip(doc.tolist(), (at - first[doc]).tolist(), strict=True)]
    left = dict(zip(at.tolist(), (ids.get(w, w) for w in before), strict=True))
    # a symbol of its own after each covered stretch; words of two texts differ
    cut = np.flatnonzero(np.concatenate((at[1:] != at[:-1] + 1, [True])) | np.concatenate((doc[1:] != doc[:-1], [True])))
    symbols = np.insert(doc * (len(ids) + 1) + own, cut + 1, -1 - np.arange(len(cut)))
    place = np.insert(at, cut + 1, -1)
    order, common = suffix_order(symbols)
    near = np.concatenate((common[1:] >= width, [False]))
    part = near | (common >= width)
    order, common = order[part], np.where(common[part] >= width, common[part], 0)
    for x, q, shared in maximal_pairs(place[order].tolist(), common.tolist(), left, width, exponent):
        if shared + q >= least and shared >= (exponent - 1) * q:
            d = int(np.searchsorted(first, x, side="right")) - 1
            stretch = x - int(first[d]), shared + q
            found[d][stretch] = min(q, found[d].get(stretch, q))
    return [sorted((s, n, q) for (s, n), q in f.items()) for f in found]


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of start, length, period, word
    numbers from 0: stretches with smallest period ``period`` of at least
    ``least`` words and ``exponent`` periods that no neighbouring word extends)
    and ``collapsed``: the words joined by one space, without those that any run
    holds after its first period.

    Words are maximal runs of characters other than space and \\t\\n\\v\\f\\r.
    A null or empty text has no words, no runs and an empty ``collapsed``.  Each
    row is taken on its own and whole, however long; equal rows give equal
    results, an empty table an empty one.  Columns of ``docs`` named like a new
    one are replaced; other columns stay as they are.  No shuffle.
    """
    kept = ensure_text(docs, text).drop(*[n for n in NEW.names if n != text])
    out = T.StructType([*kept.schema.fields, *NEW.fields])

    def run(batches):
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            for lo, hi in passes([t or b"" for t in texts], PASS_BYTES):
                words = [(t or b"").split() for t in texts[lo:hi]]
                runs = runs_of(words, least, exponent)
                new = record(NEW, [[len(w) for w in words], [[dict(zip(RUN.names, r, strict=True)) for r in x] for x in runs],
                                   pa.array([_kept(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())])
                yield pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in batch.columns] + new.columns, names=out.names)

    return kept.mapInArrow(run, out)


def with_planted_periods(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where the tail of every tenth text repeats.  With h the CRC-32
    of the decimal id and g = h div 10: if h mod 10 is 0 and the text has n > 0
    words, each word i >= a = g mod n becomes word a + (i - a) mod p, p = 1 +
    (n - a) div (3 + g mod 8), and the words are joined by one space.  All other
    texts, and those of rows without an id, stay."""
    def run(batches):
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            for k, key in enumerate(batch.column(doc_id).to_pylist()):
                h = 1 if key is None else crc32(str(key).encode())
                words = (texts[k] or b"").split() if h % 10 == 0 else []
                if words:
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join(words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a])
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if name == text else c for name, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    docs = ensure_text(docs, text)
    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from ``runs`` and ``collapsed``: the run of
    greatest length / period (compared as fractions; the first by start, then
    period, of equal ones), and digests."""
    none = F.lit(None).cast(RUN)
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r.length * b.period > b.length * r.period), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
