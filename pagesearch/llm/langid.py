"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text.  A text is
parsed against it from left to right into the longest phrases that occur in
the language's text; the number of phrases times the logarithm of the length
of that text, per byte, is the cross-parsing estimate of the cross entropy.
The language with the fewest normalised phrases wins.

Texts are parsed in lanes: numpy steps through thousands of segments at once,
one byte at a time, in all automata.  A lane begins a phrase of its own; the
lane before goes on past its end until it begins a phrase where that lane did,
and what the lane had counted up to there is taken back, so phrases are those
of the whole text.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesearch.llm.frames import add_columns, held_out
from pagesearch.session import broadcast_if_small, materialize

SAMPLE_ROWS, SAMPLE_CHARS = 64, 4000   # rows a language and characters of each that are learned from
PIECES, PIECE_BYTES = 8, 256           # into which those characters are cut at most, and the bytes learned at least
SAMPLE_BYTES = 49_152                  # bytes of each automaton's text
TOGETHER = 4                           # automata that are in a task's memory at a time
SEGMENT = 1024                         # bytes of text in a lane
UNKNOWN = "und"
_FLAG = 1 << 30
_FOLD = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def normalise(text: str) -> bytes:
    """Lower case, ASCII other than letters as single spaces, in UTF-8."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


def suffix_automaton(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions (state, byte, next state) of the automaton that accepts the substrings of ``data``."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    n = [len(x) for x in to]
    return (np.repeat(np.arange(len(to), dtype=np.int32), n),
            np.fromiter((c for x in to for c in x), np.uint8, sum(n)),
            np.fromiter((s for x in to for s in x.values()), np.int32, sum(n)))


class Parser:
    """All automata in one table.  An entry is the next state, already times
    the number of byte classes; where a phrase cannot go on it is flagged and
    names the state after a new phrase's first byte."""

    def __init__(self, models: list[tuple[str, int, bytes, bytes, bytes]]):
        self.langs = [m[0] for m in models]
        self.bits = np.array([math.log2(max(2, m[1])) for m in models])
        edges = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.uint8), np.frombuffer(c, np.int32)) for _, _, a, b, c in models]
        used = np.unique(np.concatenate([e[1] for e in edges])) if edges else np.zeros(0, np.uint8)
        self.classes = np.zeros(256, np.int32)      # 0: a byte that no language has
        self.classes[used] = np.arange(1, len(used) + 1)
        n = len(used) + 1
        states = [int(e[2].max(initial=0)) + 2 for e in edges]   # the last: after a byte that the language lacks
        self.root = (np.concatenate(([0], np.cumsum(states)))[:-1] * n).astype(np.int32)
        tables = []
        for (src, byte, dst), count, root in zip(edges, states, self.root, strict=True):
            t = np.full((count, n), -1, np.int32)
            t[src, self.classes[byte]] = dst * n + root
            again = np.where(t[0] >= 0, t[0], root + (count - 1) * n) | _FLAG
            tables.append(np.where(t >= 0, t, again).ravel())
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases, by language and text."""
        size = np.array([len(t) for t in texts])
        flat = self.classes[np.frombuffer(b"".join(texts), np.uint8)]
        offset = np.cumsum(size) - size
        lanes = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start, length = offset[doc] + nth * SEGMENT, np.minimum(SEGMENT, size[doc] - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        start, length, doc = start[order], length[order], doc[order]
        stop = offset[doc] + size[doc]
        counts = np.zeros((len(self.langs), len(texts)), np.int64)
        for k, root in enumerate(self.root):
            begins = np.zeros(len(flat) + 1, bool)     # where a lane's own phrases begin
            state, own = np.full(len(doc), root, np.int32), np.ones(len(doc), np.int64)
            begins[start] = True
            active = np.searchsorted(-length, -np.arange(1, SEGMENT + 1), side="right")
            for j in range(int(length.max(initial=0))):
                a = active[j]
                step = self.table[state[:a] + flat[start[:a] + j]]
                if j:
                    new = step >> 30
                    own[:a] += new
                    begins[start[:a][new > 0] + j] = True
                state[:a] = step & (_FLAG - 1)
            counts[k] = self._joined(k, flat, begins, state, own, start, start + length, stop, doc, len(texts))
        return counts

    def _joined(self, k, flat, begins, state, own, start, end, stop, doc, n_texts) -> np.ndarray:
        """Phrases by text from the lanes' own: each lane with a next one goes
        on over its end.  ``met`` is where it begins a phrase that another lane
        begins, too (or the text's end); ``extra`` counts its phrases till then."""
        met, extra = stop.copy(), np.zeros(len(doc), np.int64)
        at, now, lane = end.copy(), state.copy(), np.flatnonzero(end < stop)
        while len(lane):
            step = self.table[now[lane] + flat[at[lane]]]
            new = step >> 30 > 0
            found = new & begins[at[lane]]
            met[lane[found]] = at[lane[found]]
            extra[lane[new & ~found]] += 1
            now[lane], at[lane] = step & (_FLAG - 1), at[lane] + 1
            lane = lane[~found & (at[lane] < stop[lane])]
        total = np.zeros(n_texts, np.int64)
        before = np.concatenate(([0], np.cumsum(begins)))
        order = np.lexsort((start, doc))
        last, reach = -1, -1    # a lane counts from where the last one met it; lanes that were run over don't
        for i in order.tolist():
            if start[i] >= stop[i]:
                continue
            first = start[i]
            if reach >= 0 and doc[i] == last:
                if reach >= end[i]:
                    continue
                first = reach
            total[doc[i]] += before[end[i]] - before[first] + extra[i]
            last, reach = doc[i], met[i] if end[i] < stop[i] else -1
        return total


class Parsers:
    """All languages, ``TOGETHER`` automata in memory at a time."""

    def __init__(self, models: list[tuple]):
        self.langs = [m[0] for m in models]
        self.groups = [models[i : i + TOGETHER] for i in range(0, len(models), TOGETHER)]
        self.only = Parser(models) if len(self.groups) == 1 else None

    def detect(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        norm = [normalise(t or "") for t in texts]
        parsers = [self.only] if self.only else map(Parser, self.groups)
        cost = np.concatenate([p.phrases(norm) * p.bits[:, None] for p in parsers]) if self.langs else None
        langs, scores = [], []
        for i, t in enumerate(texts):
            if cost is None or not _LETTER.search(t or ""):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            order = np.argsort(cost[:, i], kind="stable")
            langs.append(self.langs[order[0]])
            scores.append(1.0 if len(order) < 2 else float(1 - cost[order[0], i] / cost[order[1], i]))
        return langs, scores


def shared_out(texts: list[bytes], limit: int) -> bytes:
    """``limit`` bytes of all texts: as much of each, in pieces from all of it, and more of the longer ones if some are short."""
    parts, left = [b""] * len(texts), limit
    for nth, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        n, t = max(0, left // (len(texts) - nth) - 1), texts[i]
        if len(t) > n:
            k = max(1, n // PIECE_BYTES)
            size = max(0, n // k - 1)
            t = b" ".join(t[at : at + size] for at in (j * (len(t) - size) // max(1, k - 1) for j in range(k)))
        parts[i] = t
        left -= len(t) + 1
    return b"\n".join(parts)[:limit]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> list[tuple]:
    """The automata, by language in order of name.

    Learned from a bounded sample: of each label the 64 rows with the smallest
    hash, of each 4000 characters, from all of the text if it is longer, and of
    those 49,152 bytes at most, shared out among the rows, however many labels
    there are.
    """
    d = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    ranked = d.select("lang", F.xxhash64("key", "text").alias("h"))
    least = Window.partitionBy("lang").orderBy("h")
    chosen = materialize(ranked.distinct().withColumn("r", F.row_number().over(least))
                         .where(F.col("r") <= SAMPLE_ROWS).select("lang", "h"), "language-sample")
    size, piece = F.length("text"), SAMPLE_CHARS // PIECES
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substr("text", F.floor(i * (size - piece) / (PIECES - 1)).cast("int") + 1, F.lit(piece)))
    sample = (d.withColumn("h", F.xxhash64("key", "text")).join(broadcast_if_small(chosen), ["lang", "h"])
              .select("lang", "h", F.when(size <= SAMPLE_CHARS, F.col("text")).otherwise(F.array_join(pieces, "\n")).alias("text")).distinct())

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        data = shared_out([normalise(t) for t in rows.sort_values("h").text], SAMPLE_BYTES)
        a, b, c = suffix_automaton(data)
        return pd.DataFrame({"lang": [rows.lang.iloc[0]], "n": [len(data)], "src": [a.tobytes()], "byte": [b.tobytes()], "dst": [c.tobytes()]})

    return sorted(tuple(r) for r in sample.groupBy("lang").applyInPandas(build, "lang string, n long, src binary, byte binary, dst binary").collect())


def detect(docs: DataFrame, models: list[tuple], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score.

    lang_pred is the language with the fewest normalised phrases (the first by
    name of equals); score is how far the runner-up is behind: 1 - best/second
    (1 when one language alone was learned).  A text that is null or has no
    letter gets ``und`` and score 0, as does every text when no language was
    learned.  Only the text is used.  Columns of ``docs`` with those names are
    replaced.  Long texts are parsed whole; repeated rows get equal results, an
    empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def make():
        parser = Parsers(shared.value)
        return lambda texts: list(parser.detect(texts))
    return add_columns(docs.withColumn(text, F.col(text).cast("string")), text, schema, make)


def learnable(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return docs.where(~held_out(key, 4, 2) & F.col(key).isNotNull())
