"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a document that has as many words as a benchmark item gets a
SimHash of its five-word shingles.  Fingerprints are looked up in multi-index
Hamming blocks: eight blocks of eight bits, each compared within two bits,
which by the pigeonhole principle misses no fingerprint within 23 bits.
Candidates are then verified by the exact weighted-shingle similarity (sum of
the smaller over sum of the larger multiplicities).

To reach the similarity, most shingles of a window must be shingles of some
item, so windows with too few of them are left out before fingerprinting; that
bound is exact.  The benchmark is taken in blocks of a bounded number of words,
each broadcast and held against all documents.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesearch.llm import words as W
from pagesearch.llm.frames import add_columns, passes, quoted, record, texts_of, unused
from pagesearch.session import materialize

WIDTH, SIMILARITY = 5, 0.8
BLOCK_WORDS = 1_000_000     # words of benchmark items broadcast at once
BLOCKS, BLOCK_RADIUS = 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
_TABLE_BITS = 20
_BYTE_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


def _votes(h: np.ndarray) -> np.ndarray:
    """Running counts of the set bits: row i holds those of the first i hashes."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))


def _pack(votes: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * votes > n, axis=-1, bitorder="little")


class Items:
    """A block of benchmark items, indexed by size."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.similarity = similarity
        self.by_size: dict[int, dict] = {}
        known: dict[int, list[np.ndarray]] = {}
        for item_id, text in sorted(items):
            w = W.split([text])
            n = len(w.start)
            if not n:
                continue
            k = min(WIDTH, n)
            h, _ = W.shingle_hashes(w, W.hashes(w), k)
            value, count = np.unique(h, return_counts=True)
            g = self.by_size.setdefault(n, {"width": k, "ids": [], "prints": [], "values": [], "counts": []})
            g["ids"].append(item_id)
            g["prints"].append(_pack(_votes(h)[-1], len(h)))
            g["values"].append(value)
            g["counts"].append(count)
            known.setdefault(k, []).append(value)
        self.known = {k: np.unique(np.concatenate(v)) for k, v in known.items()}
        self.table = {}
        for k, v in self.known.items():
            self.table[k] = np.zeros(1 << _TABLE_BITS, bool)
            self.table[k][(v >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        for g in self.by_size.values():
            g["prints"] = np.stack(g["prints"])
            # near[b][value]: the items whose block b is within the block radius of value
            g["near"] = np.stack([(_BYTE_DISTANCE[:, g["prints"][:, b]] <= BLOCK_RADIUS) for b in range(BLOCKS)])
        self.least = {k: min(self._need(n, n) for n, g in self.by_size.items() if g["width"] == k) for k in self.known}

    def _need(self, window: int, item: int) -> int:
        """Shared shingles that a window and an item of these word counts must have."""
        both = window + item - 2 * (min(WIDTH, item) - 1)
        return max(1, math.ceil(self.similarity * both / (1 + self.similarity) - 1e-9))

    def find(self, texts: list[str]) -> list[tuple[int, int, float, int, int]]:
        """(text, item_id, similarity, start, words): of each text and item the
        most similar window, the first of equals."""
        w = W.split(texts)
        of = W.hashes(w)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for k, known in self.known.items():
            h, whole = W.shingle_hashes(w, of, k)
            hit = self.table[k][(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
            at = np.flatnonzero(hit)
            hit[at] = whole[at] & (known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at])
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            doc, n_hits = np.unique(np.searchsorted(w.first, at, side="right") - 1, return_counts=True)
            for d, hits in zip(doc.tolist(), n_hits.tolist(), strict=True):
                lo, n = int(w.first[d]), int(w.first[d + 1] - w.first[d])
                sums = np.concatenate(([0], np.cumsum(hit[lo : lo + n - k + 1])))
                for size, g in self.by_size.items():
                    if g["width"] == k:
                        self._windows(best, d, h[lo : lo + n - k + 1], sums, min(size, n), size, g, hits)
        return [(d, i, s, at, n) for (d, i), (s, at, n) in sorted(best.items())]

    def _windows(self, best, d, h, sums, n, size, g, hits) -> None:
        m, need = n - g["width"] + 1, self._need(n, size)
        if hits < need:
            return
        start = np.flatnonzero(sums[m:] - sums[: len(sums) - m] >= need)
        if not len(start):
            return
        lo = int(start[0])
        votes = _votes(h[lo : int(start[-1]) + m])
        prints = _pack(votes[start - lo + m] - votes[start - lo], m)
        near = np.zeros((len(start), len(g["ids"])), bool)
        for b in range(BLOCKS):
            near |= g["near"][b][prints[:, b]]
        for r, c in zip(*np.nonzero(near), strict=True):
            if int(np.bitwise_count(prints[r] ^ g["prints"][c]).sum()) > RADIUS:
                continue
            s = int(start[r])
            value, count = np.unique(h[s : s + m], return_counts=True)
            _, a, b = np.intersect1d(value, g["values"][c], assume_unique=True, return_indices=True)
            shared = int(np.minimum(count[a], g["counts"][c][b]).sum())
            similarity = shared / (m + int(g["counts"][c].sum()) - shared)
            if similarity >= self.similarity:
                key, now = (d, g["ids"][c]), best.get((d, g["ids"][c]))
                if now is None or (similarity, -s) > (now[0], -now[1]):
                    best[key] = (similarity, s, n)


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text", limit: int = BLOCK_WORDS) -> list:
    """Broadcasts of the items, dealt by hash into blocks of about ``limit``
    words.  One block at a time is fetched and sent; the driver keeps none."""
    sc = items.sparkSession.sparkContext
    i = materialize(items.select(F.col(key).alias("item_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL").distinct(), "items")
    total = i.agg(F.sum(F.size(F.split("text", "[ \\t-\\r]+")))).first()[0] or 0
    n = max(1, math.ceil(total / limit))
    return [sc.broadcast([(r.item_id, r.text) for r in i.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]) for b in range(n)] if total else []


class Blocks:
    """The items of all blocks for one task, with one block's index in memory."""

    def __init__(self, shared: list):
        self.shared, self.only = shared, Items(shared[0].value) if len(shared) == 1 else None

    def find(self, texts: list[str]) -> list[tuple]:
        if self.only:
            return self.only.find(texts)
        return [x for s in self.shared for x in Items(s.value).find(texts)]


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, similarity, start_word, n_words): for every row of
    ``docs`` and every item with a window at least 0.8 similar, the most similar
    window (the first of equals).

    Words are split at ASCII white space with A-Z lower-cased; a window has the
    item's number of words, or the whole document if that is shorter.  An item
    of fewer than five words is one shingle; one without words, or with a null
    id or text, matches nothing.  Null and empty texts match nothing.  Repeated
    documents give repeated rows; items repeated under one id give one.  Empty
    tables give no rows.  Other columns are not read.
    """
    d = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("item_id", items.schema["item_id"].dataType),
                           T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType()),
                           T.StructField("n_words", T.LongType())])
    shared = item_blocks(items)
    if not shared:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("doc_id", key)

    def run(batches):
        index = Blocks(shared)
        for batch in batches:
            texts, ids = texts_of(batch, "text"), batch.column("doc_id")
            for lo, hi in passes(texts):
                if found := index.find(texts[lo:hi]):
                    of, *rest = zip(*found, strict=True)
                    yield record(schema, [ids.take([lo + x for x in of]), *rest])
    return d.mapInArrow(run, schema).withColumnRenamed("doc_id", key)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; nothing is shuffled.
    Null and empty texts stay; columns of any name stay as they are."""
    names, name = docs.columns, unused(docs, "contaminated")
    shared = item_blocks(items)
    if not shared:
        return docs

    def make():
        index = Blocks(shared)

        def step(texts):
            found = {x[0] for x in index.find([t or "" for t in texts])}
            return [[i in found for i in range(len(texts))]]
        return step
    marked = add_columns(docs, text, T.StructType([T.StructField(name, T.BooleanType())]), make)
    return marked.where(~F.col(name)).select(*map(quoted, names))
