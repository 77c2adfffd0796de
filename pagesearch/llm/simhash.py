"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are cut into three blocks of 22, 21 and 21 bits, each
padded with zeros to 23: the length of the perfect binary Golay code, whose
4096 words cover all 23-bit vectors within radius 3.  The anchors are the
products of three code words.  A fingerprint's home is its nearest anchor (at
most 3 bits away in every block).  If two fingerprints differ in at most t
bits, e1 + e2 + e3 <= t of them in the blocks, then each lies within 3 + e_i
bits of the other's home in block i.  So every fingerprint is replicated to
all anchors within covering radius plus threshold (with that split of the
threshold over the blocks) and compared there with the fingerprints at home.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations, product, repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesearch.llm import cells
from pagesearch.llm.components import components
from pagesearch.llm.frames import add_columns, record, unused
from pagesearch.session import materialize

SEED = 42
GOLAY = 0b110001110101   # generator polynomial of the [23, 12] code
LENGTH, CHECK, RADIUS = 23, 11, 3
WIDTHS = (22, 21, 21)
PART_HOMES = 8192
_SUMMED = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the ``width``-word shingles of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(width, len(words))
    start = np.concatenate(([0], end[: len(words) - k] + 1)).tolist()
    spans = map(line.__getitem__, map(slice, start, end[k - 1 :].tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(SEED)), np.uint64, len(start))
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), _SUMMED):
        part = h[lo : lo + _SUMMED].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with ``fingerprint`` (the 64 bits as a signed long)."""
    schema = T.StructType([T.StructField("fingerprint", T.LongType())])

    def make():
        return lambda texts: [np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)]
    return add_columns(docs, text, schema, make)


@cache
def _syndromes() -> np.ndarray:
    """Remainder of every one-byte part of a 23-bit vector: three tables of 256."""
    def rest(v: int) -> int:
        for i in range(LENGTH + 1, CHECK - 1, -1):
            if v >> i & 1:
                v ^= GOLAY << (i - CHECK)
        return v
    return np.array([[rest(b << s) for b in range(256)] for s in (0, 8, 16)], np.int64)


def _syndrome(v: np.ndarray) -> np.ndarray:
    t = _syndromes()
    return t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16]


@cache
def _patterns(excess: int) -> np.ndarray:
    """By syndrome: the error patterns of weight 3 + ``excess`` (at most 3 for
    0) that lead to a code word, padded with -1."""
    weights = range(RADIUS + 1) if excess == 0 else [RADIUS + excess]
    e = np.array([sum(1 << i for i in at) for w in weights for at in combinations(range(LENGTH), w)], np.int64)
    s = _syndrome(e)
    order = np.argsort(s, kind="stable")
    e, s = e[order], s[order]
    rank = np.arange(len(s)) - np.searchsorted(s, s)
    out = np.full((1 << CHECK, rank.max() + 1), -1, np.int64)
    out[s, rank] = e
    return out


def _blocks(fp: np.ndarray) -> list[np.ndarray]:
    out, shift = [], 0
    for w in WIDTHS:
        out.append((fp >> np.uint64(shift) & np.uint64((1 << w) - 1)).astype(np.int64))
        shift += w
    return out


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all anchors that a row's fingerprint is replicated to.
    An anchor is named by the 12 high bits of its three code words."""
    blocks = _blocks(fp)
    syndromes = [_syndrome(b) for b in blocks]
    rows, names = [], []
    for split in product(range(threshold + 1), repeat=len(WIDTHS)):
        if sum(split) > threshold:
            continue
        name, ok = np.zeros((len(fp), 1), np.int64), np.ones((len(fp), 1), bool)
        for block, syndrome, excess in zip(blocks, syndromes, split, strict=True):
            e = _patterns(excess)[syndrome]
            word = (block[:, None] ^ e) >> CHECK
            name = ((name[:, :, None] << (LENGTH - CHECK)) | word[:, None, :]).reshape(len(fp), -1)
            ok = (ok[:, :, None] & (e >= 0)[:, None, :]).reshape(len(fp), -1)
        r, c = np.nonzero(ok)
        rows.append(r)
        names.append(name[r, c])
    return np.concatenate(rows), np.concatenate(names)


def _placed(threshold: int):
    schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("id", T.LongType())])

    def run(batches):
        for batch in batches:
            fp = batch.column("fingerprint").to_numpy(zero_copy_only=False)
            for lo in range(0, len(fp), 2048):
                part = fp[lo : lo + 2048]
                if len(part):
                    row, name = anchors(part.view(np.uint64), threshold)
                    yield record(schema, [name, part[row]])
    return run, schema


def _payload(batch) -> np.ndarray:
    return batch.column("id").to_numpy(zero_copy_only=False).view(np.uint64)


def _within(bits: int):
    return lambda h, v: np.bitwise_count(v[:, None] ^ h[None, :]) <= bits


def near_groups(docs: DataFrame, width: int = 3, bits: int = 2, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, fingerprint, component_id.

    Two documents are linked when their fingerprints differ in at most
    ``bits`` bits; component_id is the smallest key that can be reached over
    links, the document itself included.  Texts without words have fingerprint
    zero and are linked like any other.  A null text counts as empty; a null
    key is passed over when the smallest is taken (a group of null keys alone
    gets null).  Repeated rows are linked like copies.  Extra columns are not
    read.  An empty table gives no rows.

    Copies are reduced to one row per fingerprint before anything is
    replicated, so a group of copies of any size costs one replica set.
    """
    marked = materialize(with_fingerprints(docs.select(key, text), text, width).select(key, "fingerprint"), "fingerprints")
    distinct = marked.groupBy("fingerprint").agg(F.min(key).alias("least"))
    place, schema = _placed(0)
    visit, _ = _placed(bits)
    # a few rows become many replicas: a fixed count keeps the tasks that make them apart
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = distinct.select("fingerprint").repartition(tasks, "fingerprint")
    rows = cells.spread(fps.mapInArrow(place, schema), fps.mapInArrow(visit, schema), ["cell"], PART_HOMES)
    links = materialize(cells.scan(rows, ["cell"], _payload, _within(bits)).select("a", "b"), "simhash-links")
    roots = components(links).withColumnRenamed("node", "fingerprint")
    classes = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    known = classes.join(least, "root").select("fingerprint", "component_id")
    return marked.join(known, "fingerprint").select(key, "fingerprint", "component_id")


def keep_one(docs: DataFrame, width: int = 3, bits: int = 2) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group.  Rows
    repeated under that doc_id are one document and stay together; rows with a
    null doc_id stay only if their whole group has none.  An empty table gives
    an empty one; columns of any other name stay as they are."""
    groups = near_groups(docs, width, bits)
    name = unused(docs, "kept")
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
