"""Language-model scores by a hierarchical Pitman-Yor model.

The root restaurant serves words; every word that a token follows in training
has a context restaurant for those tokens, as has the start of a text (the end
of another), and all context restaurants share the root as parent.  The
base of the root gives half its mass to words not met in training (one outcome)
and spreads half evenly over the others.

Seating is sampled by Gibbs: in each sweep every dish of every restaurant is
seated anew given all others, by the restaurant's sequential rule, and the
result is accepted by the Metropolis-Hastings ratio of that proposal.  (The
proposal's weight is the product of its normalisers, so only table counts are
kept; the weight is that of the sweep that proposed it, and a dish of the root
whose number of customers has changed takes the new seating.)  Customers of a large dish are seated in blocks of a twentieth of those
already seated, within which the chance of a new table is held.  Predictive
probabilities are averaged over the sampled sweeps.

Distribution: texts are packed into blocks of some megabytes.  A context has as
many guests as its word has training tokens, so the sums of the words of all
blocks return to the blocks as guests.  Blocks then send their (context, word)
pairs with the context's guests by range of dishes, so a dish and its parent are
seated together; while it samples, a range estimates a restaurant's tables from
those it sees in restaurants of like size.  Customers less tables are summed by
context and return to the blocks with the answers, and the blocks score their
texts.  All of these travel as packed arrays, one row for each block and range,
and answers come in the order of the questions, so they need no keys.  A word
above ``DISH`` tokens is dealt by context over several dishes, each of which
takes the whole for its own part in proportion; the sums of the parts are seated
at the root in the end.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesearch.llm import words as W
from pagesearch.llm.frames import passes, record, texts_of
from pagesearch.session import materialize

CONTEXT_SHARE = 0.004          # of the training tokens: contexts whose tables are estimated each on its own, at most 250
DISH = 200_000                 # training tokens of a dish; a word of more is dealt over several
PART = 500_000                 # training tokens of a range of dishes, which one task seats at a time
RANGE = 4_000_000              # training tokens of a range of words, whose counts one task sums
BANDS = 128                    # half octaves of guests: contexts of one band are taken as alike
DISCOUNT, STRENGTH = (0.75, 0.8), (1.0, 10.0)      # root, contexts
BURN_IN, SAMPLES = 2, 4
BLOCK_CHARS = 6_000_000
GROWTH = 20                    # customers of a dish are seated in blocks of 1/20
END = np.uint64(0x454E44)
PLACE = 32                     # bits of a word's place in its range
_IN_RANGE = np.uint64(2**PLACE - 1)


# ---------------------------------------------------------------- seating

def seat(customers: np.ndarray, weight: np.ndarray, base: np.ndarray, discount: float,
         rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables of dishes with so many customers each, and the log weight of the
    proposal.  ``weight``: strength + discount * tables of the restaurant's
    other dishes; ``base``: the dish's probability in the parent."""
    order = np.argsort(-customers, kind="stable")
    c, a, p = customers[order], weight[order], base[order]
    tables, log_weight = np.minimum(c, 1).astype(np.int64), np.zeros(len(c))
    k, n = 1, int(np.searchsorted(-c, -1, side="left"))
    while n:
        step = max(1, k // GROWTH)
        n = int(np.searchsorted(-c[:n], -k, side="left"))     # dishes with more than k customers
        if not n:
            break
        new = (a[:n] + discount * tables[:n]) * p[:n]
        total = new + k - discount * tables[:n]
        more = np.minimum(step, c[:n] - k)
        tables[:n] += rng.random(n) * total < new if step == 1 else rng.binomial(more, np.minimum(1, new / total))
        log_weight[:n] += more * np.log(total)
        k += step
    out, w = np.empty_like(tables), np.empty_like(log_weight)
    out[order], w[order] = tables, log_weight
    return out, w


def accept(old: tuple, new: tuple, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The Metropolis-Hastings step between two independent proposals."""
    if old is None:
        return new
    take = np.log(rng.random(len(new[0]))) < new[1] - old[1]
    return np.where(take, new[0], old[0]), np.where(take, new[1], old[1])


class Totals:
    """Tables and customers of the restaurants as known while dishes are
    seated: those given, and tables per customer seen so far for the rest."""

    def __init__(self, customers: np.ndarray, known_customers: np.ndarray, known_tables: np.ndarray, words: float):
        self.customers, self.known_customers, self.known_tables = customers, known_customers, known_tables
        self.seen = np.stack([np.full(len(customers), 10.0), np.full(len(customers), 6.0)])
        self.words = max(1.0, words)

    def tables(self) -> np.ndarray:
        rest = np.maximum(0, self.customers - self.known_customers)
        return self.known_tables + rest * self.seen[1] / self.seen[0]

    def root_customers(self, t: np.ndarray) -> float:
        return self.customers[-1] - (self.customers[:-1] - t[:-1]).sum()


class Pooled(Totals):
    """The same of some of the contexts: tables per customer are those seen in
    contexts of the same band, by this task so far (``pool``; its last column is the root's)."""

    def __init__(self, guests: np.ndarray, band: np.ndarray, n: float, pool: np.ndarray, words: float):
        nobody = np.zeros(len(guests) + 1)
        super().__init__(np.append(guests, n), nobody, nobody, words)
        self.seen, self.band, self.pool = np.zeros((2, len(guests) + 1)), np.append(band, pool.shape[1] - 1), pool

    def pooled(self) -> np.ndarray:
        return self.pool + np.stack([np.bincount(self.band, x, self.pool.shape[1]) for x in self.seen])

    def tables(self) -> np.ndarray:
        seen = self.pooled()
        t = self.customers * (seen[1] / seen[0])[self.band]
        t[-1] *= seen[1, :-1].sum() / seen[0, :-1].sum()      # the root's customers are the contexts' tables
        return t

    def root_customers(self, t: np.ndarray) -> float:
        seen = self.pooled()
        return self.customers[-1] * seen[1, :-1].sum() / seen[0, :-1].sum()


def sample(dish: np.ndarray, context: np.ndarray, count: np.ndarray, n_dishes: int, totals: Totals,
           rng: np.random.Generator, scale: np.ndarray | None = None) -> dict:
    """Gibbs sweeps over whole dishes (or parts, of which the whole is ``scale`` times as large).

    Pairs (dish, context, count); context -1: customers of the root itself.
    ``totals`` has the contexts' figures and, last, those of the root.  Returns
    sums over the sampled sweeps: by pair ``pair`` (customers less discounted
    tables), by dish ``root`` (of the whole), ``guests`` and ``seats`` (its customers and
    tables at the root, of the part), by context ``tables``, ``root_tables``, ``root_customers``."""
    d0, d1 = DISCOUNT
    scale = np.ones(n_dishes) if scale is None else scale
    inner = context >= 0
    several = np.flatnonzero(inner & (count > 1))
    own = np.bincount(dish[~inner], count[~inner], n_dishes)
    single = np.bincount(dish[inner & (count == 1)], minlength=n_dishes)
    ones = np.bincount(context[inner & (count == 1)], minlength=len(totals.customers) - 1)
    seated = None
    root = None
    base = scale * (own + np.bincount(dish[inner], count[inner], n_dishes)) / max(1.0, totals.customers[-1] or 1.0)
    prior = 0.5 / totals.words
    out = {"pair": np.zeros(len(dish)), "root": np.zeros(n_dishes), "guests": np.zeros(n_dishes), "seats": np.zeros(n_dishes), "tables": np.zeros(len(ones)), "root_tables": 0.0, "root_customers": 0.0}
    before = totals.seen.copy()
    for sweep in range(BURN_IN + SAMPLES):
        t = totals.tables()
        who = several
        others = t[context[who]] - (seated[0] if seated else 1)
        seated = accept(seated, seat(count[who], STRENGTH[1] + d1 * np.maximum(0, others), base[dish[who]], d1, rng), rng)
        here = own + single + np.bincount(dish[who], seated[0], n_dishes)
        guests = np.rint(scale * here).astype(np.int64)
        weight = STRENGTH[0] + d0 * np.maximum(0, t[-1] - (root[0] if root else np.ones(n_dishes)))
        new = seat(guests, weight, np.full(n_dishes, prior), d0, rng)
        if root is not None:      # a seating of another number of guests can't stay
            new = tuple(np.where(guests == before_guests, x, y) for x, y in zip(accept(root, new, rng), new, strict=True))
        root, before_guests = new, guests
        tables = ones + np.bincount(context[who], seated[0], len(ones))
        totals.seen = before + np.stack([np.append(np.bincount(context[inner], count[inner], len(ones)), here.sum()), np.append(tables, (root[0] / scale).sum())])
        t = totals.tables()
        every = max(1.0, totals.root_customers(t))
        base = np.maximum(1e-300, (guests - d0 * root[0] + (STRENGTH[0] + d0 * t[-1]) * prior) / (STRENGTH[0] + every))
        if sweep >= BURN_IN:
            out["pair"][inner] += count[inner] - d1
            out["pair"][who] += d1 * (1.0 - seated[0])
            out["root"] += guests - d0 * root[0]
            out["guests"] += here
            out["seats"] += root[0] / scale
            out["tables"] += tables
            out["root_tables"] += (root[0] / scale).sum()
            out["root_customers"] += here.sum()
    return {k: v / SAMPLES for k, v in out.items()}


# ---------------------------------------------------------------- packed arrays

_CODEC = pa.Codec("zstd")


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers that are not negative, each in its least width, byte planes apart."""
    out = []
    for a in arrays:
        if a.dtype.kind in "iu":
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
        data = _CODEC.compress(raw, asbytes=True)
        out.append(struct.pack("<2sqq", a.dtype.str[1:].encode(), len(a), len(data)) + data)
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<2sqq", data, at)
        at += struct.calcsize("<2sqq")
        kind = np.dtype(kind.decode())
        raw = _CODEC.decompress(data[at:at + size], n * kind.itemsize, asbytes=True) if n else b""
        out.append(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n))
        at += size
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


def _sum_steps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.astype(np.uint64), dtype=np.uint64)


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many equal ranges of 64-bit hashes each one lies in (ascending with the hash)."""
    return (hashes // np.uint64((2**64 - 1) // ranges + 1)).astype(np.int64) if ranges > 1 else np.zeros(len(hashes), np.int64)


def _slices(of: np.ndarray):
    """(value, from, to) of the runs of equal values."""
    at = np.flatnonzero(np.diff(of, prepend=-1))
    yield from zip(of[at].tolist(), at.tolist(), [*at.tolist(), len(of)][1:], strict=True)


# ---------------------------------------------------------------- blocks of texts

BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("texts", T.BinaryType()),
                      T.StructField("tokens", T.LongType()), T.StructField("words", T.BinaryType())])


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end, and the number of tokens of each text."""
    hashes, sizes = [], []
    for lo, hi in passes(texts):
        w = W.split(texts[lo:hi])
        n = np.diff(w.first) + 1
        all_ = np.full(int(n.sum()), END, np.uint64)
        keep = np.ones(len(all_), bool)
        keep[np.cumsum(n) - 1] = False
        all_[keep] = W.hashes(w)
        hashes.append(all_)
        sizes.append(n)
    return (np.concatenate(hashes), np.concatenate(sizes)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue()


def _unpack(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def pack(docs: DataFrame) -> DataFrame:
    """Blocks of (id, train, text) rows, with each block's number of training
    tokens and its words with their training tokens, in order of their hash."""
    def run(batches):
        context, held, size, at = TaskContext.get().partitionId(), [], 0, 0

        def block():
            whole = pa.concat_batches(held) if len(held) > 1 else held[0]
            hashes, sizes = tokens(texts_of(whole, "text"))
            words, index = np.unique(hashes, return_inverse=True)
            counts = np.bincount(index[np.repeat(whole.column("train").to_numpy(zero_copy_only=False), sizes)], minlength=len(words))
            return record(BLOCK, [[context << 24 | at], [_pack(whole)], [int(counts.sum())], [packed(_steps(words), counts)]])
        for batch in batches:
            for lo, hi in passes(texts_of(batch, "text"), BLOCK_CHARS // 8):
                part = batch.slice(lo, hi - lo)
                held.append(part)
                size += pa.compute.sum(pa.compute.utf8_length(part.column("text"))).as_py() or 0
                if size >= BLOCK_CHARS:
                    yield block()
                    held, size, at = [], 0, at + 1
        if held:
            yield block()
    return docs.mapInArrow(run, BLOCK)


class Pairs:
    """The words of a block in order of their hash, and its distinct (context,
    word) pairs as places in them."""

    def __init__(self, batch: pa.RecordBatch):
        hashes, self.sizes = tokens(texts_of(batch, "text"))
        self.words, at = np.unique(hashes, return_inverse=True)
        n = max(1, len(self.words))
        before = np.concatenate((np.searchsorted(self.words, [END]), at[:-1])) if len(at) else at
        pair, self.index = np.unique(at * n + before, return_inverse=True)
        self.word, self.context = pair // n, pair % n
        train = np.repeat(batch.column("train").to_numpy(zero_copy_only=False), self.sizes)
        self.count = np.bincount(self.index[train], minlength=len(pair))

    def asked(self, n: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs whose word has training tokens (``n``, by word) in order of
        their range of dishes, word, dish and context; their ranges; and which
        of its word's dishes each belongs to.  A word of more than ``DISH``
        tokens is dealt by context over several dishes."""
        i = np.flatnonzero(n[self.word] > 0)
        word, context = self.word[i], self.context[i]
        dish, nth, of = self.words[word], np.zeros(len(i), np.int64), n[word]
        h = np.flatnonzero(of > DISH)
        nth[h] = W.mix(self.words[context[h]]) % (-(-of[h] // DISH)).astype(np.uint64)
        dish[h] = W.mix(dish[h] ^ W.mix(nth[h].astype(np.uint64) + END))
        part = _range_of(dish, ranges)
        order = np.lexsort((context, nth, word, part))
        return i[order], part[order], nth[order]


# ---------------------------------------------------------------- exchanges

# Packed rows that blocks and ranges of hashes send each other.  block below 0: for no block, see there.
SENT = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("part", T.LongType()),
                     T.StructField("data", T.BinaryType()), T.StructField("tables", T.DoubleType()), T.StructField("customers", T.DoubleType()),
                     T.StructField("words", T.LongType())])
WORDS, COUNTS, ASKED, ANSWER, TABLES, SPLIT, RESTAURANTS, TOTAL = range(8)


def _sent(rows: list[tuple]) -> pa.Table:
    """Rows (block, kind, part, data, tables, customers, words)."""
    return pa.Table.from_batches([record(SENT, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(SENT))])


def _rows(table: pa.Table, kind: int | None = None) -> list[dict]:
    """Rows in an order that doesn't hang on the shuffle."""
    if kind is not None:
        table = table.filter(pa.compute.equal(table.column("kind"), kind))
    return sorted(table.select(["block", "part", "data"]).to_pylist(), key=lambda r: (r["part"], r["block"]))


def _word_slices(blocks: DataFrame, ranges: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
                steps, counts = unpacked(data.as_py())
                words = _sum_steps(steps)
                rows = [(block, WORDS, r, packed(_steps(words[lo:hi]), counts[lo:hi]), 0.0, 0.0, 0) for r, lo, hi in _slices(_range_of(words, ranges))]
                yield from _sent(rows).to_batches()
    return blocks.select("block", "words").mapInArrow(run, SENT)


def _words_of(table: pa.Table) -> tuple[list[int], np.ndarray, list[np.ndarray], np.ndarray]:
    """A range's blocks, its distinct words, each block's places in them, and the words' training tokens."""
    rows = _rows(table)
    mine = [unpacked(r["data"]) for r in rows]
    hashes = [_sum_steps(steps) for steps, _ in mine]
    words = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    at, n = [np.searchsorted(words, h) for h in hashes], np.zeros(len(words), np.int64)
    for places, (_, counts) in zip(at, mine, strict=True):
        n[places] += counts.astype(np.int64)
    return [r["block"] for r in rows], words, at, n


def _count(slices: DataFrame) -> DataFrame:
    """Places of each block's words in their range and their training tokens
    (COUNTS), and the number of distinct training words (TOTAL)."""
    def run(table: pa.Table) -> pa.Table:
        blocks, _, at, n = _words_of(table)
        part = table.column("part")[0].as_py()
        return _sent([*((b, COUNTS, part, packed(_steps(a), n[a]), 0.0, 0.0, 0) for b, a in zip(blocks, at, strict=True)), (-1, TOTAL, part, b"", 0.0, 0.0, int((n > 0).sum()))])
    return slices.groupBy("part").applyInArrow(run, SENT)


def _numbers(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (range and place, ascending with the hash) and training tokens of a block's words."""
    got = [unpacked(r["data"]) for r in rows]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return (np.concatenate([_sum_steps(x[0]) + np.uint64(r["part"] << PLACE) for r, x in zip(rows, got, strict=True)]),
            np.concatenate([x[1] for x in got]).astype(np.int64))


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _ask(blocks: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    """The pairs of each block whose word is known, with the guests of the context, packed by range of dishes."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block, data in zip(left.column("block").to_pylist(), left.column("texts"), strict=True):
            p, (number, n) = Pairs(_unpack(data.as_py())), _numbers(_rows(right))
            i, of, nth = p.asked(n, parts)
            for part, lo, hi in _slices(of):
                pair, k = i[lo:hi], nth[lo:hi]
                word = p.word[pair]
                first = _begins(word, k)
                context, local = np.unique(p.context[pair], return_inverse=True)
                out.append((block, ASKED, part, packed(_steps(number[word[first]]), k[first], n[word[first]], np.diff(np.append(first, hi - lo)),
                                                       _steps(number[context]), n[context], local, p.count[pair]), 0.0, 0.0, 0))
        return _sent(out)
    return blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, SENT)


def _seat(asked: DataFrame, n: float, v: int) -> DataFrame:
    """Seats each range of dishes: ANSWER to the blocks, TABLES by range of
    contexts (customers less tables, where there are any, times ``SAMPLES``),
    SPLIT words' root customers, and RESTAURANTS, sums at the root over the words in one dish."""
    def run(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        part, out = rows[0]["part"], []
        got = [unpacked(r["data"]) for r in rows]
        numbers, contexts = [_sum_steps(x[0]) for x in got], [_sum_steps(x[4]) for x in got]
        words = np.unique(np.concatenate(numbers))
        keys = [np.searchsorted(words, w) << 32 | x[1].astype(np.int64) for w, x in zip(numbers, got, strict=True)]      # a word's dishes beside each other
        dishes, at = np.unique(np.concatenate(keys), return_index=True)
        word, whole = words[dishes >> 32], np.concatenate([x[2] for x in got])[at].astype(np.int64)
        context, at = np.unique(np.concatenate(contexts), return_index=True)
        guests = np.concatenate([x[5] for x in got])[at].astype(float)
        places = [np.repeat(np.searchsorted(dishes, k), x[3]) for k, x in zip(keys, got, strict=True)]
        code = [d * len(context) + np.searchsorted(context, c)[x[6]] for d, c, x in zip(places, contexts, got, strict=True)]
        pairs, pair = np.unique(np.concatenate(code), return_inverse=True)
        total = np.bincount(pair, np.concatenate([x[7] for x in got]), len(pairs)).astype(np.int64)
        met = np.flatnonzero(total)                # pairs with customers
        known, dish = np.unique(pairs[met] // len(context), return_inverse=True)
        used, local = np.unique(pairs[met] % len(context), return_inverse=True)
        g = guests[used]
        alone = g >= CONTEXT_SHARE * n
        band = np.minimum(BANDS - 1, 2 * np.log2(np.maximum(1, g))).astype(np.int64)
        band[alone] = BANDS + np.arange(int(alone.sum()))
        pool = np.stack([np.full(BANDS + int(alone.sum()) + 1, 10.0), np.full(BANDS + int(alone.sum()) + 1, 6.0)])
        pool[1, 0] = 10.0                          # one guest, one table
        mine = np.bincount(dish, total[met], len(known))
        split = whole[known] > DISH
        scale = np.where(split, whole[known] / np.maximum(1, mine), 1.0)
        s = sample(dish, local, total[met], len(known), Pooled(g, band, n, pool, v), np.random.default_rng([1, part]), scale)
        seats, at_root, tables = np.zeros(len(pairs), np.int64), np.zeros(len(dishes), np.int64), np.zeros(len(dishes), np.int64)
        seats[met] = np.rint(SAMPLES * (total[met] - s["pair"]) / DISCOUNT[1])
        alone = known[~split]                      # the root answers for split words
        at_root[alone], tables[alone] = np.rint(SAMPLES * s["guests"][~split]), np.rint(SAMPLES * s["seats"][~split])
        at = 0
        for r, d in zip(rows, places, strict=True):
            mine_ = slice(at, at + len(d))
            first = _begins(d)
            out.append((r["block"], ANSWER, part, packed(total[pair[mine_]], seats[pair[mine_]], at_root[d[first]], tables[d[first]], np.diff(np.append(first, len(d)))), 0.0, 0.0, 0))
            at += len(d)
        spare = SAMPLES * np.bincount(local, total[met], len(used)).astype(np.int64) - np.rint(SAMPLES * s["tables"]).astype(np.int64)
        some = np.flatnonzero(spare)
        c, spare = context[used[some]], spare[some]
        out += [(-1, TABLES, r, packed(c[lo:hi] & _IN_RANGE, spare[lo:hi]), 0.0, 0.0, 0) for r, lo, hi in _slices((c >> np.uint64(PLACE)).astype(np.int64))]
        w, at = np.unique(word[known[split]], return_inverse=True)
        by_word = np.bincount(at, s["guests"][split], len(w))
        out += [(-1, SPLIT, r, packed(w[lo:hi] & _IN_RANGE, by_word[lo:hi]), 0.0, float(by_word[lo:hi].sum()), 0) for r, lo, hi in _slices((w >> np.uint64(PLACE)).astype(np.int64))]
        out.append((-1, RESTAURANTS, part, b"", float(s["seats"][~split].sum()), float(s["guests"][~split].sum()), 0))
        return _sent(out)
    return asked.groupBy("part").applyInArrow(run, SENT)


def seat_split(guests: np.ndarray, tables: float, others: float, v: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Customers less discounted tables, and tables, at the root of words that
    were seated in parts, given the other words' ``tables``; ``others`` is the
    number of customers of split words seated elsewhere."""
    c, d = np.rint(guests).astype(np.int64), DISCOUNT[0]
    state, kept = None, []
    for _ in range(BURN_IN + SAMPLES):
        seated = state[0] if state else np.minimum(c, 1)
        here = seated.sum()
        weight = STRENGTH[0] + d * (tables + here - seated + others * here / max(1, c.sum()))
        state = accept(state, seat(c, weight, np.full(len(c), 0.5 / max(1, v)), d, rng), rng)
        kept.append(state[0])
    t = np.mean(kept[BURN_IN:], axis=0)
    return guests - d * t, t


def _return(counts: DataFrame, answers: DataFrame, tables: float, customers: float, v: int) -> DataFrame:
    """For each block's words the tables of their contexts and, of split words, the customers at the root (TABLES);
    the sums of split words at the root (TOTAL)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _sent([])
        rows, part = _rows(left), left.column("part")[0].as_py()
        got = [unpacked(r["data"]) for r in rows]
        at = [_sum_steps(x[0]).astype(np.int64) for x in got]
        t = np.zeros(1 + max(int(a[-1]) for a in at), np.int64)
        for a, x in zip(at, got, strict=True):
            t[a] = SAMPLES * x[1].astype(np.int64)
        guests = np.zeros(len(t))
        for r in _rows(right, TABLES):
            place, spare = unpacked(r["data"])
            t[place] -= spare.astype(np.int64)
        for r in _rows(right, SPLIT):
            place, c = unpacked(r["data"])
            guests[place] += c
        h, root, seats = np.flatnonzero(guests), np.zeros(len(t)), np.zeros(0)
        if len(h):
            root[h], seats = seat_split(guests[h], tables, customers - guests.sum(), v, np.random.default_rng([2, part]))
        return _sent([*((r["block"], TABLES, part, packed(t[a], root[a]), 0.0, 0.0, 0) for r, a in zip(rows, at, strict=True)),
                      (-1, TOTAL, part, b"", float(seats.sum()), float(guests.sum()), 0)])
    return counts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, SENT)


# ---------------------------------------------------------------- model

def scored(docs: DataFrame, train, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, base_score, score: one row
    per row of ``docs``; ``train`` is a condition on its columns.

    Tokens are the words (split at ASCII white space, A-Z lower-cased) and one
    end.  base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) over them, c, N
    and V being counts over all training rows; score sums the model's log10
    probabilities.  A null or empty text is its end alone.  A null condition
    counts as false.  Without training rows the model is the base of the root
    alone (the unknown outcome).  Repeated rows count each.  Extra columns are
    not read; an empty table gives no rows.  Seeds hang on ranges of word
    hashes, whose number hangs on the training tokens, so the scores don't hang
    on the layout of the table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    blocks = materialize(pack(rows), "text-blocks")
    figures = blocks.agg(F.sum("tokens").alias("n"), F.count("*").alias("blocks")).first()
    n = figures["n"] or 0
    ranges, parts = 1 + n // RANGE, 1 + n // PART
    tasks = max(2 * spark.sparkContext.defaultParallelism, figures["blocks"] // 8)
    texts = blocks.select("block", "texts").repartition(tasks, "block")
    slices = _word_slices(blocks, ranges).repartition(tasks, "part")

    counts = materialize(_count(slices), "word-counts")
    v = counts.where(F.col("kind") == TOTAL).agg(F.sum("words")).first()[0] or 0
    of_blocks = counts.where(F.col("kind") == COUNTS)
    asked = _ask(texts, of_blocks.repartition(tasks, "block"), parts).repartition(max(tasks, parts // 4), "part")
    answers = materialize(_seat(asked, float(n), v), "answers")
    sums = {r["kind"]: r for r in answers.where(F.col("kind").isin(SPLIT, RESTAURANTS)).groupBy("kind").agg(F.sum("tables").alias("tables"), F.sum("customers").alias("customers")).collect()}
    at_root = lambda kind, c: sums[kind][c] if kind in sums else 0.0
    back = materialize(_return(of_blocks.repartition(tasks, "part"), answers.where(F.col("kind").isin(TABLES, SPLIT)).repartition(tasks, "part"),
                               at_root(RESTAURANTS, "tables"), at_root(SPLIT, "customers"), v), "tables")
    split_tables = back.where(F.col("kind") == TOTAL).agg(F.sum("tables")).first()[0] or 0.0
    model = {"n": float(n), "v": v, "root_customers": at_root(RESTAURANTS, "customers") + at_root(SPLIT, "customers"),
             "root_tables": at_root(RESTAURANTS, "tables") + split_tables}
    schema = T.StructType([T.StructField(key, rows.schema["id"].dataType), T.StructField("train", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for data in left.column("texts"):
            batch = _unpack(data.as_py())
            p, (_, n) = Pairs(batch), _numbers(_rows(right, COUNTS))
            got = [unpacked(r["data"]) for r in _rows(right, TABLES)]
            tables = np.concatenate([x[0] for x in got]) / SAMPLES if got else np.zeros(len(p.words))
            split_root = np.concatenate([x[1] for x in got]) if got else np.zeros(len(p.words))
            pair, root = np.zeros(len(p.word)), np.zeros(len(p.word))
            i, _, _ = p.asked(n, parts)
            got = [unpacked(r["data"]) for r in _rows(right, ANSWER)]
            if got:
                pair[i] = np.concatenate([x[0] - DISCOUNT[1] / SAMPLES * x[1] for x in got])
                root[i] = np.concatenate([np.repeat((x[2] - DISCOUNT[0] * x[3]) / SAMPLES, x[4]) for x in got])
            del got, i
            c = n[p.word]
            root = np.where(c > DISH, split_root[p.word], root)
            context = np.where(n[p.context] > 0, p.context, -1)
            base = np.log10((c + 0.5) / (model["n"] + 0.5 * (model["v"] + 1)))
            prob = np.log10(probabilities(model | {"contexts": p.words, "guests": n, "tables": tables}, c > 0, root, context, pair))
            first = np.cumsum(p.sizes) - p.sizes

            def per_text(x):
                return np.add.reduceat(x[p.index], first) if len(first) else np.zeros(0)
            out.append(record(schema, [batch.column("id"), batch.column("train"), p.sizes, per_text((c > 0).astype(np.int64)), np.full(len(first), int(model["n"])), per_text(base), per_text(prob)]))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([record(schema, [[]] * len(schema))])

    replies = of_blocks.unionByName(answers.where(F.col("kind") == ANSWER)).unionByName(back.where(F.col("kind") == TABLES))
    return texts.groupBy("block").cogroup(replies.repartition(tasks, "block").groupBy("block")).applyInArrow(score, schema)


def probabilities(m: dict, known: np.ndarray, root: np.ndarray, context: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Predictive probabilities of words: their part of the root's customers,
    their context (-1: none) and their part of its customers."""
    base = np.where(known, 0.5 / max(1, m["v"]), 0.5 if m["v"] else 1.0)
    up = (root + (STRENGTH[0] + DISCOUNT[0] * m["root_tables"]) * base) / (STRENGTH[0] + m["root_customers"])
    if not len(m["contexts"]):
        return up
    at = np.maximum(context, 0)
    inner = (pair + (STRENGTH[1] + DISCOUNT[1] * m["tables"][at]) * up) / (STRENGTH[1] + m["guests"][at])
    return np.where(context >= 0, inner, up)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity by ``train``, per token, of the model and of the base."""
    return scores.groupBy("train").agg(*(F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens")).alias(n) for c, n in (("score", "perplexity"), ("base_score", "base_perplexity"))))
