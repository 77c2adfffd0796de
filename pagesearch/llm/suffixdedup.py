"""Repeated byte strings by threshold-bounded interval expansion on a BWT.

Every string of ``length`` bytes (a window) that starts at two places at least
is found, and the bytes that such windows cover are its spans.  Texts are dealt
to independent indexes by content, so that equal windows always meet:

1. The anchor of a window is its leftmost least ``GRAM``-byte gram by hash,
   which only the window's own bytes decide.  Successive windows with the same
   anchor form a *context*: the bytes that these windows cover.
2. Contexts whose anchor occurs once have no partner and go.  Of equal contexts
   two go on and stand for all (a pre-aggregation: a group of copies costs two).
3. The contexts of an anchor come to one task, which packs anchors into blocks,
   builds a Burrows-Wheeler transform of each block and expands intervals
   breadth first: from those of the few symbols that the first sort reads, each
   interval of a string w is extended backward to those of cw, and a right
   border that no shorter string has set has the common prefix |w|.  Values
   come by increasing length, and expansion stops at ``length``: borders never
   set lie between suffixes that share a window.
4. An anchor with more than ``part`` contexts (a frequent passage in many
   different surroundings) is dealt anew by longer grams, which split its
   windows and its contexts; grams as long as the window leave equal windows
   only, so this ends, and nothing is capped.

Joins on a key deal the rows of a frequent one over several tasks (``dealt``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesearch.llm.frames import ensure_text, passes, record
from pagesearch.llm.words import mix
from pagesearch.session import materialize

LENGTH = 400
GRAM = 100          # bytes of the first anchors; at most the window's length
PART = 1024         # contexts of one anchor in one block
BLOCK = 1 << 20     # bytes of the largest block: positions take 20 bits of a sort key
SMALL = 1 << 16     # bytes of a block of several anchors: three ranks and a position fit a sort key
HOT = 4096          # rows of one key that a join leaves together
_SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

ANCHOR = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "ctx", "t1", "t2", "lo", "n")])
CONTEXT = T.StructType([T.StructField("key", T.LongType()), T.StructField("ctx", T.LongType()), T.StructField("data", T.BinaryType())])
RUNS = T.ArrayType(T.StructType([T.StructField("off", T.LongType()), T.StructField("n", T.LongType())]))
FOUND = T.StructType([T.StructField("key", T.LongType()), T.StructField("ctx", T.LongType()), T.StructField("runs", RUNS)])
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if 0 not in _tables or len(_tables[0][0]) < n:
        size = max(n, _SLICE + 4096)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _tables[0] = np.cumprod(up), np.cumprod(down)
    return _tables[0]


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Contexts of the texts that lie one after the other in ``data`` (text i
    ends before ``ends[i]``): key of the anchor, hash of the context's bytes,
    first window and number of windows.  Slices of a megabyte bound the memory;
    at a slice's end a context may be cut in two."""
    parts = []
    for at in range(0, max(0, len(data) - length + 1), _SLICE):
        piece = data[at : at + _SLICE + length - 1]
        n, windows = len(piece), len(piece) - length + 1
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        of = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
        bits = np.uint64(21)  # of a position in a slice
        least = (mix(of) >> bits << bits) | np.arange(len(of), dtype=np.uint64)
        span, width = 1, length - gram + 1
        while span < width:
            step = min(span, width - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        place = (least[:windows] & np.uint64((1 << 21) - 1)).astype(np.int64)
        last = ends[np.searchsorted(ends, np.arange(at, at + windows), side="right")]
        whole = np.arange(at, at + windows) + length <= last
        first = whole.copy()
        first[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
        lo = np.flatnonzero(first)
        if not len(lo):
            continue
        count = np.add.reduceat(whole.astype(np.int64), lo)  # windows that cross a text's end follow a context at most
        hi = lo + count + length - 1
        ctx = mix((sums[hi] - sums[lo]) * down[lo] + count.astype(np.uint64))
        parts.append((of[place[lo]].view(np.int64), ctx.view(np.int64), lo + at, count))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def block_index(contexts: list[bytes], depth: int) -> tuple:
    """BWT of the joined contexts (symbol 0 after each): number of symbols that
    the first sort read and where suffixes differ in them, the suffix order,
    the row of the suffix one symbol longer, the BWT and the first symbols.
    Suffixes are ordered by ``depth`` symbols at least; ties beyond don't
    matter, as only intervals of strings of at most ``depth`` are read off."""
    joined = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.uint64) + np.uint64(1)
    joined[np.cumsum([len(c) + 1 for c in contexts]) - 1] = 0
    alphabet, symbols = np.unique(joined, return_inverse=True)
    symbols = symbols.astype(np.uint64)
    n, bits = len(symbols), np.uint64(max(1, int(len(alphabet) - 1).bit_length()))
    low = np.uint64(max(1, (n - 1).bit_length()))
    step = 64 // int(low) - 1          # ranks that fit a key beside the position
    if step < 2:
        raise ValueError("a block has at most 2**20 bytes")
    have = read = min((64 - int(low)) // int(bits), depth)
    key = np.zeros(n, np.uint64)
    for k in range(have):
        key <<= bits
        key[: max(0, n - k)] |= symbols[k:]
    index = np.arange(n, dtype=np.uint64)
    mask = np.uint64((1 << int(low)) - 1)
    rank, differ = np.zeros(n, np.uint64), None
    while True:
        packed = np.sort((key << low) | index)
        order, value = (packed & mask).astype(np.int64), packed >> low
        new = np.concatenate(([False], value[1:] != value[:-1]))
        rank[order] = np.cumsum(new, dtype=np.uint64)
        differ = value if differ is None else differ
        if have >= depth or int(rank[order[-1]]) == n - 1:
            break
        key = rank.copy()
        for k in range(1, step):
            key <<= low
            key[: max(0, n - k * have)] |= rank[k * have :]
        have *= step
    before = np.concatenate(([n - 1], np.arange(n - 1)))
    return read, int(bits), differ, order, rank.astype(np.int64), before, symbols


def shared(blocks: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """For each context of each block the window starts whose window occurs
    elsewhere in the block.  The blocks' indexes are expanded side by side."""
    parts, offset = [], 0
    made = [block_index(b, length) for b in blocks]
    start = min(m[0] for m in made)
    for (read, bits, value, order, rank, before, symbols), contexts in zip(made, blocks, strict=True):
        n = len(order)
        inverse = rank
        if rank[order[-1]] < n - 1:    # equal beyond the depth: by position
            inverse = np.empty(n, np.int64)
            inverse[order] = np.arange(n)
        value = value >> np.uint64(bits * (read - start))
        sizes = np.array([len(c) + 1 for c in contexts])
        left = np.repeat(np.cumsum(sizes) - 1, sizes) - np.arange(n)
        parts.append((np.concatenate(([True], value[1:] != value[:-1])), inverse[before[order]] + offset, symbols[before[order]] != 0,
                      symbols[order], left[order], order + offset))
        offset += n
    known, back, inner, first, left, order = (np.concatenate(x) for x in zip(*parts, strict=True))
    known = np.append(known, True)
    lb = np.flatnonzero(known[:-1])
    rb = np.append(lb[1:], offset) - 1
    whole = left[lb] >= start
    lb, rb = lb[whole], rb[whole]
    low = np.uint64(max(1, (offset - 1).bit_length()))
    mask = np.uint64((1 << int(low)) - 1)
    for _ in range(start, length):   # common prefixes start, ..., length - 1 (shorter ones came with the first sort)
        alone = lb == rb
        one = lb[alone]
        one = back[one[inner[one]]]
        lb, size = lb[~alone], (rb - lb + 1)[~alone]
        if len(lb):
            of = np.repeat(np.arange(len(lb)), size)
            at = np.arange(len(of)) + np.repeat(lb - np.cumsum(size) + size, size)
            some = inner[at]
            of, at = of[some], back[at[some]]
            packed = np.sort((of.astype(np.uint64) << low) | at.astype(np.uint64))
            at, of = (packed & mask).astype(np.int64), packed >> low
            symbol = first[at]
            new = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), (of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1]))))
            lb, rb = np.concatenate((one, at[new])), np.concatenate((one, at[np.append(new[1:], len(at))[: len(new)] - 1]))
        else:
            lb = rb = one
        fresh = ~known[rb + 1]
        lb, rb = lb[fresh], rb[fresh]
        known[rb + 1] = True
        if not len(lb):
            break
    long = left >= length
    twin = ~known[1:offset] & long[1:] & long[:-1]
    hit = np.zeros(offset, bool)
    hit[order[1:][twin]] = True
    hit[order[:-1][twin]] = True
    out, at = [], 0
    for contexts in blocks:
        out.append([])
        for c in contexts:
            out[-1].append(np.flatnonzero(hit[at : at + len(c)]))
            at += len(c) + 1
    return out


def _runs(starts: np.ndarray) -> list[dict]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return [{"off": int(p[0]), "n": len(p)} for p in np.split(starts, cut)]


def _expand(length: int):
    """Blocks of whole anchors, expanded; rows arrive sorted by (key, ctx)."""
    def flush(blocks):
        out, before = ([], [], []), None
        for block, found in zip(blocks, shared([[r[2] for r in b] for b in blocks], length) if blocks else [], strict=True):
            for (key, ctx, _), starts in zip(block, found, strict=True):
                if len(starts) and (key, ctx) != before:
                    for column, value in zip(out, (key, ctx, _runs(starts)), strict=True):
                        column.append(value)
                before = key, ctx
        if out[0]:
            yield record(FOUND, list(out))

    def run(batches):
        blocks, block, now, size, total, own, last = [], [], [], 0, 0, 0, None

        def close():
            """The anchor's contexts go to the open block, or begin one."""
            nonlocal block, size, total
            if len(now) > 1:
                if block and size + own > SMALL:
                    blocks.append(block)
                    block, size = [], 0
                block = block + now
                size, total = size + own, total + own

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last:
                    close()
                    now, own, last = [], 0, row[0]
                    if total > BLOCK // 2:
                        yield from flush([*blocks, block])
                        blocks, block, size, total = [], [], 0, 0
                now.append(row)
                own += len(row[2]) + 1
        close()
        yield from flush([b for b in (*blocks, block) if b])
    return run


def _redeal(length: int, gram: int):
    """Contexts of hot anchors dealt anew by longer grams: rows (key, ctx,
    data) with the context they come from and where in it they start."""
    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for key, ctx, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bytes_ = np.frombuffer(data, np.uint8)
                for k, c, lo, n in zip(*(x.tolist() for x in anchors(bytes_, np.array([len(data)]), length, gram)), strict=True):
                    for column, value in zip(out, (k, c, data[lo : lo + n + length - 1], key, ctx, lo), strict=True):
                        column.append(value)
            yield record(REDEALT, out)
    return run


REDEALT = T.StructType([*CONTEXT.fields, T.StructField("pkey", T.LongType()), T.StructField("pctx", T.LongType()), T.StructField("off", T.LongType())])


def frequent(counts: DataFrame, on: list[str], rows: str) -> DataFrame:
    """The keys of ``counts`` with more than ``HOT`` rows and the ``parts`` that
    they are dealt to: at most one key for ``HOT`` rows, so a table to broadcast."""
    return materialize(counts.where(F.col(rows) > HOT).select(*on, F.ceil(F.col(rows) / HOT).cast("int").alias("parts")), "repeat-frequent")


def dealt(rows: DataFrame, keys: DataFrame, on: list[str], hot: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` joined with the one row that ``keys`` has for a key, if any.  Rows
    of a key in ``hot`` are dealt to its parts by hash of the columns ``by``, and
    the row of ``keys`` goes to each part."""
    if not hot.limit(1).count():
        return rows.join(keys, on)
    hot, parts = F.broadcast(hot), F.coalesce("parts", F.lit(1))
    rows = rows.join(hot, on, "left").withColumn("part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("parts")
    keys = keys.join(hot, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return rows.join(keys, [*on, "part"]).drop("part")


def expand(contexts: DataFrame, length: int, gram: int, part: int) -> DataFrame:
    """(key, ctx, runs): the windows of each context, as runs of offsets, that
    occur elsewhere.  ``contexts`` (key, ctx, data) is a written table that
    holds a context once or twice (twice if it occurs more than once)."""
    spark = contexts.sparkSession
    hot = materialize(contexts.groupBy("key").count().where(F.col("count") > part).select("key"), "repeat-hot")
    some = hot.limit(1).count() > 0 and gram < length
    hot = F.broadcast(hot)  # a key for ``part`` contexts at most
    cool = contexts.join(hot, "key", "left_anti") if some else contexts
    found = cool.repartition("key").sortWithinPartitions("key", "ctx").mapInArrow(_expand(length), FOUND)
    if not some:
        return found
    gram = (gram + length + 1) // 2
    rows = materialize(contexts.join(hot, "key", "left_semi").mapInArrow(_redeal(length, gram), REDEALT), "repeat-redealt")
    rows = rows.withColumn("place", F.xxhash64("pkey", "pctx", "off"))
    classes = materialize(rows.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("all"), F.min("place").alias("a"), F.max("place").alias("b")),
                          "repeat-classes")
    live = classes.groupBy("key").agg(F.sum("all").alias("of_key"), F.count(F.lit(1)).alias("classes")).where(F.col("of_key") > 1)
    kept = dealt(classes, live.select("key"), ["key"], frequent(live, ["key"], "classes"), ["ctx"])
    often = frequent(classes, ["key", "ctx"], "all")
    once = (dealt(rows, kept, ["key", "ctx"], often, ["place"]).where(F.col("place").isin(F.col("a"), F.col("b")))
            .dropDuplicates(["key", "ctx", "place"])
            .withColumn("times", F.when((F.col("a") == F.col("b")) & (F.col("all") > 1), 2).otherwise(1)))
    again = materialize(once.withColumn("_", F.explode(F.sequence(F.lit(1), "times"))).select("key", "ctx", "data"), "repeat-contexts")
    inner = expand(again, length, gram, part)
    back = (dealt(rows.select("key", "ctx", "pkey", "pctx", "off").distinct(), inner, ["key", "ctx"], often, ["pkey", "pctx", "off"])
            .select("pkey", "pctx", F.explode(F.transform("runs", lambda r: F.struct((r.off + F.col("off")).alias("off"), r.n.alias("n")))).alias("run"))
            .groupBy(F.col("pkey").alias("key"), F.col("pctx").alias("ctx")).agg(F.collect_list("run").alias("runs")))
    return found.unionByName(back.select("key", "ctx", F.col("runs").cast(RUNS)))


def _anchor_rows(length: int, gram: int):
    """Rows of the contexts of distinct texts; a text goes on twice at most from each task."""
    def run(batches):
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            t1, t2 = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("t1", "t2"))
            keep = []
            for i, t in enumerate(zip(t1.tolist(), t2.tolist(), strict=True)):
                seen[t] = times = seen.get(t, 0) + 1
                if times <= 2:
                    keep.append(i)
            texts = batch.column("data").take(pa.array(keep, pa.int64())).to_pylist()
            t1, t2 = t1[keep], t2[keep]
            for a, b in passes(texts, 8 * _SLICE):
                ends = np.cumsum([len(t) for t in texts[a:b]])
                key, ctx, lo, n = anchors(np.frombuffer(b"".join(texts[a:b]), np.uint8), ends, length, gram)
                of = np.searchsorted(ends, lo, side="right")
                lo = lo - np.concatenate(([0], ends))[of]
                if len(lo):
                    yield record(ANCHOR, [key, ctx, t1[a + of], t2[a + of], lo, n])
    return run


def _cut(length: int):
    """The contexts that go on, cut from their texts (a text once from each task)."""
    def run(batches):
        seen = set()
        for batch in batches:
            out = [[], [], []]
            for t1, t2, ships, data in zip(*(batch.column(n).to_pylist() for n in ("t1", "t2", "ships", "data")), strict=True):
                if (t1, t2) in seen:
                    continue
                seen.add((t1, t2))
                for s in ships:
                    piece = data[s["lo"] : s["lo"] + s["n"] + length - 1]
                    for _ in range(s["times"]):
                        out[0].append(s["key"])
                        out[1].append(s["ctx"])
                        out[2].append(piece)
            if out[0]:
                yield record(CONTEXT, out)
    return run


def _union(hits) -> list[dict]:
    out: list[dict] = []
    for start, end in sorted((h["start"], h["end"]) for h in hits or ()):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, part: int = PART,
            digest: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes`` (of the text in UTF-8), ``spans`` (maximal runs
    of bytes covered by windows of ``length`` bytes that start anywhere else,
    too, in any row), ``n_removed``, ``n_spans`` and ``kept`` (the other bytes,
    binary); with ``digest`` their lower-case SHA-256, ``kept_sha256``, in its
    place, so that texts without repeats aren't written.

    A null text is the empty text: no bytes, no spans.  Texts shorter than the
    window keep all bytes.  Equal rows are separate texts, so all windows of
    both repeat; ids aren't read and may be null or repeated.  A text of any
    length is taken whole, in slices.  An empty table gives an empty result.
    Columns of ``docs`` that have the name of a new one are replaced; any other
    name is free.
    """
    new = ["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256" if digest else "kept"]
    keyed = (ensure_text(docs, text).select(F.struct("*").alias("row"))
             .withColumn("data", F.coalesce(F.col("row").getField(text), F.lit("")).cast("binary"))
             .withColumn("t1", F.xxhash64("data")).withColumn("t2", F.xxhash64(F.lit(1), "data")))
    keyed = keyed.withColumn("row", F.col("row").dropFields(text))
    found = (keyed.where(F.length("data") >= length).select("t1", "t2", "data")
             .mapInArrow(_anchor_rows(length, gram), ANCHOR))
    found = materialize(found, "repeat-anchors")
    more = found.groupBy("key").count().where(F.col("count") > 1)
    paired = dealt(found, more.select("key"), ["key"], frequent(more, ["key"], "count"), ["t1", "t2", "lo"])
    live = materialize(paired.repartition(*ANCHOR.names).groupBy(*ANCHOR.names).agg(F.count(F.lit(1)).alias("copies"))
                       .withColumn("place", F.xxhash64("t1", "t2", "lo")), "repeat-live")
    classes = live.groupBy("key", "ctx").agg(F.sum("copies").alias("all"), F.min("place").alias("a"), F.max("place").alias("b"))
    times = F.when(~F.col("place").isin(F.col("a"), F.col("b")), 0).when((F.col("a") == F.col("b")) & (F.col("all") > 1), 2).otherwise(1)
    often = frequent(live.groupBy("key", "ctx").count(), ["key", "ctx"], "count")
    ships = (dealt(live, classes, ["key", "ctx"], often, ["place"]).withColumn("times", times).groupBy("t1", "t2")
             .agg(F.collect_list(F.when(F.col("times") > 0, F.struct("key", "ctx", "lo", "n", "times"))).alias("ships")))
    repeated = F.col("ships").isNotNull()
    texts = (keyed.join(ships, ["t1", "t2"], "left").withColumn("n_bytes", F.length("data").cast("long")))
    if digest:
        texts = texts.withColumn("whole", F.when(~repeated, F.sha2("data", 256))).withColumn("data", F.when(repeated, F.col("data")))
    texts = materialize(texts, "repeat-texts")
    contexts = materialize(texts.where(F.size("ships") > 0).select("t1", "t2", "ships", "data")
                           .mapInArrow(_cut(length), CONTEXT), "repeat-contexts")
    runs = expand(contexts, length, gram, part)
    hits = (dealt(live, runs, ["key", "ctx"], often, ["place"])
            .select("t1", "t2", F.explode(F.transform("runs", lambda r: F.struct(
                (F.col("lo") + r.off).alias("start"), (F.col("lo") + r.off + r.n + (length - 1)).alias("end")))).alias("hit"))
            .groupBy("t1", "t2").agg(F.collect_list("hit").alias("hits")))
    result = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("spans", SPANS),
                           T.StructField(new[-1], T.StringType() if digest else T.BinaryType())])
    joined = texts.drop("ships").join(hits, ["t1", "t2"], "left").drop("t1", "t2")
    own = [n for n in docs.columns if n != text and n not in new]
    keep = T.StructType([T.StructField("row", keyed.schema["row"].dataType), T.StructField("n_bytes", T.LongType())])
    out = T.StructType([*keep.fields, *result.fields])

    def run(batches):
        for batch in batches:
            whole = batch.column("whole").to_pylist() if digest else [None] * batch.num_rows
            columns = [[] for _ in range(4)]
            for data, hit, sha in zip(batch.column("data").to_pylist(), batch.column("hits").to_pylist(), whole, strict=True):
                spans = _union(hit)
                if sha is None:
                    kept, at = [], 0
                    for s in spans:
                        kept.append(data[at : s["start"]])
                        at = s["end"]
                    kept = b"".join([*kept, data[at:]]) if spans else data
                for column, value in zip(columns, (sum(s["end"] - s["start"] for s in spans), len(spans), spans,
                                                   sha or (hashlib.sha256(kept).hexdigest() if digest else kept)), strict=True):
                    column.append(value)
            made = record(result, columns)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep.names] + made.columns, names=out.names)

    done = joined.mapInArrow(run, out)
    return done.select(*[F.col("row").getField(n).alias(n) for n in own], *new)
