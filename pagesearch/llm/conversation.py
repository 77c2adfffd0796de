"""Conversation repair by a cost DP and prefix-doubling path ranking.

The rows of a conversation are edited (Keep, Delete, Rerole, Insert) at least
cost into a sequence whose role initials match ``(s?(ua)+)?``; of the cheapest
audits (the edits' initials) the ASCII-least is taken.

All rows are ordered once by (conversation, turn) and numbered; blocks of
``BLOCK`` numbers are the unit of work, so a conversation of any length is many
blocks and no task holds more than one.  A node is a place between two rows and
what came last (nothing, s, u, a).

1. Each block gives, for every conversation in it, the costs from each entry
   to each exit state (a min-plus matrix) or, for one that lies inside, its cost.
2. Matrices of successive blocks are joined by doubling: after k rounds each
   block knows the cost of the next 2**k ones, so the cost from its end on.
3. With these costs the optimal arcs of a block are known.  Nodes are ranked by
   the first 1, 2, 4, ... letters of their least audit: the rank of 2 m letters
   is that of the pair (rank of m, rank of m at the node m letters on).  Arcs
   are chosen by (letter, rank of the head), and paths are read through the
   doubled pointers.  For a conversation of several blocks a block does so from
   each entry state, and the states met are composed by doubling again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesearch.llm.frames import record
from pagesearch.session import materialize

BLOCK = 4096
_ROW_BITS = 33              # of monotonically_increasing_id()
FAR = 1 << 40               # no path
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
LETTERS = np.array(list("\0DIKR"))
NEXT = np.array([2, 2, 3, 2])          # state after an inserted or reroled row: start, s, u, a
ROLES = {2: "user", 3: "assistant"}
END_COST = np.array([0, 4, 2, 0])      # from each state to an end, by inserting

LONGS = ["conv_block", "n_rows", "blank", "duplicate", "truncated", "illegal", "turns"]
PIECE = T.StructType([T.StructField("conv", T.StringType()), *(T.StructField(n, T.LongType()) for n in LONGS),
                      T.StructField("first_initial", T.StringType()), T.StructField("last_initial", T.StringType()),
                      T.StructField("first_turn", T.LongType()), T.StructField("last_turn", T.LongType()),
                      T.StructField("cost", T.LongType()), T.StructField("matrix", T.ArrayType(T.LongType())),
                      T.StructField("repeats", T.ArrayType(T.IntegerType()))])
TURN = T.StructType([T.StructField(n, T.StringType()) for n in ("edit", "role", "text")])
PATH = T.StructType([T.StructField("conv", T.StringType()), T.StructField("conv_block", T.LongType()), T.StructField("entry", T.IntegerType()),
                     T.StructField("exit", T.IntegerType()), T.StructField("audit", T.StringType()), T.StructField("turns", T.ArrayType(TURN))])
_SPACE = r"\x20\x09-\x0D"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the planted damage: with c the CRC-32
    of ``conv_id:turn`` modulo 20, a row is dropped (0), emptied (1), loses its
    ``.!?`` (2), comes twice (3) or gets the role user (4).  Null roles and
    texts, and a null in that key, are one space."""
    own = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(" "))
    c = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), own("role").alias("role"), own("text").alias("text"), c.alias("c"))
    return (rows.where("c != 0")
            .withColumn("text", F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
            .withColumn("role", F.when(F.col("c") == 4, "user").otherwise(F.col("role")))
            .withColumn("copy", F.explode(F.when(F.col("c") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", "role", "text"))


def _key(conv_id):
    return F.when(conv_id.isNull(), "n").otherwise(F.concat(F.lit("v"), conv_id.cast("string")))


def ordered(rows: DataFrame) -> DataFrame:
    """Written rows with ``conv`` (a key that is never null), ``block`` (the
    blocks of a conversation have successive numbers), ``pos`` (their order),
    ``initial``, ``blank`` and ``cut`` (truncated)."""
    rows = rows.select(_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"),
                       *(F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n) for n in ("role", "text")))
    keys = ["conv", F.col("turn").asc_nulls_first(), "role", "h1", "h2", "nonce"]
    rows = (rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
            .withColumn("nonce", F.monotonically_increasing_id())   # splits equal rows over tasks
            .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("nonce").withColumn("pos", F.monotonically_increasing_id()))
    rows = materialize(rows, "turns")
    part, own = F.shiftright("pos", _ROW_BITS), F.shiftright(F.col("pos").bitwiseAND((1 << _ROW_BITS) - 1), BLOCK.bit_length() - 1)
    sizes = rows.groupBy(part.alias("part")).agg((F.max(own) + 1).alias("blocks"))
    # one row for each partition of the table
    before = sizes.select("part", F.expr("sum(blocks) over (order by part rows between unbounded preceding and 1 preceding)").alias("before"))
    return (rows.withColumn("part", part).join(F.broadcast(before), "part")
            .withColumn("block", F.coalesce("before", F.lit(0)) + own)
            .withColumn("initial", F.substring("role", 1, 1))
            .withColumn("blank", ~F.col("text").rlike(f"[^{_SPACE}]"))
            .withColumn("cut", ~F.col("blank") & ~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z"))
            .drop("part", "before"))


def _relax(cost: np.ndarray) -> np.ndarray:
    """Costs (..., 4) at a place before any inserted rows."""
    one = cost[..., NEXT]
    return np.minimum(np.minimum(cost, one + INSERT), one[..., NEXT] + 2 * INSERT)


def _arcs(initial: np.ndarray, drop: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows (any shape): cost and head state of Keep, cost of Rerole, by state."""
    want = np.array([[1, 2], [2, 2], [3, 3], [2, 2]])      # codes that a state takes: 1 s, 2 u, 3 a
    fits = (initial[..., None, None] == want).any(-1) & ~drop[..., None]
    add = np.where(cut, TRUNCATED, 0)[..., None]
    keep = np.where(fits, add, FAR)
    head = np.where((initial == 1)[..., None] & (np.arange(4) == 0), 1, NEXT)
    rerole = np.where(drop[..., None], FAR, REROLE + add) + np.zeros(4, np.int64)
    return keep, head, rerole


def costs(initial: np.ndarray, drop: np.ndarray, cut: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(pieces, rows + 1, 4): cost from each node to the end.  Arrays are
    (pieces, rows); ``end`` (pieces, 4) holds the costs behind the last row."""
    pieces, rows = initial.shape
    keep, head, rerole = _arcs(initial, drop, cut)
    out = np.empty((pieces, rows + 1, 4), np.int64)
    out[:, rows] = end
    at = np.arange(pieces)[:, None]
    for i in range(rows - 1, -1, -1):
        after = out[:, i + 1]
        best = np.minimum(after + DELETE, np.minimum(keep[:, i] + after[at, head[:, i]], rerole[:, i] + after[:, NEXT]))
        out[:, i] = _relax(np.minimum(best, FAR))
    return out


def least_paths(initial: np.ndarray, drop: np.ndarray, cut: np.ndarray, end: np.ndarray, last: np.ndarray, entry: np.ndarray,
                start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece, from state ``entry`` before row ``start``, the least of
    the cheapest audits: letters (0 after the end), row numbers and states of
    the nodes where they are written; the last state is that of the exit."""
    pieces, rows = initial.shape
    cost = costs(initial, drop, cut, end)
    keep, keep_head, rerole = _arcs(initial, drop, cut)
    n = pieces * (rows + 1) * 4
    node = np.arange(n).reshape(pieces, rows + 1, 4)
    heads, costs_of = np.full((4, n), n), np.full((4, n), FAR)
    grid = lambda a: a.reshape(pieces, rows + 1, 4)
    at = np.arange(pieces)[:, None, None], np.arange(1, rows + 1)[None, :, None]
    for letter, head, price in ((0, np.broadcast_to(np.arange(4), keep.shape), np.full(keep.shape, DELETE)), (2, keep_head, keep),
                                (3, np.broadcast_to(NEXT, keep.shape), rerole)):
        grid(heads[letter])[:, :rows] = node[at[0], at[1], head]
        grid(costs_of[letter])[:, :rows] = price + cost[at[0], at[1], head]
    grid(heads[1])[:] = node[:, :, NEXT]
    grid(costs_of[1])[:] = cost[:, :, NEXT] + INSERT
    grid(costs_of[1])[~last, rows] = FAR     # the next block inserts there
    optimal = (costs_of == cost.reshape(-1)) & (cost.reshape(-1) < FAR)
    heads = np.where(optimal, heads, n)
    letter_of = np.where(optimal, np.arange(1, 5)[:, None], 9)

    def chosen(rank):
        arc = np.argmin(letter_of * (n + 2) + rank[heads], axis=0)
        return arc, np.append(heads[arc, np.arange(n)], n)

    rank = np.append(np.where(optimal.any(0), letter_of.min(0), 0), 0)
    arc, jump = chosen(rank)
    jumps = []
    while True:
        jumps.append(jump)
        if (jump == n).all():
            break
        _, rank = np.unique(rank * (n + 2) + rank[jump], return_inverse=True)
        jump = jump[jump]
    arc, first = chosen(rank)
    letters = np.append(np.where(optimal.any(0), arc + 1, 0), 0)
    if not np.array_equal(first, jumps[0]):
        raise AssertionError("ranks of longer prefixes chose another arc")
    path = node[np.arange(pieces), start, entry][:, None]
    for jump in reversed(jumps):
        path = np.stack((path, jump[path]), axis=2).reshape(pieces, -1)
    letter = letters[path]
    node_row, node_state = np.append(np.arange(n) // 4 % (rows + 1), -1), np.append(np.arange(n) % 4, -1)
    return letter, node_row[path], node_state[path]


def _code(initials) -> np.ndarray:
    return np.array([{"s": 1, "u": 2, "a": 3}.get(x, 0) for x in initials], np.int64)


def _pieces_of(conv: list) -> list[tuple[int, int]]:
    cut = [i for i in range(1, len(conv)) if conv[i] != conv[i - 1]]
    return list(zip([0, *cut], [*cut, len(conv)], strict=True))


def _buckets(spans):
    """Pieces of like length together, so that padding at most doubles them."""
    by: dict[int, list[int]] = {}
    for k, (lo, hi) in enumerate(spans):
        by.setdefault((hi - lo).bit_length(), []).append(k)
    return by.values()


def _padded(spans, ks, *columns):
    """Columns as (pieces, rows), aligned at the end; and each piece's first row."""
    rows = max(spans[k][1] - spans[k][0] for k in ks)
    out = [np.zeros((len(ks), rows), c.dtype) for c in columns]
    for j, k in enumerate(ks):
        lo, hi = spans[k]
        for a, c in zip(out, columns, strict=True):
            a[j, rows - (hi - lo) :] = c[lo:hi]
    return out, np.array([rows - (spans[k][1] - spans[k][0]) for k in ks])


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("pos") if table.num_rows else table


def _summary(rows: pa.Table, firsts: pa.Table) -> pa.Table:
    """The pieces of one block: faults, costs, and matrices of those at its ends."""
    rows = _sorted(rows)
    pos = rows.column("pos").to_numpy()
    repeat = ~np.isin(pos, firsts.column("pos").to_numpy()) if firsts.num_rows else np.ones(len(pos), bool)
    blank, cut = (np.array(rows.column(n).to_pylist(), bool) for n in ("blank", "cut"))
    repeat &= ~blank
    cut &= ~repeat
    conv, initials, turns = (rows.column(n).to_pylist() for n in ("conv", "initial", "turn"))
    code, block = _code(initials), rows.column("block")[0].as_py()
    spans = _pieces_of(conv)
    out: list = [None] * len(spans)
    ends = {0, len(spans) - 1}
    for ks in _buckets(spans):
        (i, d, c), start = _padded(spans, ks, code, blank | repeat, cut)
        done = costs(i, d, c, np.tile(END_COST, (len(ks), 1)))[np.arange(len(ks)), start, 0]
        edge = [j for j, k in enumerate(ks) if k in ends]
        unit = np.where(np.eye(4, dtype=bool), 0, FAR)
        full = [costs(i[edge], d[edge], c[edge], np.tile(unit[x], (len(edge), 1)))[np.arange(len(edge)), start[edge]] for x in range(4)] if edge else []
        for j, k in enumerate(ks):
            lo, hi = spans[k]
            known = [t for t in turns[lo:hi] if t is not None]
            pairs = [a + b for a, b in zip(initials[lo:hi], initials[lo + 1 : hi])]
            matrix = np.stack([f[edge.index(j)] for f in full], axis=1).reshape(-1).tolist() if j in edge else None
            out[k] = (conv[lo], block, hi - lo, int(blank[lo:hi].sum()), int(repeat[lo:hi].sum()), int(cut[lo:hi].sum()),
                      sum(p not in ("su", "ua", "au") for p in pairs), len(set(known)), initials[lo], initials[hi - 1],
                      known[0] if known else None, known[-1] if known else None, int(done[j]), matrix, np.flatnonzero(repeat[lo:hi]).tolist())
    return pa.Table.from_batches([record(PIECE, list(zip(*out, strict=True)))])


def _read_paths(rows: pa.Table, pieces: pa.Table) -> pa.Table:
    """Least paths through one block, for each entry state that a piece may have."""
    rows = _sorted(rows)
    blank, cut = (np.array(rows.column(n).to_pylist(), bool) for n in ("blank", "cut"))
    conv, initials, roles, texts = (rows.column(n).to_pylist() for n in ("conv", "initial", "role", "text"))
    spans, info = _pieces_of(conv), {p["conv"]: p for p in pieces.to_pylist()}
    repeat = np.zeros(len(conv), bool)
    for lo, _ in spans:
        repeat[lo + np.array(info[conv[lo]]["repeats"], np.int64)] = True
    code, out = _code(initials), [[] for _ in PATH.names]
    for ks in _buckets(spans):
        tries = [(k, s) for k in ks for s in ((0,) if info[conv[spans[k][0]]]["is_first"] else range(4))]
        own = [info[conv[spans[k][0]]] for k, _ in tries]
        (i, d, c), start = _padded(spans, [k for k, _ in tries], code, blank | repeat, cut & ~repeat)
        entry = np.array([s for _, s in tries])
        letter, row, state = least_paths(i, d, c, np.array([p["end"] for p in own]), np.array([p["is_last"] for p in own]), entry, start)
        for j, (k, s) in enumerate(tries):
            lo, hi = spans[k]
            n = int(np.argmin(letter[j] != 0)) if (letter[j] == 0).any() else letter.shape[1]
            turns, audit = [], "".join(LETTERS[letter[j, :n]])
            for step in range(n):
                at = lo + int(row[j, step]) - int(start[j])
                edit, to = audit[step], ROLES[int(NEXT[state[j, step]])]
                if edit == "K":
                    turns.append(dict(edit=edit, role=roles[at], text=texts[at]))
                elif edit != "D":
                    turns.append(dict(edit=edit, role=to, text=texts[at] if edit == "R" else ""))
            for column, value in zip(out, (conv[lo], own[j]["conv_block"], s, int(state[j, n]) if n < state.shape[1] else -1, audit, turns), strict=True):
                column.append(value)
    return pa.Table.from_batches([record(PATH, out)])


def _times(a, b):
    """Min-plus product of two 4 x 4 matrices in row order, as array expressions."""
    best = lambda i, j: F.least(*[F.get(a, F.lit(4 * i + k)) + F.get(b, F.lit(4 * k + j)) for k in range(4)], F.lit(FAR))
    return F.array(*[best(i, j) for i in range(4) for j in range(4)])


def _doubled(steps: DataFrame, value: str, combine, longest: int, forward: bool) -> DataFrame:
    """(conv, conv_block, value): each block's value combined with those of all
    later blocks of its conversation (``forward``), or all earlier ones."""
    reach = 1
    while reach < longest:
        other = steps.select("conv", (F.col("conv_block") - (reach if forward else -reach)).alias("conv_block"), F.col(value).alias("other"))
        steps = materialize(steps.join(other, ["conv", "conv_block"], "left")
                            .withColumn(value, F.when(F.col("other").isNull(), F.col(value)).otherwise(combine(F.col(value), F.col("other")))).drop("other"), "turn-doubling")
        reach *= 2
    return steps


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs the conversations of a table (conv_id, turn, role, text).

    Rows go by turn, nulls first (then by role and text; equal rows next to
    each other).  A row's first fault counts: blank (no character but spaces),
    duplicate (role and text seen earlier in its conversation), truncated (last
    such character not ``.!?``).  Keep costs 0, Rerole to user or assistant 2,
    Delete 3 (required for blank and duplicate rows), Insert of an empty user
    or assistant row 2; a truncated row that stays adds 1.

    Returns two frames.  The first has a row for each conv_id: ``gaps``
    (missing turn numbers), ``blank``, ``duplicate``, ``truncated``,
    ``illegal`` (adjacent role initials other than su, ua, au) and ``cost``.
    The second has the repaired conversations in pieces of at most ``BLOCK``
    input rows: conv_id, ``piece`` (their order), ``audit`` and ``turns``
    (array of edit, role, text, without deleted rows).

    Null roles and texts are one space; a null conv_id is a conversation of its
    own; a null or repeated turn is a row like any other.  Texts are taken
    whole.  Other columns of the table are ignored whatever their names.  An
    empty table gives empty frames.
    """
    base = ordered(conversations.select("conv_id", "turn", "role", "text"))
    ids = conversations.select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    firsts = base.groupBy("conv", "role", "h1", "h2").agg(F.min(F.struct("pos", "block")).alias("f")).select("f.pos", "f.block")
    narrow = base.select("block", "pos", "conv", "initial", "turn", "blank", "cut")
    pieces = materialize(narrow.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(_summary, PIECE), "turn-pieces")

    def neighbour(step: int, *columns: str) -> DataFrame:
        return pieces.select("conv", (F.col("conv_block") - step).alias("conv_block"), *(F.col(c).alias(f"{c}_{'next' if step > 0 else 'before'}") for c in columns))

    both = materialize(pieces.join(neighbour(1, "first_initial", "first_turn"), ["conv", "conv_block"], "left")
                       .join(neighbour(-1, "n_rows"), ["conv", "conv_block"], "left")
                       .withColumn("is_last", F.col("first_initial_next").isNull()).withColumn("is_first", F.col("n_rows_before").isNull()), "turn-neighbours")
    pair = F.concat("last_initial", "first_initial_next")
    joint = (F.when(F.col("is_last"), 0).otherwise((~pair.isin("su", "ua", "au")).cast("long")).alias("illegal"))
    same = F.coalesce((F.col("last_turn") == F.col("first_turn_next")).cast("long"), F.lit(0))
    several = both.where(~(F.col("is_first") & F.col("is_last")))
    spread = several.groupBy("conv").count().agg(F.max("count")).first()[0] or 1
    ends = F.array(*map(F.lit, END_COST.tolist()))
    if spread > 1:
        # a block's cost from its entry to the end is its matrix times the end's costs
        ahead = _doubled(several.select("conv", "conv_block", "matrix"), "matrix", _times, spread, True)
        from_here = ahead.select("conv", "conv_block", F.array(*[F.least(*[F.get("matrix", F.lit(4 * i + k)) + int(END_COST[k]) for k in range(4)], F.lit(FAR)) for i in range(4)]).alias("whole"))
        both = materialize(both.join(from_here, ["conv", "conv_block"], "left")
                           .join(from_here.select("conv", (F.col("conv_block") - 1).alias("conv_block"), F.col("whole").alias("after")), ["conv", "conv_block"], "left")
                           .withColumn("end", F.coalesce("after", ends)).withColumn("cost", F.coalesce(F.get("whole", F.lit(0)), "cost")), "turn-ends")
    else:
        both = both.withColumn("end", ends)
    found = (both.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + joint).alias("illegal"),
                                      F.sum(F.col("turns") - same).alias("turns"), F.min("first_turn").alias("low"), F.max("last_turn").alias("high"),
                                      F.min(F.when(F.col("is_first"), F.col("cost"))).alias("cost")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    summary = ids.join(found, "conv", "left").select(
        "conv_id", zero(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps"), *(zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")))

    right = both.select(F.col("conv_block").alias("block"), "conv_block", "conv", "repeats", "is_first", "is_last", "end")
    paths = (base.select("block", "pos", "conv", "initial", "role", "text", "blank", "cut")
             .groupBy("block").cogroup(right.groupBy("block")).applyInArrow(_read_paths, PATH))
    paths = materialize(paths, "turn-paths")
    if spread > 1:
        # exit state by entry state; the state before a block is that of all blocks before it, from 0
        maps = (paths.join(several.select("conv", "conv_block"), ["conv", "conv_block"], "left_semi").groupBy("conv", "conv_block")
                .agg(F.map_from_entries(F.collect_list(F.struct("entry", "exit"))).alias("m"))
                .withColumn("m", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.coalesce(F.try_element_at("m", s), F.try_element_at("m", F.lit(0))))))
        behind = _doubled(maps, "m", lambda here, before: F.transform(before, lambda s: F.get(here, s)), spread, False)
        entered = behind.select("conv", (F.col("conv_block") + 1).alias("conv_block"), F.get("m", F.lit(0)).alias("met"))
        paths = paths.join(entered, ["conv", "conv_block"], "left").where(F.col("entry") == F.coalesce("met", F.lit(0)))
    return summary, paths.join(ids, "conv").select("conv_id", F.col("conv_block").alias("piece"), "audit", "turns")


DIGEST = T.StructType([T.StructField("conv", T.StringType()), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])


def digest(summary: DataFrame, pieces: DataFrame) -> DataFrame:
    """``summary`` with the whole ``audit`` of each conversation and the digest
    of its repaired ``role:text`` lines.  Pieces are hashed as they stream by."""
    def run(batches):
        now, sha, audit, lines = None, hashlib.sha256(), [], 0
        for batch in batches:
            out = []
            for conv, letters, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "text", "n")), strict=True):
                if conv != now:
                    if now is not None:
                        out.append((now, "".join(audit), sha.hexdigest()))
                    now, sha, audit, lines = conv, hashlib.sha256(), [], 0
                audit.append(letters)
                if n:
                    sha.update((("\n" if lines else "") + text).encode("utf-8", "surrogatepass"))
                    lines += n
            if out:
                yield record(DIGEST, list(zip(*out, strict=True)))
        if now is not None:
            yield record(DIGEST, [[now], ["".join(audit)], [sha.hexdigest()]])

    lines = F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t.role, t.text)), "\n")
    rows = pieces.select(_key(F.col("conv_id")).alias("conv"), "piece", "audit", lines.alias("text"), F.size("turns").alias("n"))
    whole = rows.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(run, DIGEST)
    return (summary.withColumn("conv", _key(F.col("conv_id"))).join(whole, "conv", "left").drop("conv")
            .withColumn("audit", F.coalesce("audit", F.lit(""))).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))))


def repaired_digest(conversations: DataFrame) -> DataFrame:
    """The query: damage, repair and digest; every original conv_id stays."""
    wide = digest(*repair(damaged(conversations)))
    ids = conversations.select("conv_id").distinct()
    gone = ids.join(wide.select(F.col("conv_id").alias("c"), F.lit(True).alias("have")), F.col("conv_id").eqNullSafe(F.col("c")), "left").where("have is null").select("conv_id")
    zeros = [F.lit(0).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return wide.unionByName(gone.select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))
