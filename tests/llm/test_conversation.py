"""Repaired conversations against a memoised search over all edits."""

import hashlib
import random
import re
from functools import cache
from itertools import pairwise
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from pagesearch.llm import conversation as C

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        c = crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if c == 0:
            continue
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        out += [(conv, turn, "user" if c == 4 else role, text)] * (2 if c == 3 else 1)
    return out


def solve(rows):
    """rows: (role, text, must be deleted, truncated).  (cost, audit, lines)."""
    @cache
    def best(i, state, inserted):
        to = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[to]
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3:
            c, a, r = best(i, to, inserted + 1)
            options.append((c + 2, "I" + a, (name + ":", *r)))
        if i < len(rows):
            role, text, must, cut = rows[i]
            c, a, r = best(i + 1, state, 0)
            options.append((c + 3, "D" + a, r))
            if not must:
                if role[:1] == to or (state == "" and role[:1] == "s"):
                    c, a, r = best(i + 1, role[:1], 0)
                    options.append((c + cut, "K" + a, (f"{role}:{text}", *r)))
                c, a, r = best(i + 1, to, 0)
                options.append((c + 2 + cut, "R" + a, (f"{name}:{text}", *r)))
        return min(options, default=(10**9, "", ()))
    return best(0, "", 0)


def expected(original):
    out = []
    for conv in {r[0] for r in original}:
        rows = [r for r in damage(original) if r[0] == conv]
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], tie(r[3])))
        seen, state, faults = set(), [], [0, 0, 0]
        for _, _, role, text in rows:
            words = text.strip(" \t\n\v\f\r")
            fault = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                faults[fault] += 1
            state.append((role, text, fault < 2, int(fault == 2)))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
        cost, audit, lines = solve(tuple(state))
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def tie(text):
    return text


def got(df):
    return sorted((tuple(r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
                   for r in C.repaired_digest(df).collect()), key=str)


def conversations(rng, n, longest):
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, longest)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s"])
            text = rng.choice(["Hello.", "yes", "Why? ", "é!\n", " ", "", None, "no. maybe", f"t{turn}.", f"t{turn}"])
            rows.append((conv, None if rng.random() < 0.03 and conv != 0 else turn, role, text))
    return rows


def distinct_nulls(rows):
    """Rows without a turn: one a conversation, so that ties have no free order."""
    seen, out = set(), []
    for r in rows:
        if r[1] is None and r[0] in seen:
            continue
        if r[1] is None:
            seen.add(r[0])
        out.append(r)
    return out


@pytest.mark.parametrize("block", [4096, 4, 1])
def test_repair_matches_search(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = distinct_nulls(conversations(random.Random(block), 40, 14))
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == expected(rows)


def test_long_conversation_in_blocks_equals_one_block(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"a {t}.", f"b {t}", "same.", ""])) for t in range(300)] + [(8, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA)
    one = got(df)
    monkeypatch.setattr(C, "BLOCK", 16)
    assert got(df) == one
    summary, pieces = C.repair(df)
    assert pieces.where("conv_id = 7").count() > 15 and summary.count() == 2


def test_driver_table_matches_search(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert got(table) == expected(rows)


def test_repeated_rows_ties_strings_empty_and_extra_columns(spark):
    rows = [("x", 1, "user", "Hi.")] * 5 + [("y", 1, "assistant", "A."), ("y", 1, "user", "B."), ("z", None, None, None)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    for n in ("conv", "pos", "block", "initial", "blank", "cut", "audit", "c"):
        df = df.withColumn(n, F.lit("mine"))
    assert [r[0] for r in got(df)] == ["x", "y", "z"] and got(df) == expected(rows)
    assert got(df.limit(0)) == []
    big = spark.createDataFrame([(1, t, "user", "long. " * 200_000) for t in range(2)], SCHEMA)
    assert got(big) == expected([tuple(r) for r in big.collect()])


def test_ranks_read_the_least_of_equal_costs():
    import numpy as np
    # one kept assistant row: inserting a user before it and deleting it both cost what the search finds
    for roles in ("a", "ua", "aa", "uu", "su", "ss", "s", "asu", "uuaa"):
        code = np.array([[{"s": 1, "u": 2, "a": 3}[r] for r in roles]])
        flat = np.zeros(code.shape, bool)
        letter, _, _ = C.least_paths(code, flat, flat, C.END_COST[None], np.array([True]), np.array([0]), np.array([0]))
        audit = "".join(C.LETTERS[letter[0]]).rstrip("\0")
        assert audit == solve(tuple((r, f"{k}.", False, 0) for k, r in enumerate(roles)))[1]
