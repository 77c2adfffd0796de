"""Repeated byte strings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesearch.llm import suffixdedup as S
from tests.llm.conftest import DOC, ODD


def covered(texts, length):
    """Brute force: (n_removed, n_spans, kept) of each byte text."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), runs, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def check(df, length, **how):
    rows = df.select("doc_id", "text").collect()
    expect = covered([(r.text or "").encode() for r in rows], length)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n, s, hashlib.sha256(k).hexdigest()) for r, (n, s, k) in zip(rows, expect, strict=True))
    got = S.repeats(df, length=length, digest=True, **how)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want


def test_shared_windows_match_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        length, letters = rng.choice([2, 3, 5, 8, 13]), rng.choice([b"ab", b"abc", b"abcdefgh"])
        base = bytes(rng.choices(letters, k=40))
        texts = [bytes(rng.choices(letters, k=rng.randint(0, 30))) + base[(p := rng.randint(0, 30)) : p + rng.randint(1, 20)] for _ in range(rng.randint(1, 8))]
        count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        half = [x for x in (texts, texts[::-1]) if x]
        for got, block in zip(S.shared(half, length), half, strict=True):
            assert [x.tolist() for x in got] == [[i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1] for t in block]


def test_every_window_has_one_anchor_decided_by_its_bytes():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"abcd", k=n)) for n in (0, 19, 20, 21, 300, 90)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    key, _, lo, n = S.anchors(data, ends, 20, 6)
    assert n.sum() == sum(max(0, len(t) - 19) for t in texts)
    by_window = {}
    for k, a, m in zip(key.tolist(), lo.tolist(), n.tolist(), strict=True):
        for s in range(a, a + m):
            assert by_window.setdefault(data[s : s + 20].tobytes(), k) == k


def passages(rng, n, letters="abcdefgh ", length=30):
    base = ["".join(rng.choices(letters, k=80)) for _ in range(4)]
    out = []
    for i in range(n):
        p = rng.choice(base)
        a = rng.randint(0, 40)
        t = "".join(rng.choices(letters, k=rng.randint(0, 60))) + p[a : a + rng.randint(10, 40)] + "é" * rng.randint(0, 2) + "".join(rng.choices(letters, k=rng.randint(0, 30)))
        out.append((i, t))
    return out + out[:3] + [(100, "ab" * 60), (101, "x" * 200), (102, base[0] * 3)]


@pytest.mark.parametrize("part", [1024, 3])
def test_texts_match_brute_force_and_hot_anchors_are_dealt_anew(frame, part):
    rows = passages(random.Random(part), 60)
    check(frame(rows).repartition(5), 30, gram=8, part=part)


@pytest.mark.parametrize("part", [1024, 3])
def test_rows_of_frequent_keys_are_dealt_in_the_joins(frame, monkeypatch, part):
    monkeypatch.setattr(S, "HOT", 4)
    used = []
    monkeypatch.setattr(S, "dealt", lambda rows, keys, on, hot, by, dealt=S.dealt: used.append(hot.count()) or dealt(rows, keys, on, hot, by))
    line = "a line that stands in every text, whatever else is there"
    texts = passages(random.Random(9), 20) + [(200 + i, f"{i} {line} {i * i}") for i in range(40)] + [(300 + i, "copy of one text " * 4) for i in range(12)]
    check(frame(texts).repartition(5), 30, gram=8, part=part)
    assert used[0] and used[1]


def test_a_frequent_key_does_not_stay_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 10)
    rows = spark.range(400).select(F.when(F.col("id") < 320, 7).otherwise(F.col("id")).alias("key"), F.col("id").alias("place"))
    keys = rows.groupBy("key").count().where("key <> 350")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = S.dealt(rows, keys.select("key"), ["key"], S.frequent(keys, ["key"], "count"), ["place"])
        assert got.columns == ["key", "place"]
        got = got.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sorted(r.place for r in got) == [i for i in range(400) if i != 350]
    most = Counter(r.task for r in got if r.key == 7).most_common(1)[0][1]
    assert most < 200


def test_passages_of_the_window_and_more_are_caught_and_other_texts_left_alone(frame):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    def say(n):
        return " ".join(rng.choices(words, k=n))
    long, short = [say(n) for n in (90, 100, 130)], [say(51)[:397]]
    rows = [(i, f"{say(40)}\n{p}\n{say(20)}") for i, p in enumerate([p for p in long + short for _ in range(2)])]
    rows += [(100 + i, say(150)) for i in range(6)]
    got = {r.doc_id: r.n_removed for r in S.repeats(frame(rows), digest=True).collect()}
    assert all(len(p) >= 400 and got[2 * i + j] >= len(p) for i, p in enumerate(long) for j in range(2))
    assert all(got[i] == 0 for i in (6, 7, *range(100, 106)))


def test_odd_texts_and_empty_table(spark, frame):
    check(frame([r for r in ODD if len(r[1] or "") < 10_000] + [(20, None), (21, "word " * 300)]), 30, gram=8)
    assert S.repeats(spark.createDataFrame([], DOC)).count() == 0
    long = frame([(7, "x" * 300_000), (8, "a b c d e f " * 120_000), (9, "only once " + "".join(map(str, range(200))))])
    got = {r.doc_id: r for r in S.repeats(long).collect()}
    assert (got[7].n_removed, got[8].n_removed, got[9].n_removed) == (300_000, 1_440_000, 0)
    assert bytes(got[9].kept).decode().startswith("only once")


def test_windows_over_slice_ends(frame, monkeypatch):
    monkeypatch.setattr(S, "_SLICE", 64)
    rng = random.Random(3)
    texts = [t.encode() for _, t in passages(rng, 20)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    assert S.anchors(data, ends, 30, 8)[3].sum() == sum(max(0, len(t) - 29) for t in texts)


def test_own_columns_stay_and_clashes_are_defined(frame):
    df = frame([(1, "abcdefgh" * 8), (2, "q")])
    for n in ("row", "data", "t1", "t2", "key", "ctx", "ships", "hits", "whole", "times"):
        df = df.withColumn(n, F.lit(f"mine {n}"))
    df = df.withColumn("n_removed", F.lit("replaced"))
    got = S.repeats(df, length=16, gram=4).orderBy("doc_id").collect()
    assert [r.key for r in got] == ["mine key"] * 2 and got[0].row == "mine row" and got[0].n_removed == 64
    assert [(s.start, s.end) for s in got[0].spans] == [(0, 64)] and bytes(got[1].kept) == b"q"


def test_layout_does_not_matter(documents):
    one, other = (S.repeats(documents.repartition(n).select("doc_id", "text"), digest=True).drop("spans") for n in (2, 9))
    assert one.exceptAll(other).count() == 0 and one.where("n_removed > 0").count() > 0
