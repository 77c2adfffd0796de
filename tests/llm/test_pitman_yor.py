import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from pagesearch.llm import pitman_yor as py
from pagesearch.llm.catalog import op6_pitman_yor
from tests.llm.conftest import ODD, SF

END = object()


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def base_of(rows, train):
    c = Counter()
    for k, t in rows:
        if train(k):
            c.update(tokens(t))
    n, v = c.total(), len(c)
    return sorted(((k, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for k, t in rows), key=str)


def counted(df):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=str)


def test_counts_and_base_and_perplexity_of_documents(spark, documents):
    out = op6_pitman_yor(spark, SF).cache()
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert counted(out) == base_of(rows, lambda k: zlib.crc32(str(k).encode()) % 5 != 1)
    p = {r.train: r for r in py.perplexity(out.withColumn("train", ~F.col("held_out"))).collect()}
    assert p[False].perplexity < p[False].base_perplexity
    assert all(r.score < 0 for r in out.collect())


def stirling(c, d):
    """Weights of t tables: sums over all seatings of c customers of one dish."""
    s = {1: 1.0}
    for k in range(1, c):
        new = {}
        for t, w in s.items():
            new[t] = new.get(t, 0) + w * (k - d * t)
            new[t + 1] = new.get(t + 1, 0) + w
        s = new
    return s


def test_seating_has_the_exact_distribution():
    rng = np.random.default_rng(0)
    d, many = 0.6, 40_000
    for c, a, p in product((2, 5, 12), (3.0, 40.0), (0.02, 0.4)):
        state = None
        got = Counter()
        for _ in range(12):
            new = py.seat(np.full(many, c), np.full(many, a), np.full(many, p), d, rng)
            state = py.accept(state, new, rng)
        got = np.bincount(state[0], minlength=c + 1) / many
        weight = {t: w * math.prod((a + d * i) * p for i in range(t)) for t, w in stirling(c, d).items()}
        want = np.array([weight.get(t, 0) / sum(weight.values()) for t in range(c + 1)])
        assert np.abs(got - want).max() < 0.012, (c, a, p)


def test_large_dishes_take_few_steps():
    t, w = py.seat(np.array([10**9, 1, 0]), np.full(3, 1e6), np.full(3, 1e-3), 0.8, np.random.default_rng(0))
    assert t[1:].tolist() == [1, 0] and 1000 < t[0] < 10**8 and np.isfinite(w).all()


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    dish, context = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(-1, 4), indexing="ij"))
    count = rng.poisson(3, len(dish))
    keep = count > 0
    dish, context, count = dish[keep], context[keep], count[keep]
    guests = np.bincount(context[context >= 0], count[context >= 0], 4)
    nobody = np.zeros(5)
    s = py.sample(dish, context, count, 30, py.Totals(np.append(guests, count.sum()).astype(float), nobody, nobody, 30), rng)
    m = {"contexts": np.arange(4), "v": 30, "root_tables": s["root_tables"], "root_customers": s["root_customers"], "tables": s["tables"], "guests": guests}
    for c in range(-1, 4):
        pair = np.zeros(31)
        at = context == c
        if c >= 0:
            pair[dish[at]] = s["pair"][at]
        p = py.probabilities(m, np.arange(31) < 30, np.append(s["root"], 0), np.full(31, c), pair)
        assert np.isclose(p.sum(), 1, atol=1e-6) and (p > 0).all()


def test_odd_rows(frame):
    rows = [*ODD, (20, "The the THE of of a one")]
    train = lambda k: k is not None and k % 2 == 0
    out = py.scored(frame(rows), F.col("doc_id") % 2 == 0)
    assert counted(out) == base_of(rows, train)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out.collect())
    assert py.scored(frame([]), F.lit(True)).count() == 0
    nobody = py.scored(frame(rows), F.lit(None).cast("boolean"))
    assert counted(nobody) == base_of(rows, lambda k: False)


def test_hot_and_cold_words_and_many_blocks_agree_on_counts(frame, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 53}" if j % 3 else "hot" for j in range(60))) for i in range(200)]
    want = base_of(rows, lambda k: k % 5 != 1)
    for hot, context in ((10**9, 2.0), (500, 0.1), (1, 0.01)):
        monkeypatch.setattr(py, "DISH", hot)
        monkeypatch.setattr(py, "CONTEXT_SHARE", context)
        monkeypatch.setattr(py, "BLOCK_CHARS", 3000)
        d = frame(rows).withColumn("block", F.lit("x")).withColumn("train", F.lit(3)).withColumn("id", F.lit(1))
        out = py.scored(d, F.col("doc_id") % 5 != 1)
        assert counted(out) == want
        # the strong discounts, meant for open vocabularies, cost something on 54 words
        assert sum(r.score for r in out.collect()) > 1.15 * sum(r.base_score for r in out.collect())


def test_rare_contexts_have_restaurants_of_their_own(frame):
    """800 words of 0.12 % of the tokens each; every other one is always followed by the same word."""
    rows = [(i, " ".join(f"c{(7 * i + j) % 400} f{(7 * i + j) % 400}" for j in range(40))) for i in range(300)]
    # the same words in an order not met, so that the contexts alone make the difference
    rows += [(1000, " ".join(f"c{j} f{j}" for j in range(100))), (1001, " ".join(f"c{j} f{j + 7}" for j in range(100)))]
    score = {r.doc_id: r.score for r in py.scored(frame(rows), F.col("doc_id") < 1000).collect()}
    assert score[1000] > score[1001] + 50


def test_scores_do_not_hang_on_the_layout(spark, documents, monkeypatch):
    monkeypatch.setattr(py, "DISH", 3000)          # a few words in several dishes
    monkeypatch.setattr(py, "PART", 20_000)
    monkeypatch.setattr(py, "BLOCK_CHARS", 60_000)
    got = [{r.doc_id: r.score for r in py.scored(documents.repartition(k), F.col("doc_id") % 5 != 1).collect()} for k in (4, 16)]
    assert len(got[0]) == documents.count()
    assert all(math.isclose(got[0][k], got[1][k], rel_tol=1e-9) for k in got[0])


def test_packed_arrays_come_back(spark):
    for a in (np.zeros(0, np.int64), np.array([0, 255, 256, 2**40]), np.array([2**64 - 1], np.uint64), np.array([0.5, -2.25])):
        b, c = py.unpacked(py.packed(a, a))
        assert b.tolist() == a.tolist() == c.tolist()
