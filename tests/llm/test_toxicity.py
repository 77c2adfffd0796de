import zlib

import numpy as np
from pyspark.sql import functions as F

from pagesearch.llm import toxicity
from pagesearch.llm.catalog import op10_toxicity
from tests.llm.conftest import ODD


def test_gradients_against_differences():
    i = toxicity.Inputs(["the quick brown fox jumps over", "a lazy dog and another é word " * 8, "", "one"])
    doc, start = toxicity.all_windows(i)
    lane, y = toxicity.lanes(i, doc, start), (np.arange(len(doc)) % 2).astype(float)
    net = toxicity.Network()
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    _, g = toxicity.gradients(net, i, lane, y)
    for name, p in net.p.items():
        flat = p.reshape(-1)
        for j in np.argsort(-np.abs(g[name].reshape(-1)))[:4]:
            old, losses = flat[j], []
            for e in (1e-4, -1e-4):
                flat[j] = old + e
                losses.append(toxicity.gradients(net, i, lane, y)[0])
            flat[j] = old
            assert abs((losses[0] - losses[1]) / 2e-4 - g[name].reshape(-1)[j]) < 2e-3 * max(0.01, abs(g[name].reshape(-1)[j])), name


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        s = toxicity.windows(n)
        covered = {w for a in s for w in range(a, min(n, a + toxicity.WINDOW))}
        assert covered == set(range(n)) and (n > 0) == bool(len(s))
        assert all(b - a == toxicity.STEP for a, b in zip(s, s[1:]))
        assert not len(s) or s[-1] < n or n <= toxicity.WINDOW


def test_a_text_scores_alike_alone_and_among_others():
    net = toxicity.Network()
    texts = ["some words of a text", "", "x " * 700, "é" * 5000, "another longer text with words " * 30]
    together = net.scores(texts)
    assert np.allclose(together, [net.scores([t])[0] for t in texts], atol=1e-5)
    i = toxicity.Inputs([texts[4]])
    logit, _, _ = net.window_logits(i)
    assert np.isclose(net.text_logits([texts[4]])[0], logit.max(), atol=1e-5)


def test_learns_words_and_word_beginnings(frame, spark):
    rng = np.random.default_rng(0)
    filler = [f"{a}{b}" for a in ("ba", "de", "ko", "lu", "mi", "nor") for b in ("lan", "ter", "sim", "dol", "ra", "pe", "x")]

    def text(bad):
        words = list(rng.choice(filler, rng.integers(20, 200)))
        for _ in range(3 if bad else 0):
            words.insert(int(rng.integers(0, len(words))), "awful" if rng.random() < 0.5 else "zzgrr" + str(rng.choice(filler)))
        return " ".join(words)
    rows = [(k, text(k % 5 == 0)) for k in range(500)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame(rows[:400]), labels)
    out = {r.doc_id: r for r in toxicity.scored(frame(rows), model).collect()}
    new = [k for k in range(400, 500)]
    assert np.mean([out[k].predicted == (k % 5 == 0) for k in new]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())


def test_held_out_labels_are_not_learned_from(spark, documents):
    from tests.llm.conftest import SF
    out = {r.doc_id: r for r in op10_toxicity(spark, SF).collect()}
    assert len(out) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in out.items())
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if out[r.doc_id].held_out]
    yes = [out[r.doc_id].score for r in labels if r.toxic]
    no = [out[r.doc_id].score for r in labels if not r.toxic]
    assert np.mean([a > b for a in yes for b in no]) > 0.75


def test_odd_rows_and_empty(frame, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(frame(ODD), none) is None
    assert {(r.score, r.predicted) for r in toxicity.scored(frame(ODD), None).collect()} == {(0.0, 0)}
    one = toxicity.fit(frame([(1, "only toxic rows"), (2, "")]), spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    out = toxicity.scored(frame(ODD), one).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not (r.text or "").split()}) == 1
    assert toxicity.scored(frame([]), one).count() == 0
    d = frame([(1, "a b")]).withColumn("score", F.lit("x")).withColumn("predicted", F.lit("y"))
    assert toxicity.scored(d, one).dtypes[-2:] == [("score", "double"), ("predicted", "int")]
