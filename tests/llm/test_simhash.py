import numpy as np
import xxhash
from pyspark.sql import functions as F

from pagesearch.llm import simhash
from pagesearch.llm.components import components
from tests.llm.conftest import ODD


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(rows, bits=2):
    prints = [plain_print(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = [min((k for (k, _), m in zip(rows, label) if m == g and k is not None), default=None) for g in label]
    return sorted(((k, p, m) for (k, _), p, m in zip(rows, prints, least)), key=str)


def test_odd_rows_against_brute_force(frame):
    got = simhash.near_groups(frame(ODD)).collect()
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=str) == groups_of(ODD)


def test_documents_against_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = simhash.near_groups(documents).collect()
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=str) == groups_of(rows)


def test_every_pair_within_the_threshold_meets_at_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 400, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 3), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    row, home = simhash.anchors(x, 0)
    assert row.tolist() == list(range(len(x)))
    visits = set(zip(*(a.tolist() for a in simhash.anchors(y, 2))))
    assert all((i, a) in visits for i, a in enumerate(home.tolist()))


def test_hot_group_is_split_into_parts_and_stays_whole(spark, frame, monkeypatch):
    monkeypatch.setattr(simhash, "PART_HOMES", 4)
    rows = [(i, "the same long text of a group of copies " * 5) for i in range(300)]
    got = simhash.near_groups(frame(rows)).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]
    # distinct fingerprints close together: a chain of single-bit changes inside one cell
    fps = [(1 << b) - 2**63 for b in range(12)] + [-2**63]
    d = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fingerprint long")
    place, schema = simhash._placed(0)
    visit, _ = simhash._placed(2)
    f = d.select("fingerprint")
    rows = simhash.cells.spread(f.mapInArrow(place, schema), f.mapInArrow(visit, schema), ["cell"], 4)
    links = simhash.cells.scan(rows, ["cell"], simhash._payload, simhash._within(2))
    roots = components(links.select("a", "b")).select("root").distinct().collect()
    assert [r[0] for r in roots] == [min(fps)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(5, 5), (1, 0), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_and_empty(frame):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "quite another text with its own words"), (4, None), (5, ""), (None, "")]
    assert sorted(r.doc_id for r in simhash.keep_one(frame(rows)).collect()) == [1, 3, 4]
    assert simhash.keep_one(frame(rows)).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert simhash.near_groups(frame([])).count() == 0


def test_extra_columns_with_clashing_names(frame):
    d = frame([(1, "a b c"), (2, "a b c")]).withColumn("fingerprint", F.lit("x")).withColumn("component_id", F.lit(9)).withColumn("cell", F.lit(1))
    assert sorted((r[0], r[2]) for r in simhash.near_groups(d).collect()) == [(1, 1), (2, 1)]
    assert [(r.doc_id, r.fingerprint) for r in simhash.keep_one(d).collect()] == [(1, "x")]


def test_kept_rows_keep_columns_of_any_name(frame):
    docs = frame([(1, "a b c d"), (2, "a b c d"), (3, "other words here now")])
    for n in ("kept", "_kept", "KEPT_", "fingerprint", "component_id"):
        docs = docs.withColumn(n, F.lit(n))
    out = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in out) == [1, 3] and all(r._kept == "_kept" and r.fingerprint == "fingerprint" for r in out)
