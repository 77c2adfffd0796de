import math

import numpy as np
from pyspark.sql import functions as F

from pagesearch.llm import embeddings
from tests.llm.conftest import SF

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, least=0.93):
    ok = [v is not None and len(v) > 0 and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v, _), o in zip(rows, ok)]
    n, group = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                if group[i] != group[j]:
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
    low = [min((k for (k, _, _), g in zip(rows, group) if g == group[i] and k is not None), default=None) if ok[i] else rows[i][0] for i in range(len(rows))]
    return sorted(((r[0], n[i], low[i], r[0] == low[i]) for i, r in enumerate(rows)), key=str)


def run(df):
    return sorted((tuple(r) for r in embeddings.near_groups(df).collect()), key=str)


def test_table_against_brute_force(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert run(e) == plain([tuple(r) for r in e.select("vec_id", "embedding", "label").collect()])


def test_clusters_copies_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    rows = [(i, (centre[i % 6] + rng.normal(size=16) * 0.28).astype("f4").tolist(), int(i % 2)) for i in range(240)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]                       # copies of one vector
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [math.nan] * 16, 1), (2004, [math.inf] + [0.0] * 15, 1), (2005, [None] + [1.0] * 15, 1),
             (2006, rows[0][1], None), (None, rows[1][1], 1), (2007, rows[0][1][:8], 0), (2008, rows[0][1][:8], 0), (2009, [1e-30] * 16, 0), (2010, [1e30] * 16, 0)]
    want = plain(rows)
    df = spark.createDataFrame(rows, KIND)
    assert run(df) == want
    monkeypatch.setattr(embeddings, "PART_HOMES", 7)        # every cell in many parts
    assert run(df) == want
    monkeypatch.setattr(embeddings, "PIVOTS", 3)
    assert run(df) == want


def test_pairs_on_the_boundary_of_cells(spark):
    """A ring of vectors, each linked with the next alone: links cross every boundary."""
    step = math.acos(0.93) * 0.999
    n = int(2 * math.pi / step)
    rows = [(i, [math.cos(i * step), math.sin(i * step)], 0) for i in range(n)]
    got = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got == plain(rows) and {r[2] for r in got} == {0}


def test_empty_and_clashing_columns(spark):
    assert run(spark.createDataFrame([], KIND)) == []
    assert run(spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], KIND)) == [(1, 0, 1, True), (2, 0, 2, True)]
    d = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)], KIND).withColumn("id", F.lit("x")).withColumn("kept", F.lit(5)).withColumn("cell", F.lit(1))
    assert run(d) == [(1, 1, 1, True), (2, 1, 1, False)]
