"""Embedding near-duplicates by an exact metric range join.

Cosine at least c between unit vectors means Euclidean distance at most
r = sqrt(2 - 2c).  Pivots partition the vectors of a label: the home of a
vector is the cell of its nearest pivot.  If x has its home at p and y lies
nearer to another pivot q, then every path from y to x crosses the plane
halfway between p and q, so |x - y| >= y.(q - p) / |p - q|; the triangle
inequality d(y, p) - d(y, q) <= 2r follows from the same picture.  So y is
replicated to exactly those cells p for which no pivot q shows a distance
beyond r, and the cells join independently.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesearch.llm import cells
from pagesearch.llm.components import components
from pagesearch.llm.frames import record
from pagesearch.session import materialize

COSINE = 0.93
PIVOTS = 8             # a label
PIVOT_SHARE = 0.001    # of the vectors: labels with fewer make one cell, so at most 1000 labels have pivots
PART_HOMES = 2048
_SLACK = 1e-9
_CELL = ["label", "dim", "pivot"]


def usable(vector: str):
    """Not null, no null or non-finite component, not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(batch, dim: int) -> np.ndarray:
    """The vectors as unit rows, padded with zeros to ``dim``."""
    column = batch.column("vector")
    out = np.zeros((len(column), dim))
    size = np.diff(column.offsets.to_numpy())
    out[np.arange(dim)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, keepdims=True)     # no overflow or underflow in the squares
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _unit(v: list[float], dim: int) -> np.ndarray:
    x = np.zeros(dim)
    x[: len(v)] = v
    x /= np.abs(x).max()
    return x / np.linalg.norm(x)


def choose_pivots(distinct: DataFrame, total: int) -> dict[tuple[int, int], list[list[float]]]:
    """For each (label, dim) with at least 0.1 % of the vectors, the ``PIVOTS``
    vectors with the smallest hash."""
    common = (distinct.groupBy("label", "dim").agg(F.sum("copies").alias("n"))
              .where(F.col("n") >= max(2, PIVOT_SHARE * total)).select("label", "dim"))
    rank = F.row_number().over(Window.partitionBy("label", "dim").orderBy("id"))
    ids = distinct.select("label", "dim", "id").withColumn("r", rank).where(F.col("r") <= PIVOTS).drop("r")
    rows = distinct.join(ids.join(common, ["label", "dim"], "left_semi"), ["label", "dim", "id"], "left_semi")
    out: dict[tuple[int, int], list[list[float]]] = {}
    for r in rows.orderBy("label", "dim", "id").select("label", "dim", "vector").collect():
        out.setdefault((r.label, r.dim), []).append(r.vector)
    return out


def near_groups(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding",
                label: str = "label") -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept.

    Vectors of equal label and length are linked when their cosine in double
    precision is at least ``cosine``.  n_links counts the other vectors linked
    directly, copies included; component_id is the smallest key that can be
    reached, the vector itself included; kept tells whether that is its own.  A
    null label, or a vector that is null, empty, zero or holds a null or
    non-finite component, links with nothing (0, its own key, kept).  A null
    key is passed over when the smallest is taken.  Repeated rows are copies.
    Extra columns are not read; an empty table gives no rows.

    Equal vectors are reduced to one with a weight before the join.  All rows
    are joined; only the choice of pivots looks at a bounded sample.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    ok = usable("vector") & F.col("label").isNotNull()
    dim = F.size("vector")
    node = F.xxhash64("label", "vector")
    marked = v.select("key", F.when(ok, node).alias("id"))
    distinct = materialize(v.where(ok).groupBy("label", "vector").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"))
                           .select("label", dim.alias("dim"), node.alias("id"), "vector", "least", "copies"), "vectors")
    total, width = distinct.agg(F.sum("copies"), F.max("dim")).first()
    if not total:
        return marked.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    pivots = spark.sparkContext.broadcast(choose_pivots(distinct, total))
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    schema = T.StructType([distinct.schema["label"], T.StructField("dim", T.IntegerType()), T.StructField("pivot", T.IntegerType()),
                           T.StructField("id", T.LongType()), T.StructField("copies", T.LongType()), distinct.schema["vector"]])

    def placed(visit: bool):
        def run(batches):
            planes: dict = {}
            for batch in batches:
                x = _matrix(batch, width)
                of = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
                rows: list[np.ndarray] = []
                cell: list[np.ndarray] = []
                for group in set(of):
                    at = np.array([i for i, g in enumerate(of) if g == group])
                    if group not in planes:
                        p = np.stack([_unit(a, width) for a in pivots.value.get(group, [[1.0]])])
                        planes[group] = p, np.linalg.norm(p[:, None] - p[None], axis=2)
                    p, apart = planes[group]
                    near = x[at] @ p.T
                    if visit:
                        with np.errstate(divide="ignore", invalid="ignore"):
                            beyond = (near[:, None, :] - near[:, :, None]) / apart[None]     # [y, p, q]
                        r, c = np.nonzero(~(beyond > radius + _SLACK).any(axis=2))
                    else:
                        r, c = np.arange(len(at)), near.argmax(axis=1)
                    rows.append(at[r])
                    cell.append(c)
                if not rows:
                    continue
                take, name = np.concatenate(rows), np.concatenate(cell)
                for lo in range(0, len(take), 4096):
                    t = take[lo : lo + 4096]
                    b = batch.take(t)
                    yield record(schema, [b.column("label"), b.column("dim"), name[lo : lo + 4096].astype(np.int32), b.column("id"), b.column("copies"), b.column("vector")])
        return distinct.select("label", "dim", "id", "copies", "vector").mapInArrow(run, schema)

    rows = cells.spread(placed(False), placed(True), _CELL, PART_HOMES)
    scanned = materialize(cells.scan(rows, _CELL, lambda b: _matrix(b, width), lambda h, y: y @ h.T >= cosine, weight="copies"), "embedding-links")
    roots = components(scanned.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "id")
    counts = scanned.where("n IS NOT NULL").select(F.col("a").alias("id"), (F.col("n") - 1).alias("n_links"))
    classes = distinct.select("id", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    known = classes.join(least, "root").join(counts, "id").select("id", "n_links", "component_id")
    alone = F.col("id").isNull()
    component = F.when(alone, F.col("key")).otherwise(F.col("component_id"))
    return marked.join(known, "id", "left").select(
        F.col("key").alias(key), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)
"""
