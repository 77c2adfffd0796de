"""Comparison inside the cells of a covering.

Every item is a *home* row in one cell and a *visitor* row in each cell where
it may have a partner.  Each home row meets all visitors of its cell, so links
are found cell by cell with no join output.  A cell with many homes is cut
into parts of about ``part_homes`` homes, each of which sees all visitors of
the cell; visitors are streamed, so a task holds one part's homes and one
Arrow batch, however large a cell is.  Links are returned as a spanning set:
enough of them to connect whatever is linked, at most one for each visitor and
one for each home of a part, and never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesearch.llm.frames import record
from pagesearch.session import materialize

SCANNED = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()),
                        T.StructField("n", T.LongType())])
_BLOCK = 1 << 21


def spread(homes: DataFrame, visitors: DataFrame, cell: list[str], part_homes: int) -> DataFrame:
    """Rows of both kinds with columns ``part`` and ``visitor``, dealt by
    (cell, part) and sorted so that a part's homes come before its visitors.
    Both frames have the cell columns, ``id`` and the same payload columns."""
    large = materialize(homes.groupBy(*cell).agg(F.count(F.lit(1)).alias("homes"))
                        .where(F.col("homes") > part_homes)
                        .select(*cell, F.ceil(F.col("homes") / part_homes).cast("int").alias("parts")), "cells")
    n = F.coalesce("parts", F.lit(1))
    h = homes.join(large, cell, "left").withColumn("part", F.pmod(F.xxhash64("id"), n).cast("int"))
    v = visitors.join(large, cell, "left").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = (h.withColumn("visitor", F.lit(False)).drop("parts")
            .unionByName(v.withColumn("visitor", F.lit(True)).drop("parts")))
    return rows.repartition(*cell, "part").sortWithinPartitions(*cell, "part", "visitor")


def scan(rows: DataFrame, cell: list[str], payload: Callable, match: Callable,
         weight: str | None = None) -> DataFrame:
    """Rows (a, b, null) for links and, with ``weight``, one row (a, null, n)
    for each home a: the summed weights of its partners, itself included.

    ``payload(batch)`` gives an array with one entry a row, ``match(h, v)`` the
    boolean matrix visitors x homes."""
    keys = [*cell, "part"]

    def run(batches):
        now, part = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], axis=1)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            visitor = batch.column("visitor").to_numpy(zero_copy_only=False)
            load = payload(batch)
            weights = batch.column(weight).to_numpy(zero_copy_only=False) if weight else None
            cut = np.concatenate(([0], 1 + np.flatnonzero((key[1:] != key[:-1]).any(axis=1)), [len(ids)]))
            n_homes = np.add.reduceat(~visitor, cut[:-1])
            out: list[tuple] = []
            for g in range(len(cut) - 1):
                lo, hi = cut[g], cut[g + 1]
                inner = 0 < g < len(cut) - 2
                # a lone home with only itself as visitor, or no home at all
                if inner and not weight and (n_homes[g] == 0 or hi - lo == 2):
                    continue
                k = tuple(key[lo])
                if k != now:
                    if part:
                        out += part.counts()
                    now, part = k, _Part(match, weight is not None)
                mid = lo + n_homes[g]
                part.add(ids[lo:mid], load[lo:mid])
                out += part.meet(ids[mid:hi], load[mid:hi], weights[mid:hi] if weight else None)
            if out:
                yield record(SCANNED, list(zip(*out, strict=True)))
        if part and (last := part.counts()):
            yield record(SCANNED, list(zip(*last, strict=True)))

    return rows.mapInArrow(run, SCANNED)


class _Part:
    """The homes of a part, how they are connected so far, and their counts."""

    def __init__(self, match, counted: bool):
        self.match, self.counted = match, counted
        self.ids, self.load, self.label, self.total = np.zeros(0, np.int64), None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids, load) -> None:
        if len(ids):
            self.ids = np.concatenate((self.ids, ids))
            self.load = load.copy() if self.load is None else np.concatenate((self.load, load))
            self.label = np.arange(len(self.ids))
            self.total = np.zeros(len(self.ids), np.int64)

    def meet(self, ids, load, weights) -> list[tuple]:
        out: list[tuple] = []
        if self.load is None:
            return out
        step = max(1, _BLOCK // len(self.ids))
        for lo in range(0, len(ids), step):
            hit = self.match(self.load, load[lo : lo + step])
            if self.counted:
                self.total += weights[lo : lo + step] @ hit
            one = hit.any(axis=1)
            for r in np.flatnonzero(one):
                homes = np.flatnonzero(hit[r])
                labels, at = np.unique(self.label[homes], return_index=True)
                me = int(ids[lo + r])
                linked = [int(self.ids[h]) for h in homes[at]]
                if len(labels) > 1:
                    self.label[np.isin(self.label, labels)] = labels[0]
                    out += [(me, x, None) for x in linked if x != me]
                elif linked[0] != me:
                    out.append((me, linked[0], None))
        return out

    def counts(self) -> list[tuple]:
        return [(int(a), None, int(n)) for a, n in zip(self.ids, self.total, strict=True)] if self.counted else []
