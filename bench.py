"""Bench: build the inverted index of `documents` at $BENCH_SF_DIR, run a
batch of 100 mixed ranked queries over the stored index, and time the other
headline jobs (ingest, extraction, language detection, highlight, stream).

Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
Every job is forced with the no-op sink, so all columns are computed and
nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pagesearch.operators import index as ix  # noqa: E402
from pagesearch.operators import search as se  # noqa: E402
from pagesearch.plans.catalog import CATALOG  # noqa: E402
from pagesearch.plans.corpus import build_documents_index  # noqa: E402
from pagesearch.session import ensure_checkpoint_dir, get_spark, shared_dir  # noqa: E402
from pagesearch.sources import fixtures as fx  # noqa: E402


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def mixed_batch(terms: list[str], n: int = 100) -> tuple[list, list]:
    """100 queries of every clause kind over frequent index terms."""
    rows, opts = [], []

    def c(q, cid, occur, kind, t, field="text", **kw):
        rows.append((q, cid, occur, kind, field, t, kw.get("min"), kw.get("max"), kw.get("incl_min"),
                     kw.get("incl_max"), kw.get("fuzz"), kw.get("plen"), kw.get("boost", 1.0)))
    for q in range(1, n + 1):
        a, b, d = terms[q % len(terms)], terms[(q * 7 + 3) % len(terms)], terms[(q * 13 + 5) % len(terms)]
        kind = q % 10
        if kind == 0:
            c(q, 1, "should", "term", [a])
        elif kind == 1:
            c(q, 1, "should", "term", [a], boost=2.0); c(q, 2, "should", "term", [b]); c(q, 3, "should", "term", [d])
        elif kind == 2:
            c(q, 1, "must", "term", [a]); c(q, 2, "must_not", "term", [b])
        elif kind == 3:
            c(q, 1, "should", "match_phrase", [f"{a} {b}"])
        elif kind == 4:
            c(q, 1, "should", "phrase", [a, None, b])
        elif kind == 5:
            c(q, 1, "should", "prefix", [a[:3]])
        elif kind == 6:
            c(q, 1, "should", "match", [a], fuzz=1, plen=1)
        elif kind == 7:
            c(q, 1, "should", "wildcard", [a[:2] + "*" + a[-1:]])
        elif kind == 8:
            c(q, 1, "must", "numeric_range", None, "n_chars", min=500.0, max=5000.0); c(q, 2, "should", "term", [a])
        else:
            c(q, 1, "should", "match", [f"{a} {b} {d}"])
        opts.append((q, 2 if kind == 1 else 0, 10, 0))
    return rows, opts


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    ensure_checkpoint_dir(spark)

    # warm-up on the smallest tables: JVM start, class loading and JIT of the
    # code paths are not part of any timed query
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        run_all(spark, warm, {})
    times: dict[str, float] = {}
    run_all(spark, sf_dir, times)

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else sf_dir}))
    spark.stop()


def run_all(spark, sf_dir: str, times: dict) -> None:
    def timed(name, fn):
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)

    path = shared_dir(spark, "bench-index")
    timed("index_build", lambda: ix.write_index(build_documents_index(spark, sf_dir, co_locate=True), path))
    stored = ix.read_index(spark, path)

    frequent = (stored.term_df.where(F.length("term") >= 4).orderBy(F.col("df").desc(), "term")
                .limit(60).collect())
    terms = [r.term for r in frequent if re.fullmatch(r"[a-z]+", r.term)] or ["the"]
    rows, opts = mixed_batch(terms)
    clauses, qopts = fx.clauses(spark, rows), fx.query_opts(spark, opts)
    timed("search_100", lambda: force(se.search(stored, clauses, qopts)))

    for name in ["q_batch", "doc_build", "page_text", "boilerplate_blocks", "lang_detect",
                 "highlight", "fetch_slots", "change_ticks"]:
        timed(name, lambda n=name: force(CATALOG[n](spark, sf_dir)))


if __name__ == "__main__":
    main()
