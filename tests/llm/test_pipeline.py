import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pagesearch.llm import bpe  # noqa: E402
from pagesearch.llm.catalog import tokenizer_path  # noqa: E402
from tests.llm.conftest import DOC  # noqa: E402
from tests.llm.test_decontaminate import plain as leaks  # noqa: E402
from tests.llm.test_linededup import plain as line_dedup  # noqa: E402
from tests.llm.test_simhash import groups_of  # noqa: E402


def write(spark, rows, items):
    """A folder with the two tables the pipeline reads, in the tests' shared folder."""
    from pagesearch.session import shared_dir
    at = shared_dir(spark, "tables")
    spark.createDataFrame(rows, DOC).write.parquet(os.path.join(at, "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(at, "benchmark.parquet"))
    return at


def test_stages_one_by_one_and_run_against_brute_force(spark):
    item = " ".join(f"question{i}" for i in range(30))
    body = {i: " ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)}
    rows = [(i, f"shared header line\n{body[i]}", "en", f"s{i % 8}", 0) for i in range(30)]
    rows += [(40, body[3], "en", "s9", 0), (41, body[4] + " " + item, "en", "s1", 0), (42, None, None, None, None),
             (43, "... 123 !!!", "en", "s1", 0), (44, body[3], None, "s2", 0), (None, "a row without id", "en", "s1", 0)]
    at = write(spark, rows, [(1, item), (2, None)])
    docs = spark.read.parquet(f"{at}/documents.parquet")
    # language: rows without a letter go, whatever was learned
    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    # lines: keep the first of each line on five sites or more
    lines = [(k, t) for k, t, *_ in line_dedup([(r[0], r[1], r[3]) for r in left], 5)]
    # near copies: the smallest id of each group
    ones = [(k, t) for k, t in lines if (k, plain_of(t), k) in [(a, p, b) for a, p, b in groups_of(lines)]]
    clean = [(k, t) for k, t in ones if k not in {x[0] for x in leaks(ones, [(1, item)])}]
    encoder = bpe.Encoder(tokenizer_path())
    want = sorted(((k, len(encoder.encode([t])[0]), bpe.sha256(t)) for k, t in clean), key=str)
    got = sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, at).collect()), key=str)
    assert got == want and len(want) == 31
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, at)
        assert now.columns == docs.columns


def plain_of(text):
    from tests.llm.test_simhash import plain_print
    return plain_print(text)


def test_empty_tables(spark):
    at = write(spark, [], [])
    assert corpus_pipeline.run(spark, at).count() == 0


