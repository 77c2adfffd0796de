"""Work of the streamed ingest and index that must not grow beyond its input."""

import os

from pagesearch.operators import index as ix
from pagesearch.operators import ingest as ing
from pagesearch.operators import language as lg
from pagesearch.schemas import CAPTURES, LINKS
from pagesearch.streaming import ingest as si
from tests.conftest import rows
from tests.test_index_search import _plan
from tests.test_segments import built, documents, tables


def _inputs(spark, n=12):
    links = spark.createDataFrame([(f"http://h{i % 3}.example.com/{i}", f"f{i % 2}", f"saved {i}", i) for i in range(n)], LINKS)
    caps = spark.createDataFrame([(f"http://h{i % 3}.example.com/{i}", 1, "http", 200, f"<html><title>t{i}</title><body><p>the cat {i}</p></body></html>")
                                  for i in range(n)], CAPTURES)
    prof = lg.train_profiles(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de")], "text string, lang string"))
    return links, caps, prof


def test_pages_are_extracted_once(spark):
    links, caps, prof = _inputs(spark)
    out = ing.build_store(spark, links, caps, prof)
    plan = _plan(out)
    assert "regexp" not in plan and "min_by" not in plan           # what follows extraction reads its rows
    assert rows(out, "title", "text") == sorted((f"t{i}", f"the cat {i}") for i in range(12))


def test_grams_of_one_vocabulary_are_made_by_several_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    monkeypatch.setattr(ix, "TERMS_PER_TASK", 5)
    ix.write_index(built(documents(spark, range(60), 1), co_locate=True), path)
    files = [f for f in os.listdir(f"{path}/grams/seg=1/field=text") if f.endswith(".parquet")]
    stored = ix.read_index(spark, path)
    assert stored.term_df.count() > 20 and len(files) >= 4
    assert rows(stored.grams, "gram", "term") == rows(ix.vocabulary.gram_keys(stored.term_df), "gram", "term")


def test_later_batches_are_built_in_the_buckets_of_the_index(spark, tmp_path, monkeypatch):
    links, caps, prof = _inputs(spark)
    sizes, found = iter([3, 5]), []
    build = ix.build_index

    def spy(*args, **how):
        with monkeypatch.context() as m:
            m.setattr(ix, "expand_partitions", lambda df, n=next(sizes): n)
            found.append(build(*args, **how))
        return found[-1]
    monkeypatch.setattr(si, "build_index", spy)
    for batch in (0, 1):
        si.ingest_batch(spark, links.where(f"seq % 2 = {batch}"), batch, str(tmp_path / "root"), caps, prof)
    assert [i.buckets for i in found] == [3, 3]                     # other buckets: all postings shuffled
    assert si.current_postings(spark, str(tmp_path / "root")).select("doc_id").distinct().count() == 12


def test_a_merge_waits_for_enough_segments(spark, tmp_path):
    path = str(tmp_path / "i")
    ix.write_index(built(documents(spark, range(20), 1), co_locate=True), path)
    ix.refresh_index(spark, path, built(documents(spark, range(20, 40), 2)))
    assert ix.merge_index(spark, path, least=3) == 0
    ix.refresh_index(spark, path, built(documents(spark, range(35, 60), 3)))
    now = documents(spark, range(20), 1).union(documents(spark, range(20, 40), 2).where("doc_id < 35")).union(documents(spark, range(35, 60), 3))
    assert ix.merge_index(spark, path, least=3) == 3
    assert len(ix._version_meta(spark, path)["segments"]) == 1
    assert tables(ix.read_index(spark, path)) == tables(built(now))
