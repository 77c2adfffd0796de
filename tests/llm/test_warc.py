import base64
import gzip
import hashlib
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from pagesearch.llm import warc
from pagesearch.session import shared_dir

KIND = "page_id long, url string, html string"
PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/é ü%20\r\nX: y", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", "é🙂\x1f\x00 binary \r\n\r\n WARC/1.1"),
         (0, "late", "<p>two</p>"), (7, "x", "<p>two</p>"), (7, "x", "<p>two</p>"), (9, "big", "y" * 3_000_000), (None, "no id", "<p>one</p>"), (None, "no id", "alone"), (None, "no id", "alone")]


def plain(pages, least=0):
    out = []
    for page, _, html in pages:
        body = (html or "").encode()
        first = min((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
        refers = first if first is not None and page != first and len(body) >= least else None
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 9, 100])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, KIND).repartition(3)
    files = warc.write(pages, shared_dir(spark, "warc"), least)
    back = warc.read(spark, files)
    assert got(back) == plain(PAGES, least)
    assert files.agg(F.sum("records")).first()[0] == len(PAGES)
    # whole payloads and URLs come back
    kept = {(r.page_id, r.url): bytes(r.payload) for r in back.where("record_type = 'response'").collect()}
    assert kept[5, "u"].decode() == PAGES[4][2] and kept[9, "big"] == b"y" * 3_000_000
    assert {r.url for r in back.collect()} == {p[1] for p in PAGES}


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
def test_every_record_has_one_owner_at_any_split(spark, split):
    files = warc.write(spark.createDataFrame(PAGES[:8], KIND).coalesce(1), shared_dir(spark, "warc"))
    path, size = files.select("path", "bytes").first()
    fs, at = warc.filesystem(path)
    data = fs.open_input_file(at).read()
    rows = [r for lo in range(0, size, split) for r in warc.records_in(io.BytesIO(data), lo, lo + split)]
    assert len(rows) == 8
    assert sorted(((r[0], r[2], r[3], r[4], r[5]) for r in rows), key=str) == plain(PAGES[:8])
    if split >= 1000:
        assert got(warc.read(spark, files, False, split)) == plain(PAGES[:8])


def test_false_magic_and_other_members_are_passed_over():
    one = warc.member(warc.warc_record(1, "u", b"payload", None))
    other = gzip.compress(b"not a record")
    data = b"\x1f\x8b\x08 noise" + one + other + warc.MAGIC + b"\x00" * 40 + one + b"\x1f\x8b"
    assert [r[0] for r in warc.records_in(io.BytesIO(data), 0, len(data))] == [1, 1]
    with pytest.raises(ValueError):
        warc.parse(warc.warc_record(1, "u", b"payload", None).replace(b"payload", b"changed"))


def test_archives_are_plain_gzip_of_warc_records(spark):
    files = warc.write(spark.createDataFrame(PAGES[:1], KIND), shared_dir(spark, "warc"))
    path = files.where("records > 0").first().path
    fs, at = warc.filesystem(path)
    text = gzip.decompress(fs.open_input_file(at).read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"<p>one</p>\r\n\r\n")
    assert [x.base_name for x in fs.get_file_info(__import__("pyarrow").fs.FileSelector(os.path.dirname(at) + "/_draft"))] == []


def test_empty_and_extra_columns(spark):
    assert warc.round_trip(spark.createDataFrame([], KIND)).count() == 0
    d = spark.createDataFrame(PAGES[:2], KIND).withColumn("sha", F.lit(1)).withColumn("refers_to", F.lit(9)).withColumn("payload", F.lit("p"))
    assert got(warc.round_trip(d)) == plain(PAGES[:2])


def test_long_headers_and_payloads_over_many_reads(spark, tmp_path):
    rng = random.Random(8)
    noise = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=400_000))
    rows = [(1, "http://a/1", "one"), (2, "data:text/plain," + noise, "two"), (3, "http://a/3", noise * 4), (4, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: r for r in warc.round_trip(pages, f"file://{tmp_path}/w", payload=True).collect()}
    assert {k: (r.url, bytes(r.payload).decode()) for k, r in got.items()} == {k: (u, h or "") for k, u, h in rows}
    files = spark.createDataFrame([(f"file://{p}", p.stat().st_size) for p in (tmp_path / "w").glob("*.gz")], "path string, bytes long")
    assert warc.read(spark, files, split_bytes=300_000).count() == 4


def test_a_lost_record_is_an_error(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "v", "y")], "page_id long, url string, html string")
    monkeypatch.setattr(warc, "read", lambda spark, files, payload: spark.createDataFrame([(1,)], "page_id long"))
    with pytest.raises(RuntimeError, match="2 records were written, 1 read"):
        warc.round_trip(pages, f"file://{tmp_path}/w")
