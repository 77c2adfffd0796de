from pyspark.sql import functions as F

from pagesearch.llm import linededup
from tests.llm.conftest import ODD


def plain(rows, min_sites):
    sites, first = {}, {}
    for key, text, site in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\r\f\v"):
                sites.setdefault(line, set()).update([site] if site is not None else [])
                at = (key is not None, key or 0, pos)
                first[line] = min(first.get(line, at), at)
    out = []
    for key, text, _ in rows:
        keep = [x for pos, x in enumerate((text or "").split("\n"))
                if not x.strip(" \t\r\f\v") or len(sites[x]) < min_sites or first[x] == (key is not None, key or 0, pos)]
        out.append((key, None if text is None else "\n".join(keep), len((text or "").split("\n")), len((text or "").split("\n")) - len(keep)))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted((tuple(r) for r in linededup.without_boilerplate(df, **kw).select("doc_id", "text", "n_lines", "n_removed").collect()), key=str)


def test_against_brute_force(frame):
    rows = [(i, f"header\nbody {i}\n\nfooter {i % 3}\nheader", "en", f"s{i % 7}") for i in range(40)]
    rows += [(50 + i, "header\nrare", "en", "s1") for i in range(4)] + [(60, None, None, "s2"), (61, "", None, None), (None, "header\nnull key", None, None)]
    for n in (2, 5, 7, 8):
        assert run(frame(rows), min_sites=n) == plain([(r[0], r[1], r[3]) for r in rows], n)


def test_near_threshold_lines_are_counted_exactly(frame):
    rows = [(i, "at the edge\nabove", "en", f"s{i}") for i in range(30)] + [(100 + i, "above", "en", f"t{i}") for i in range(30)]
    for n in (29, 30, 31, 60, 61):
        assert run(frame(rows), min_sites=n) == plain([(r[0], r[1], r[3]) for r in rows], n)


def test_odd_rows_and_empty(frame):
    rows = [(*r, "en", "s") for r in ODD]
    assert run(frame(rows), min_sites=1) == plain([(r[0], r[1], r[3]) for r in rows], 1)
    assert run(frame([])) == []


def test_other_columns_are_kept(frame):
    d = frame([(1, "a\nb", "en", "s")]).withColumn("n_removed", F.lit("x")).withColumn("first", F.lit(3)).withColumn("key", F.lit(4))
    out = linededup.without_boilerplate(d)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "first", "key", "n_lines", "n_removed"]
    assert out.first().asDict() | {"n_chars": None} == {"doc_id": 1, "text": "a\nb", "lang": "en", "source": "s", "n_chars": None, "first": 3, "key": 4, "n_lines": 2, "n_removed": 0}


def test_one_line_in_a_third_of_all_rows(frame):
    rows = [(i, "hot line\nown line %d" % i if i % 3 == 0 else "own %d" % i, "en", f"s{i % 20}") for i in range(900)]
    out = linededup.without_boilerplate(frame(rows))
    assert out.where("n_removed = 1").count() == 299


def test_columns_of_any_name_stay(frame):
    docs = frame([(i, f"same line\nown {i}", None, f"s{i % 6}") for i in range(12)])
    names = ["_row", "_lines", "_cut", "_key", "_version", "_null", "own", "key", "version", "lines", "none", "cut", "of_key", "first", "h1"]
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    docs = docs.withColumn("n_lines", F.lit("replaced"))
    out = linededup.without_boilerplate(docs).collect()
    assert all(r[n] == n for r in out for n in names)
    assert sorted(r.n_removed for r in out) == [0] + [1] * 11 and {r.n_lines for r in out} == {2}
