import zlib

from pyspark.sql import functions as F

from pagesearch.llm import langid
from tests.llm.conftest import ODD


def greedy(text: bytes, data: bytes) -> int:
    """Longest phrases of ``text`` that occur in ``data``."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j + 1] in data:
            j += 1
        i, n = j, n + 1
    return n


def parser_of(texts):
    models = []
    for lang, data in texts.items():
        a, b, c = langid.suffix_automaton(data)
        models.append((lang, len(data), a.tobytes(), b.tobytes(), c.tobytes()))
    return langid.Parser(models)


def test_phrases_against_brute_force(documents):
    rows = [langid.normalise(r.text) for r in documents.orderBy("doc_id").limit(60).collect()]
    data = {"a": rows[0][:3000], "b": b"\n".join(rows[1:4])[:3000]}
    got = parser_of(data).phrases([*rows[4:], b"", b"q", data["a"]])
    for k, d in enumerate(data.values()):
        assert got[k].tolist() == [greedy(t, d) for t in [*rows[4:], b"", b"q", data["a"]]]


def test_phrases_run_over_lanes(monkeypatch):
    import random
    rng = random.Random(4)
    data = {"a": bytes(rng.choices(b"ab ", k=400)), "b": b"".join(rng.choices([b"the ", b"of ", b"and ", b"a"], k=120))}
    texts = [data["a"], data["a"] * 2, data["b"][7:] + data["a"][3:], b"", b"z" * 50, data["b"] * 3]
    texts += [bytes(rng.choices(b"ab the", k=rng.randint(0, 300))) for _ in range(60)]
    for lane in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "SEGMENT", lane)
        got = parser_of(data).phrases(texts)
        for k, d in enumerate(data.values()):
            assert got[k].tolist() == [greedy(t, d) for t in texts]
    assert parser_of({"x": data["a"]}).phrases([data["a"]]).tolist() == [[1]]


def test_languages_in_groups_equal_all_at_once(monkeypatch):
    texts = {f"l{i}": bytes([97 + i, 32, 98 + i]) * 30 for i in range(7)}
    models = [(lang, len(d), *(x.tobytes() for x in langid.suffix_automaton(d))) for lang, d in texts.items()]
    some = ["a b c", "g h i g h i", None, "ccc ddd"]
    monkeypatch.setattr(langid, "TOGETHER", 100)
    whole = langid.Parsers(models).detect(some)
    monkeypatch.setattr(langid, "TOGETHER", 2)
    assert langid.Parsers(models).detect(some) == whole


def test_held_out_accuracy(documents):
    models = langid.fit(langid.learnable(documents))
    out = langid.detect(documents, models).where("lang IS NOT NULL AND n_chars > 40").collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_held_out_rows_are_not_learned_from(frame):
    rows = [(i, "aaa bbb", "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "yy") for i in range(40)]
    assert [m[0] for m in langid.fit(langid.learnable(frame(rows)))] == ["yy"]


def test_odd_rows_and_empty(frame):
    train = frame([(i, t, lang) for i, (t, lang) in enumerate([("the words and one two", "en"), ("der die und ein zwei", "de")] * 3)])
    models = langid.fit(train)
    out = langid.detect(frame(ODD), models).collect()
    assert len(out) == len(ODD)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in out)
    assert {r.lang_pred for r in out if r.text == "two words"} == {"en"}
    assert langid.fit(frame([])) == [] and langid.detect(frame([]), models).count() == 0
    assert {r.lang_pred for r in langid.detect(frame(ODD), []).collect()} == {"und"}
    d = frame([(1, "der und")]).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x"))
    assert [r.lang_pred for r in langid.detect(d, models).collect()] == ["de"]


def test_rare_labels_and_ends_of_texts_are_learned(frame):
    rows = [(i, f"the words and one two {i}", "en") for i in range(3000)] + [(5000, "der die und ein zwei", "de")]
    rows += [(6000 + i, "aaaa " * 5000 + "zwölf boxkämpfer jagen viktor " * 100, "xx") for i in range(2)]
    models = langid.fit(frame(rows))
    assert [m[0] for m in models] == ["de", "en", "xx"]
    out = {r.doc_id: r.lang_pred for r in langid.detect(frame([(1, "die und der"), (2, "viktor jagen boxkämpfer"), (3, "two words")]), models).collect()}
    assert out == {1: "de", 2: "xx", 3: "en"}
