import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from pagesearch.llm import pii
from tests.llm.conftest import ODD

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    t = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in t) % 10 == 0


def base(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end(), m[0].lower() if kind == "email" else m[0] if kind == "ip" else d))
    return out


def digests(df):
    return {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digest(pii.spans(df)).collect()}


def want(rows):
    out = set()
    for key, text in rows:
        found = base(text)
        kinds = [x[0] for x in found]
        digest = hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c, _ in found).encode()).hexdigest()
        out.add((key, *map(kinds.count, PLAIN), digest))
    return out


SAMPLES = ["a.b@c.d, x@y z@w.q_e@f.g.h", "1.2.3.4 256.1.1.1 001.002.003.255 1.2.3.4.5.6.7.8 10.0.0.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
           "+1 (555) 123-4567 +12 ++4912345678 +1 2", "é🙂 john@example.com 🙂 +49 30 1234567\n+1 999\n8887777", "4" * 40, "4111111111111111" * 3, "a@b.c" * 50,
           "x" * 2000 + "@" + "y" * 2000 + ".z" * 2000, "1 " * 9000, "1." * 6000, "+1" + "(" * 3000 + "2", "a@b", "@", "+", "1", "12", "12.3.4", "a@b..c", "a@-.-"]


def test_base_spans_of_samples_and_documents(frame, documents):
    rows = [*enumerate(SAMPLES, 100), *ODD]
    assert digests(frame(rows)) == want(rows)
    assert digests(documents) == want([(r.doc_id, r.text) for r in documents.collect()])


@pytest.mark.parametrize("seed", range(2))
def test_base_spans_of_random_texts(frame, seed):
    import random
    r = random.Random(seed)
    rows = [(i, "".join(r.choice("0123456789 .-+()@aé\n_%") for _ in range(r.randint(0, 120)))) for i in range(3000)]
    assert digests(frame(rows)) == want(rows)


def test_long_runs_are_read_once(frame):
    n = 1_000_000
    got = pii.digest(pii.spans(frame([(1, "x" * n + " a@b.c_d@e.f")]))).first()
    spans = f"email:{n + 1}:{n + 6},email:{n + 6}:{n + 12}"
    assert got.n_email == 2 and got.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def disclosed(rows):
    """Brute force of the disclosure and of the spans it adds."""
    docs = {(k, t or "") for k, t in rows}
    words = {d: set(re.findall(r"[^\W\d_]{3,}", d[1].lower())) for d in docs}
    near, ents = {}, {}
    for d in docs:
        found = base(d[1])
        for kind, s, e, v in found:
            ents.setdefault((kind, v), set()).add(d)
            lo, hi = d[1].rfind("\n", 0, s) + 1, d[1].find("\n", e) % (len(d[1]) + 1)
            for m in re.finditer(r"[^\W\d_]{3,}", d[1][lo:hi]):
                a, b = lo + m.start(), lo + m.end()
                inside = (s - 80 <= a and b <= s) or (e <= a and b <= e + 80)
                if inside and not any(x[1] < b and x[2] > a for x in found):
                    near.setdefault((kind, v, m[0].lower()), set()).add((d, a, b))
    out = {d: set() for d in docs}
    for (kind, v, term), at in near.items():
        joint = len({x[0] for x in at})
        n_e, n_t = len(ents[kind, v]), sum(term in w for w in words.values())
        if joint >= 2 and n_e < len(docs) and math.log(joint * len(rows) / (n_t * n_e)) / math.log(len(rows) / n_e) >= pii.GENERALISE - 1e-12:
            for d, a, b in at:
                out[d].add((a, b))
    return {(k, ",".join([f"{a}:{b}:{c}" for a, b, c, _ in base(t)] + [f"term:{a}:{b}" for a, b in sorted(out[k, t])])) for k, t in docs}


def test_disclosure_against_brute_force(frame):
    rows = [(i, f"the clinic of doctor zebra{'x' * (i % 3)} writes to me{i % 4}@mail.example.com about the patient and the weather number {i}\nsecond line doctor") for i in range(12)]
    rows += [(20 + i, f"the weather of the day and doctor common words {i}") for i in range(30)]
    rows += [(60, "nobody@else.org stands alone near unique terms"), (61, "ring +1 (555) 123-4567 now or 10.1.1.1 now"), (62, "ring +1 (555) 123-4567 later or 10.1.1.1")]
    got = {(r.doc_id, r.spans) for r in pii.digest(pii.spans(frame(rows))).collect()}
    assert got == disclosed(rows)
    assert any("term:" in s for _, s in got)


def test_sanitised_text(frame):
    rows = [(i, f"call agent smith at +1 (555) 123-4567 today {'again' if i else 'first'}") for i in range(3)] + [(9, "smithless words today"), (10, None)] + [(20 + i, "today at call") for i in range(20)]
    out = {r.doc_id: r.text for r in pii.sanitised(frame(rows)).collect()}
    assert out[0] == "call    at <phone> today first".replace("call    at", "call   at") or "<phone>" in out[0]
    assert "smith" not in out[0] and "555" not in out[0] and out[9] == "smithless words today" and out[10] is None
    assert pii.sanitised(frame(rows)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_no_python_in_the_plan_and_empty(frame):
    plan = pii.digest(pii.spans(frame(ODD)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert pii.digest(pii.spans(frame([]))).count() == 0 and pii.sanitised(frame([])).count() == 0
    d = frame([(1, "a@b.cd")]).withColumn("spans", F.lit("x")).withColumn("key", F.lit(1)).withColumn("version", F.lit(1))
    assert [r.spans for r in pii.digest(pii.spans(d)).collect()] == ["email:0:6"]
    assert pii.sanitised(d).first().text == "<email>"


def test_terms_of_the_whole_document_reveal_and_are_cut(frame):
    """On another line, and farther off than a line is long; those of an entity's own letters are none."""
    far = "some words that fill the text " * 10
    rows = [(i, f"Zebulon wrote\n{far}tel+49 30 1234567 and éééabc@x.yz{i}\n{far}\nby ZEBULON, éééabc and {'late' * (i + 1)}") for i in range(2)]
    rows += [(10 + i, f"tel wrote and by {far}") for i in range(40)]
    marks = {r.doc_id: r for r in pii.digest(pii.spans(frame(rows))).collect()}
    for i in range(2):
        text = rows[i][1]
        terms = [text[int(a):int(b)] for kind, a, b in (x.split(":") for x in marks[i].spans.split(",")) if kind == "term"]
        assert terms == ["Zebulon", "ZEBULON", "éééabc"]
    out = {r.doc_id: r.text for r in pii.sanitised(frame(rows)).collect()}
    assert "ebulon" not in out[0].lower() and "late" in out[0] and out[10] == rows[2][1]


def test_sanitised_keeps_columns_of_any_name(frame):
    docs = frame([(1, "write to ann@example.org now"), (2, "nothing here"), (3, None)])
    names = ["_row", "_cut", "_key", "_version", "own", "key", "body", "version", "cut", "of_key"]
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    out = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert {k: r.text for k, r in out.items()} == {1: "write to <email> now", 2: "nothing here", 3: None}
    assert all(r[n] == n for r in out.values() for n in names)
