from collections import Counter

from pyspark.sql import functions as F

from pagesearch.llm import decontaminate
from tests.llm.conftest import ODD, SF


def shingles(words, k):
    return Counter(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))


def words_of(text):
    return (text or "").encode().lower().decode().translate(str.maketrans("\t\n\r\v\f", "     ")).split(" ")


def plain(docs, items, least=0.8):
    out = []
    for key, text in docs:
        w = [x for x in words_of(text) if x]
        for item, body in items:
            v = [x for x in words_of(body) if x]
            if not v:
                continue
            k, n = min(5, len(v)), min(len(v), len(w))
            mine, best = shingles(v, k), None
            for s in range(len(w) - n + 1):
                window = shingles(w[s:s + n], k)
                if not mine.keys() & window.keys():
                    continue
                sim = (mine & window).total() / (mine | window).total()
                if sim >= least and (best is None or sim > best[0]):
                    best = (sim, s, n)
            if best:
                out.append((key, item, *best))
    return sorted(out, key=str)


def found(docs, items):
    return sorted((tuple(r) for r in decontaminate.contaminated(docs, items).collect()), key=str)


def test_documents_against_brute_force(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in documents.where("n_chars < 6000").collect()]
    assert found(documents.where("n_chars < 6000"), items) == plain(docs, [tuple(r) for r in items.collect()])


def test_changed_passages(spark, frame):
    body = [f"word{i % 37}x{i}" for i in range(60)]
    item = " ".join(body)
    docs = [(0, "intro " + item + " outro"), (1, " ".join(body[:55]) + " cut"), (2, " ".join(body[:40])),
            (3, " ".join(body[:30] + ["changed"] + body[31:])), (4, item.upper()), (5, "\n".join(body)), (6, item + " " + item), (7, "nothing of it")]
    items = [(9, item), (9, item), (10, "short one"), (11, ""), (12, None), (None, item), (13, "just four words here"), (14, " ".join(["rep"] * 30))]
    docs += [(8, "a Short ONE b"), (9, "just four words here"), (10, "rep " * 33), (11, "rep " * 20)]
    i = spark.createDataFrame(items, "item_id long, text string")
    assert found(frame(docs), i) == plain(docs, [x for x in dict.fromkeys(items) if x[0] is not None])
    assert sorted(r.doc_id for r in decontaminate.decontaminate(frame(docs), i).collect()) == sorted({d for d, _ in docs} - {x[0] for x in found(frame(docs), i)})


def test_blocks_of_items_give_the_same(spark, frame, monkeypatch):
    items = [(k, " ".join(f"w{k}x{i}" for i in range(20 + k))) for k in range(12)]
    docs = frame([(k, "before " + t + " after") for k, t in items] + [(99, "clean words only")])
    i = spark.createDataFrame(items, "item_id long, text string")
    whole = found(docs, i)
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", ("item_id", "text", 40))
    assert len(decontaminate.item_blocks(i)) > 4
    assert found(docs, i) == whole and len(whole) == 12
    assert [r.doc_id for r in decontaminate.decontaminate(docs, i).collect()] == [99]


def test_odd_rows_and_empty_tables(spark, frame):
    items = spark.createDataFrame([(1, "a b c d e f a b c d e f"), (2, "one")], "item_id long, text string")
    assert found(frame(ODD), items) == plain(ODD, [(1, "a b c d e f a b c d e f"), (2, "one")])
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(frame(ODD), none) == [] and found(frame([]), items) == []
    assert decontaminate.decontaminate(frame(ODD), none).count() == len(ODD)
    d = frame([(1, "two one")]).withColumn("item_id", F.lit("x")).withColumn("similarity", F.lit(1)).withColumn("_contaminated", F.lit(1))
    assert [r.item_id for r in decontaminate.contaminated(d, items).collect()] == [2]


def test_columns_of_any_name_text_ids_and_blocks(spark, frame, monkeypatch):
    item = " ".join(f"w{i}" for i in range(30))
    docs = frame([(1, f"before {item} after"), (2, "clean text of its own"), (3, None)]).withColumn("_contaminated", F.lit("mine")).withColumn("contaminated", F.lit(5))
    items = spark.createDataFrame([("x", item), ("y", " ".join(f"v{i}" for i in range(30))), (None, item), ("z", None)], "item_id string, text string")
    for limit in (10_000, 1):     # one block, and a block an item
        monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", ("item_id", "text", limit))
        assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()] == [(1, "x")]
        left = decontaminate.decontaminate(docs, items)
        assert sorted((r.doc_id, r._contaminated, r.contaminated) for r in left.collect()) == [(2, "mine", 5), (3, "mine", 5)]
        assert left.columns == docs.columns
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 and decontaminate.decontaminate(docs, items.limit(0)).count() == 3
