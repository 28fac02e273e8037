import random

import pyarrow as pa
import regex

from lexiforge.llm import leakage, words
from lexiforge.llm.unify import unify_array


def split(text):
    return regex.findall(r"[\p{L}\p{Nd}]+", unify_array(pa.array([text or ""])).to_pylist()[0].lower())


def corpus(seed=1):
    random.seed(seed)
    vocabulary = ["alpha", "Bé", "bé", "gamma7", "δέλτα", "е", "và", "x", "9"]
    docs = [(i, random.choice([" ", ", ", "\n", "…"]).join(random.choice(vocabulary) for _ in range(random.randint(0, 60)))) for i in range(150)]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(random.randint(0, 12)))) for i in range(40)]
    for i in range(0, 40, 2):  # planted wholly or in part
        w = items[i][1].split(" ")
        docs.append((1000 + i, "zz " + "-".join(w[: max(8, len(w) - 2)]) + " yy"))
    return docs + [(None, docs[-1][1]), (2000, None), (2001, ""), (2002, "w " * 30_000 + docs[-1][1])], items + [(None, "a"), (99, None), (98, "")]


def test_search_equals_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, block string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    for least in (4, 8):
        want = {}
        for item, t in items:
            w = split(t)
            for doc, text in docs:
                if item is None or doc is None:
                    continue
                x = split(text)
                at = {}
                for a in range(len(x)):
                    at.setdefault(x[a], []).append(a)
                best = 0
                size = min(least, len(w))
                for s in range(len(w) - size + 1 if size else 0):
                    for a in at.get(w[s], []):
                        n = 0
                        while s + n < len(w) and a + n < len(x) and x[a + n] == w[s + n]:
                            n += 1
                        best = max(best, n)
                if size and best >= size:
                    want[item, doc] = best
        got = leakage.search(leakage.build_index(d), i, least=least).collect()
        assert {(r.item_id, r.doc_id): r.words for r in got} == want
        assert len(got) == len(want) and all(r.item_words == len(split(dict(items)[r.item_id])) for r in got)


def test_near(spark):
    docs = spark.createDataFrame([(1, "d c b a e"), (2, "a b " + "z " * 50 + "c d e"), (3, "a b c d"), (None, "a b c d e")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e"), (2, "a b"), (3, "a b c d q")], "item_id long, text string")
    index = leakage.build_index(docs)
    got = leakage.search_near(index, items, terms=5, need=5, span=10)
    assert [tuple(r) for r in got.collect()] == [(1, 1)]
    got = leakage.search_near(index, items, terms=5, need=4, span=10)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (1, 3), (3, 1), (3, 3)]


def test_very_many_items(spark):
    """One pass and one scan for a hundred thousand items."""
    random.seed(9)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(random.choice(words) for _ in range(10))) for i in range(100_000)]
    docs = [(i, " ".join(random.choice(words) for _ in range(200))) for i in range(300)] + [(1000 + i, "start " + items[i * 997][1] + " end") for i in range(100)]
    index = leakage.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    got = leakage.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.item_id, r.doc_id, r.words) for r in got} == {(i * 997, 1000 + i, 10) for i in range(100)}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    index = leakage.build_index(docs)
    assert leakage.search(index, items).count() == 0 and leakage.search_near(index, items).count() == 0
    some = leakage.build_index(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string"))
    assert leakage.search(some, items.limit(0)).count() == 0
    assert [tuple(r) for r in leakage.leaks_by_item(leakage.search(some, items)).collect()] == [(1, 1, 8, 1)]


def test_passes_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEMS_PER_PASS", 10)
    docs, items = corpus(2)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = leakage.build_index(d)
    few = sorted(map(tuple, leakage.search(index, i).collect()))
    monkeypatch.setattr(leakage, "ITEMS_PER_PASS", 1000)
    assert few == sorted(map(tuple, leakage.search(index, i).collect()))


def test_word_hashes_are_those_of_the_words():
    texts = ["a b", "", "Xin chào, b!", "chа̀o"]
    hashes, first = words.hashes_of(pa.array(texts))
    assert list(first) == [0, 2, 2, 5, 6]
    assert hashes[1] == hashes[4] and hashes[3] == hashes[5] and len(set(hashes)) == 4
