import random

import pytest

from lexiforge.llm import overlap
from lexiforge.llm.overlap import Overlap, case_records, list_of_words


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def rows_of(seed, n, words, longest):
    random.seed(seed)
    return [(i, random.choice([0, 1, 1, None]), random.choice("pq"), [random.choice(words) for _ in range(random.randint(2, longest))]) for i in range(n)]


@pytest.mark.parametrize("seed,words,longest,k,w,hot", [(1, "abc", 5, 2, 2, 4096), (2, "abcdefgh", 5, 2, 2, 10), (3, "ab", 9, 1, 2, 0), (4, "abcd", 12, 2, 2, 0), (5, "abcd", 12, 3, 1, 50)])
def test_pairs_equal_brute_force(spark, monkeypatch, seed, words, longest, k, w, hot):
    monkeypatch.setattr(overlap, "HOT_PAIRS", hot)
    rows = rows_of(seed, 160, words, longest) + [(900, 0, "p", None), (899, 0, "p", []), (None, 0, "p", list("abcd")), (901, 0, "p", ["a"] * 300), (902, 1, "q", ["a"] * 299)]
    d = spark.createDataFrame(rows, "id long, side int, list string, words array<string>").withColumnRenamed("list", "source")
    o = Overlap(d, "id", "side", "source", list_of_words("words"), 4, k, w)
    got = [tuple(r) for r in o.record_pairs().collect()]
    e = [r for r in rows if r[1] == 0 and r[0] is not None and r[3]]
    t = [r for r in rows if r[1] == 1 and r[3]]
    alike = lambda a, b: a == b or min(len(a), len(b)) >= 4 and near(a, b)
    want = {(a[0], b[0]) for a in e for b in t if alike(a[3], b[3])}
    assert len(got) == len(set(got)) and set(got) == want
    per = {r.key: r for r in o.per_record().collect()}
    for a in e:
        assert per[a[0]].same == int(any(a[3] == b[3] for b in t))
        assert per[a[0]].lists == len({tuple(b[3]) for b in t if alike(a[3], b[3])})
    assert sum(r.records for r in o.report().collect()) == len(e)


def test_case_records(spark):
    s = "case_id long, source string, history string, typed string, loaded_at timestamp"
    d = spark.createDataFrame([(1, " VSEC-train", "a  b\xa0c", "Dｅ", None), (1, " VSEC-train", "a  b\xa0c", "Dｅ", None), (2, "viwiki", None, "x", None), (3, "viwiki", "a", None, None), (4, "other", "a", "b", None), (5, "viwiki", "A", "b\tc de", None), (None, "viwiki", "a", "b", None)], s)
    rows = case_records(d)
    assert {r.case_id: (r.side, r.source) for r in rows.collect()} == {1: (1, "vsec_train"), 2: (0, "viwiki"), 4: (None, "other"), 5: (0, "viwiki")}
    got = {r.case_id: r.l for r in rows.select("case_id", overlap.list_of_text("text").alias("l")).collect()}
    assert got[1] == got[5] and len(got[1].words) == 4 and got[4].words == got[1].words[:2]


def test_empty_and_hot(spark):
    s = "id long, side int, source string, words array<string>"
    empty = Overlap(spark.createDataFrame([], s), "id", "side", "source", list_of_words("words"))
    assert empty.record_pairs().count() == 0 and empty.report().count() == 0
    # A list that a third of all records have is one class.
    rows = [(i, 1, "t", list("abcd")) for i in range(500)] + [(1000, 0, "e", list("abcx")), (1001, 0, "e", list("wxyz")), (1002, 0, "e", ["d"])]
    o = Overlap(spark.createDataFrame(rows, s), "id", "side", "source", list_of_words("words"))
    assert o.near.count() == 1 and o.record_pairs().count() == 500


def test_guarantee_is_checked(spark):
    with pytest.raises(ValueError):
        Overlap(spark.createDataFrame([], "id long, side int, source string, words array<string>"), "id", "side", "source", list_of_words("words"), 4, 3, 2)
