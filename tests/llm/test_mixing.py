import os

import pytest

from lexiforge.llm import mixing

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer file here")


@pytest.fixture
def docs(spark):
    rows = [(i, "từ này có vài chữ " * (1 + i % 7), "big", "k") for i in range(600)]
    rows += [(1000 + i, "one two three", "small", "k") for i in range(30)] + [(2000 + i, "four five", "tiny", "k") for i in range(3)]
    rows += [(3000, None, "small", "k"), (3001, "", "small", "k"), (3002, "lost", None, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, uses string")


def test_shares_and_caps(spark, docs):
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.1, 100), ("tiny", 0.2, 2), ("none", 0.1, 3), (None, 0.1, 1)], "source string, weight double, max_repeats int")
    m = mixing.Mixture(docs, t)
    r = {x.source: x for x in m.report().collect()}
    assert {k for k, x in r.items() if x.short} == {"tiny", "none"}
    assert abs(r["big"].given - r["big"].target) <= 30 and abs(r["small"].given - r["small"].target) <= 5
    assert r["tiny"].given == 2 * r["tiny"].size and r["none"].given == 0
    assert abs(sum(x.share for x in r.values()) - 1) < 1e-9
    rows = m.sample().collect()
    assert len({(x.key, x.source) for x in rows}) == len(rows)
    assert max(x.uses for x in rows if x.source == "big") == 1 and {x.uses for x in rows if x.source == "tiny"} == {2}
    copies = r["small"].target // r["small"].size
    assert {x.uses for x in rows if x.source == "small"} <= {copies, copies + 1}
    again = mixing.Mixture(docs.repartition(7), t).sample().collect()
    assert sorted(rows) == sorted(again)


def test_preferred_records_are_drawn_more(spark, docs):
    t = spark.createDataFrame([("big", 0.3, 1)], "source string, weight double, max_repeats int")
    from pyspark.sql import functions as F

    d = docs.withColumn("good", F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0))
    rows = mixing.Mixture(d, t, appeal="good").sample().collect()
    even = sum(x.key % 2 == 0 for x in rows)
    assert even > 2 * (len(rows) - even)


def test_empty(spark, docs):
    t = spark.createDataFrame([("big", 1.0, 1)], "source string, weight double, max_repeats int")
    m = mixing.Mixture(docs.limit(0), t)
    assert m.sample().count() == 0 and [x.given for x in m.report().collect()] == [0]
    assert mixing.Mixture(docs, t.limit(0)).report().count() == 0


def test_sizes_are_those_of_whole_texts(spark):
    d = spark.createDataFrame([(1, "x" * 100_000 + " end"), (2, None), (3, "")], "id long, text string")
    n = {r.id: r.tokens for r in mixing.token_sizes(d, "text", ["id"]).collect()}
    assert n[2] == n[3] == 0 and n[1] == len(mixing._encoding(mixing.TOKENIZER).encode_ordinary("x" * 100_000 + " end"))


def test_certain_records_and_bytes(spark):
    # The preferred record would have a probability above 1: it is taken for certain, the others share the rest.
    d = spark.createDataFrame([(0, "x" * 50, "a", 1000.0)] + [(i, "y" * 10, "a", 1.0) for i in range(1, 41)] + [(90, "z" * 10, "a", 0.0)], "doc_id long, text string, source string, liked double")
    t = spark.createDataFrame([("a", 0.5, 1)], "source string, weight double, max_repeats int")
    m = mixing.Mixture(d, t, tokenizer=mixing.BYTES, appeal="liked")
    rows = {x.key: x.tokens for x in m.sample().collect()}
    assert 0 in rows and 90 not in rows and abs(sum(rows.values()) - 230) <= 5
    assert [(x.size, x.given) for x in m.report().collect()] == [(460, 230)]
