import random
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiforge.llm import unify

ALPHABET = st.characters(blacklist_categories=("Cs", "Cn"), max_codepoint=0x2FFFF)
MARKS = st.sampled_from("̛̣̀́̂̆̈̀́")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.one_of(ALPHABET, MARKS, st.sampled_from("aoeuAOdướ각각")), max_size=20)), max_size=20))
def test_composition_is_nfc(texts):
    got = unify.unify_array(pa.array(texts, pa.string()), fold=False).to_pylist()
    assert got == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.one_of(ALPHABET, MARKS), max_size=20), max_size=10))
def test_form_is_a_fixed_point(texts):
    once = unify.unify_array(pa.array(texts, pa.string()))
    assert unify.unify_array(once).to_pylist() == once.to_pylist()


def test_known_cases():
    pairs = {
        "ｇａｒｔｅ": "garte", "k‍hông\xa0": "không ", "рһừі": "phừi", "ТΗΕΟ": "THEO", "xuộm": "xuộm", "Ðã": "Đã", "﻿са̉n­": "cản", "ɡɑ": "ga",
        "σθένπ": "σθένπ", "жулдин": "жулдин", "km²": "km²", "½": "½", "CO₂": "CO₂", "Zoë": "Zoë", "façade": "façade", "x  y": "x  y", "": "",
    }
    assert unify.unify_array(pa.array(list(pairs))).to_pylist() == list(pairs.values())


def test_nulls_long_and_sliced():
    long = "а̂" * 50_000 + " ok"
    whole = pa.array(["x", None, "", long, "ｘ"])
    assert unify.unify_array(whole).to_pylist() == ["x", None, "", "â" * 50_000 + " ok", "x"]
    assert unify.unify_array(whole.slice(3)).to_pylist() == ["â" * 50_000 + " ok", "x"]
    assert unify.unify_array(pa.array([], pa.string())).to_pylist() == []
    many = "a" + "̣̂" * 5000
    assert unify.unify_array(pa.array([many])).to_pylist() == [unicodedata.normalize("NFC", many)]


def test_changed_values(spark):
    rows = [(1, "không", 0), (2, "khо̂ng", 0), (2, "khо̂ng", 0), (3, None, 0), (4, "", 0), (5, "ｏ", 1)]
    d = spark.createDataFrame(rows, "id long, value string, unified int")
    got = unify.changed_values(d.drop("unified"), "value", ["id"])
    assert sorted((r.id, r.unified) for r in got.distinct().collect()) == [(2, "không"), (5, "o")]
    assert unify.changed_values(d.limit(0), "value", ["id"]).count() == 0


def test_partitions_do_not_matter(spark):
    random.seed(3)
    texts = ["".join(random.choice("aàоοｋ́​ k") for _ in range(9)) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("u", unify.unified("t"))
    one, many = (dict((r.i, r.u) for r in d.repartition(n).collect()) for n in (1, 7))
    assert one == many == dict(enumerate(unify.unify_array(pa.array(texts)).to_pylist()))
