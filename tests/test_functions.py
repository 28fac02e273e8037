import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import arrays, corrupt, edits, syllable, text, typist


def col(spark, f, *values):
    """f over the columns a, b, ... of one row."""
    names = "abcdef"[: len(values)]
    return spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(names, values)]).select(f(*[F.col(n) for n in names]).alias("x")).first().x


GOOD = "việt nghiêng quyển thuở khuya gì quý uống yên ích ếch toán hòa thủy được nghĩ ghế kẻ cá ngà oan xoong".split()
BAD = "viêt ngiêng ca1 bc cẻ ké́ gế nghà íc áb tạch̉ tàc hoaz yê kà cê đưoc aa".split()


def test_syllables():
    assert [w for w in GOOD if syllable.canonical(w) is None] == []
    assert [w for w in BAD if syllable.canonical(w) is not None] == []
    assert syllable.canonical("Hoà") == "hòa" and syllable.canonical("thuỷ") == "thủy" and syllable.canonical("tóán") is None
    every = syllable.all_syllables()
    assert all(syllable.canonical(s) == s for s in every) and len(every) > 10_000


def test_telex():
    pairs = {
        "vieetj": ("việt", "vietnamese"), "tieengs": ("tiếng", "vietnamese"), "tiesng": ("tiéng", "literal"), "dduwowcj": ("được", "vietnamese"), "duocwdj": ("được", "vietnamese"), "Vieetj": ("Việt", "vietnamese"), "hoaf": ("hòa", "vietnamese"), "thuyr": ("thủy", "vietnamese"),
        "ass": ("as", "literal"), "tesst": ("test", "literal"), "receive": ("receive", "literal"), "ngh": ("ngh", "partial"), "tiee": ("tiê", "partial"), "tieez": ("tieez", "literal"), "asz": ("a", "vietnamese"), "w": ("ư", "vietnamese"), "xyz1": ("xyz1", "literal"), "": ("", "partial"),
    }
    pairs["tiesng"] = ("tiesng", "literal")
    assert {k: syllable.compose(k) for k in pairs} == pairs


def test_keys_round_trip():
    random.seed(1)
    for s in random.sample(sorted(s for s, letters in syllable.all_syllables().items() if not any(x in letters for x in ("oo", "oeo", "uơ"))), 3000):
        assert syllable.compose(syllable.to_keys(s)) == (s, "vietnamese")
        assert syllable.compose_vni(syllable.to_keys(s, syllable.VNI_KEYS, "12345"))[0] == s
    assert syllable.to_keys("Việt") == "Vieetj" and syllable.vni_to_telex("Vie6t5") == "Vieetj"
    assert syllable.compose_vni("Win10") == ("Win10", "literal") and syllable.compose_vni("d9o6") == ("đô", "vietnamese")


def test_syllable_columns(spark):
    d = spark.createDataFrame([("Hoà",), (None,), ("xyz",)], "w string")
    assert [tuple(r) for r in d.select(syllable.canonical_syllable("w"), syllable.telex_keys("w"), syllable.telex("w")["text"]).collect()] == [("hòa", "Hoaf", "Hoà"), (None, None, None), (None, "xyz", "xyz")]


def test_text_columns(spark):
    assert col(spark, text.bare, "Đường Việt") == "duong viet" and col(spark, text.untoned, "Đường") == "đương"
    assert [col(spark, text.tone_of, w) for w in ("má", "mà", "mả", "mã", "mạ", "ma")] == [1, 2, 3, 4, 5, 0]
    assert col(spark, text.same_word, "mả", "mã") and col(spark, text.same_word, "mà", "mả") and not col(spark, text.same_word, "má", "mạ") and not col(spark, text.same_word, "má", "mé")
    cases = [("ABC", "xyz", "XYZ"), ("A", "xyz", "Xyz"), ("Abc", "xyz", "Xyz"), ("abc", "xyz", "xyz"), ("aBC", "xyz", "xyz")]
    assert all(col(spark, text.match_case, a, b) == c for a, b, c in cases)
    assert col(spark, text.with_case_of, "aBc", "xyz") is None and col(spark, text.with_case_of, "Abc", "xyz") == "Xyz"
    assert [col(spark, text.shape, w) for w in ("<env>", "12.", "ABC", "Abc", "abc", "A")] == [5, 4, 2, 1, 0, 1]
    assert [tuple(r) for r in col(spark, text.letter_runs, "nguuu")] == [("n", 1), ("g", 1), ("u", 3)]
    assert col(spark, text.repeats, "nguuu", "ngu") and not col(spark, text.repeats, "ngu", "nguu") and not col(spark, text.repeats, "nggu", "ngi")
    assert col(spark, text.one_letter_out, "abc", "ac") and not col(spark, text.one_letter_out, "abc", "ad")
    assert sorted(col(spark, text.deletions, "aba")) == ["aa", "ab", "aba", "ba"]
    assert tuple(col(spark, text.edit_action, "abc", "abd")) == (1, "d") and tuple(col(spark, text.edit_action, "", "x")) == (0, "x") and tuple(col(spark, text.edit_action, "ab", "ab")) == (0, "")
    assert tuple(col(spark, text.core_split, "(khựa!")) == ("(", "khựa", "!") and tuple(col(spark, text.core_split, "...")) == ("...", "", "")
    assert col(spark, text.typing_plan, "“Việt”  nam…") == '"Việt" nam.' and col(spark, text.typing_plan, "日本") is None
    assert col(spark, text.bag_distance, "khogn", "khoong") == 1 and col(spark, text.bag_distance, "khogn", "khong") == 0
    assert col(spark, text.is_meant, "viet", "Viet") and not col(spark, text.is_meant, "Viet", "viet")


def test_slips_and_costs():
    def cost(keys, target):
        found = [c for (t, _), c in edits.slips(keys).items() if t == target]
        return min(found) if found else None

    want = {
        ("teh", "the"): 4.0, ("dunhf", "dungf"): 4.5, ("mooix", "mooir"): 4.0, ("as", "ax"): 4.5, ("anj", "ans"): None, ("toi", "tooi"): 3.5, ("toi", "tois"): 4.5,
        ("untill", "until"): 3.5, ("occured", "occurred"): 3.5, ("seperate", "separate"): 5.5, ("helo", "help"): 4.5, ("hlo", "hilo"): 5.0, ("teh", "tzh"): None,
    }
    assert {k: cost(*k) for k in want} == want
    marks = lambda a, b: (b, True) in edits.slips(a)
    assert marks("mooir", "mooix") and marks("khoi", "khoir") and marks("khoi", "khooi") and not marks("khoi", "khi")
    assert all(t != "aa" for t, _ in edits.slips("aa"))
    assert edits.slip_cost("khogn", "khoong") == 7.5 and edits.slip_cost("seperate", "separate") == 5.5 and edits.slip_cost("same", "same") == 0
    assert edits.slip_cost("kubectl", "cube") is None and edits.slip_cost("abcdef", "uvwxyz") is None and edits.slip_cost("a", "b" * 40) is None
    for keys in ("khong", "teh", "aab"):  # a single slip costs no more by alignment
        for (t, _), c in edits.slips(keys).items():
            if c not in (edits.TONE_SWAP, edits.MISSING_MARK):
                assert edits.slip_cost(keys, t) is not None and edits.slip_cost(keys, t) <= max(c, 5.0)


def test_kinds_of_mistakes():
    want = {
        ("cuả", "của"): "tone_place", ("thoả", "thỏa"): "tone_convention", ("hoa", "hòa"): "tone_drop", ("hòa", "hoa"): "tone_add", ("má", "mà"): "tone", ("viet", "viêt"): "mark_drop", ("viêt", "viet"): "mark_add", ("dường", "đường"): "mark_drop",
        ("nguuuu", "ngu"): "double", ("nguu", "ngu"): "double", ("khogn", "khong"): "swap", ("mhà", "nhà"): "neighbour", ("thà", "nhà"): "substitute", ("hà", "nhà"): "omit", ("nbhà", "nhà"): "extra", ("nxhà", "nhà"): "insert", ("abc", "abc"): None, ("", "a"): None, ("abcd", "wxyz"): None,
    }
    assert {k: edits.classify(*k) for k in want} == want


def test_two_slips(spark):
    want = {("abc", "abd"): False, ("abc", "acb"): False, ("abcd", "bacd"): False, ("abcd", "badc"): True, ("abc", "abcd"): False, ("abc", "abcde"): True, ("abcd", "xbcy"): True}
    assert {k: col(spark, edits.two_slips, *k) for k in want} == want
    kinds = {("hát", "hán"): "one letter", ("a b", "ab"): "space", ("hát", "hạt"): "marks or tone only", ("abc", "abcdef"): "other"}
    assert {k: col(spark, edits.mistake_kind, *k) for k in kinds} == kinds and col(spark, lambda a: edits.mistake_kind(a, F.lit(None)), "x") == "no suggestion"


def test_arrays(spark):
    v = [1.0, 2.0, 4.0]
    assert col(spark, arrays.dot, v, v) == 21 and abs(col(spark, arrays.mean, v) - 7 / 3) < 1e-12
    normed = col(spark, arrays.layer_norm, v)
    assert abs(sum(normed)) < 1e-9 and abs(sum(x * x for x in normed) / 3 - 1) < 1e-4
    assert abs(col(spark, arrays.log_sum_exp, [1000.0, 1000.0]) - 1000 - math.log(2)) < 1e-9
    top = col(spark, arrays.softmax_top, [0.0, 3.0, 3.0])
    assert top.at == 1 and abs(top.p - 1 / (2 + math.exp(-3))) < 1e-9
    assert col(spark, arrays.quantise, math.exp(-2)) == 8192 and col(spark, arrays.quantise, 1e-9) == 65535 and col(spark, arrays.quantise, 0.0) is None
    for x in (-2.0, -0.5, 0.0, 0.3, 3.0):
        assert abs(col(spark, arrays.gelu, x) - 0.5 * x * (1 + math.erf(x / math.sqrt(2)))) < 1e-6
    grams = col(spark, arrays.char_grams, "ab")
    assert grams == ["<", "a", "b", ">", "<a", "ab", "b>", "<ab", "ab>", "<ab>"] and len(col(spark, arrays.char_grams, "a" * 60)) == 40
    assert col(spark, arrays.buckets, ["việt"]) == [zlib.crc32("việt".encode()) % 65536]


def test_corruption_is_what_it_says():
    words = [w for w in sorted(syllable.all_syllables()) if len(w) > 2][::97]
    for kind in corrupt.KIND_COUNTS:
        made = [(w, corrupt.make(w, kind, corrupt.rng_of(w, kind))) for w in words]
        made = [(w, x) for w, x in made if x and x != w]
        assert made, kind
        hits = sum(edits.classify(x, w) == kind for w, x in made) / len(made)
        # Letters put in or changed at random may be neighbours or doubles; swaps may only move a mark.
        assert hits == 1 if kind in ("tone_drop", "tone_add", "tone_place", "omit", "neighbour") else hits > 0.4, (kind, hits)
    assert corrupt.one_mistake("đường", 1) == corrupt.one_mistake("đường", 1)


def test_rules_accept_their_own_mistakes():
    words = [w for w in sorted(syllable.all_syllables()) if len(w) > 2][::211]
    for rule in corrupt.RULES:
        made = [(w, rule.make(w, corrupt.rng_of(w, rule.id))) for w in words]
        made = [(w, x) for w, x in made if x and x != w]
        assert made and sum(rule.check(*m) for m in made) / len(made) > 0.4, rule
        assert not rule.check("nhà", "nhà")
    assert corrupt.regional("nam", "lam") and corrupt.regional("mất", "mấc") and corrupt.regional("ngả", "ngã") and not corrupt.regional("nam", "tam")
    picks = corrupt.choose_rules(4, "k")
    assert len({r.id for r in picks}) == 4 and picks == corrupt.choose_rules(4, "k")


def test_typist():
    for i in range(200):
        rng = corrupt.rng_of(i)
        out = typist.typo("tieengs", True, i % 2 == 0, rng)
        assert out is None or (out != "tieengs" and len(out) >= 3)
        runs = typist.run_lengths(20, rng)
        assert all(2 <= n <= 12 for _, n in runs) and all(a + n < b for (a, n), (b, _) in zip(runs, runs[1:])) and len(runs) <= 3


@pytest.mark.parametrize("n", [1, 3])
def test_draws_do_not_depend_on_partitions(spark, n):
    d = spark.createDataFrame([(w,) for w in GOOD], "w string").repartition(n)
    got = {r.w: tuple(r.m) if r.m else None for r in d.select("w", corrupt.corrupted("w", "w").alias("m")).collect()}
    assert got == {w: corrupt.one_mistake(w, w, w) for w in GOOD}
