import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import evaluate, journal, learned, lexicon, mining, neural, ngrams, rank, sampling, similar, tokens
from lexiforge.functions import edits
from lexiforge.session import running


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


@pytest.fixture(scope="module")
def texts(spark):
    random.seed(3)
    words = ["một", "hai", "ba", "x9", "tư"]
    data = [(i, "".join(random.choice([*[w + " " for w in words], ", ", "\n"]) for _ in range(random.randint(0, 30)))) for i in range(80)]
    return spark.createDataFrame([*data, (900, None), (901, "")], "doc_id long, text string")


def test_tokens(spark):
    d = spark.createDataFrame([(1, "Xin chào, bạn 9\nTA-o!"), (2, ""), (3, None)], "doc_id long, text string")
    t = tokens.with_tokens(d)
    assert {r.doc_id: r.tokens for r in t.collect()} == {1: ["xin", "chào", "", "bạn", "", "ta", "", "o", ""], 2: []}
    assert rows(tokens.token_rows(t, "doc_id"))[:3] == [(1, 1, "xin", False), (1, 2, "chào", False), (1, 3, None, True)]
    assert t.select(tokens.phrases(F.col("tokens")).alias("p")).collect()[0].p == [["xin", "chào"], ["bạn"], ["ta"], ["o"]]
    assert rows(tokens.phrase_rows(d, "doc_id")) == [(1, 0, ["xin", "chào"]), (1, 1, ["bạn"]), (1, 2, ["ta"]), (1, 3, ["o"])]
    c = tokens.contexts(spark.createDataFrame([(1, list("abcde"))], "k int, words array<string>"), ["k"])
    assert [tuple(r)[2:] for r in c.orderBy("pos").collect()][2] == ("c", ["a", "b"], ["d", "e"])
    s = tokens.spans(spark.createDataFrame([(1, "a  bé!")], "k int, t string"), "k", "t")
    assert rows(s) == [(1, 1, "a", 0, 1), (1, 2, "bé", 3, 5), (1, 3, "!", 5, 6)]
    assert spark.range(1).select(tokens.sentences(F.lit("A b. C?\nD")).alias("s")).first().s == ["A b.", "C?", "D"]
    w = spark.range(1).select(tokens.windows_ending(F.array(*[F.lit(str(i)) for i in range(50)]), F.lit(45)).alias("w")).first().w
    assert w.tokens == ["<env>", *map(str, range(5, 45))] and w.supervised == [37, 38, 39, 40]


def kneser_ney(docs, known, pair, triple):
    """Counted and divided word by word, as a check."""
    c2, c3 = Counter(), Counter()
    for t in docs:
        for g in zip(t, t[1:]):
            c2[g] += all(x in known for x in g)
        for g in zip(t, t[1:], t[2:]):
            c3[g] += all(x in known for x in g)
    c2, c3 = +c2, +c3
    n2, n1 = Counter(g[1:] for g in c3), Counter(g[1] for g in c2)
    def disc(values):
        a, b = (sum(v == k for v in values) for k in (1, 2))
        return 0.75 if not a + 2 * b else min(max(a / (a + 2 * b), 0.1), 0.95)
    d3, d2 = disc(c3.values()), disc(n2.values())
    p1 = {w: max(n1[w], 0.5) / max(sum(n1.values()), 1) for w in known}
    s2, t2 = Counter(), Counter()
    for (b, _), n in n2.items():
        s2[b] += n
        t2[b] += 1
    p2 = lambda b, w: p1[w] if not s2[b] else max(n2[b, w] - d2, 0) / s2[b] + d2 * t2[b] / s2[b] * p1[w]
    x3, k3 = Counter(), Counter()
    for (a, b, _), n in c3.items():
        x3[a, b] += n
        k3[a, b] += 1
    tri = {g: max(n - d3, 0) / x3[g[:2]] + d3 * k3[g[:2]] / x3[g[:2]] * p2(*g[1:]) for g, n in c3.items() if n >= triple}
    return {g: p2(*g) for g, n in c2.items() if n >= pair}, tri, {g[:2]: d3 * k3[g[:2]] / x3[g[:2]] for g in tri}, p2, p1, x3


@pytest.mark.parametrize("pair,triple", [(1, 1), (3, 2)])
def test_kneser_ney(spark, texts, pair, triple):
    t = tokens.with_tokens(texts)
    known = spark.createDataFrame([("một",), ("hai",), ("ba",), ("lạ",)], "word string")
    m = ngrams.KneserNey(t, known, pair, triple)
    docs = [r.tokens for r in t.collect()]
    two, three, gamma, p2, p1, x3 = kneser_ney(docs, {"một", "hai", "ba", "lạ"}, pair, triple)
    near = lambda got, want: got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert near({(r.b, r.w): r.p for r in m.bigrams.collect()}, two)
    assert near({(r.a, r.b, r.w): r.p for r in m.trigrams.collect()}, three)
    assert near({(r.a, r.b): r.g3 for r in m.gammas.collect()}, gamma)
    if pair == 1:  # unpruned: the probabilities behind a seen context add up to one, less unseen words' floor
        for a, b in x3:
            mass = sum(three.get((a, b, w), gamma[a, b] * p2(b, w)) for w in p1)
            assert abs(mass - 1) < 0.2


def test_conditional_probabilities(spark, texts):
    t = tokens.with_tokens(texts)
    known = {"một", "hai", "ba"}
    k = spark.createDataFrame([(w,) for w in known], "word string")
    pairs, total = Counter(), Counter()
    for r in t.collect():
        for a, b in zip(r.tokens, r.tokens[1:]):
            if a in known and b:
                total[a] += 1
                pairs[a, b] += b in known
    got = {(r.prev, r.word): (r.n, r.total) for r in ngrams.bigram_probabilities(t, k, 4).collect()}
    assert got == {g: (n, total[g[0]]) for g, n in pairs.items() if n >= 4}
    assert rows(ngrams.bigram_probabilities(t.limit(0), k)) == []
    mixed = spark.range(1).select(ngrams.mixed(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.1)).alias("x"), ngrams.mixed(F.lit(0.5), F.lit(0.9), F.lit(0.1)).alias("y")).first()
    assert abs(mixed.x - 0.3) < 1e-12 and abs(mixed.y - 0.72) < 1e-12


def test_similar(spark):
    random.seed(7)
    words = sorted({"".join(random.choice("abe") for _ in range(random.randint(3, 7))) for _ in range(120)})
    d = spark.createDataFrame([(w,) for w in words], "word string")
    near = lambda a, b: a != b and ({a} | {a[:i] + a[i + 1 :] for i in range(len(a))}) & ({b} | {b[:i] + b[i + 1 :] for i in range(len(b))})
    assert rows(similar.one_letter_apart(d, d)) == sorted((a, b) for a in words for b in words if near(a, b))
    typed, target = words[:40], words
    far = similar.two_slips_away(spark.createDataFrame([(w,) for w in typed], "keys string"), d.withColumnRenamed("word", "target"))
    want = sorted((a, b, edits.slip_cost(a, b)) for a in typed for b in target if a != b and len(a) >= 4 and edits.slip_cost(a, b) is not None and abs(len(a) - len(b)) <= 2 and sum(abs(a.count(c) - b.count(c)) for c in "abe") <= 4)
    assert rows(far) == want
    classes = similar.same_letters(spark.createDataFrame([("má",), ("mà",), ("ma",), ("đa",), (None,)], "word string"))
    assert rows(classes) == [("ma", 3, "ma", "má")] or rows(classes, "letters", "n") == [("ma", 3)]


def test_signatures_cover_the_ways_to_type():
    from lexiforge.functions.syllable import all_syllables, compose, to_keys

    random.seed(5)
    words = random.sample(sorted(all_syllables()), 400)
    have = {g for w in words for g in rank.signatures(w)}
    missed = found = 0
    for w in words[:60]:
        for (t, _), _c in edits.slips(to_keys(w)).items():
            text, kind = compose(t)
            if kind == "vietnamese" and text in words:
                found += 1
                missed += rank.signature(t) not in have
    assert found > 100 and missed <= 0.02 * found


LEXICON = [("vi", "không", 9_000_000), ("vi", "của", 8_000_000), ("vi", "khong", 900), ("vi", "quan", 500_000), ("vi", "hệ", 400_000), ("vi", "tiếng", 900_000), ("vi", "việt", 800_000), ("en", "the", 50_000_000), ("en", "separate", 20_000), ("en", "until", 90_000), ("en", "quan", 300), ("en", "viet", 200)]


def test_context_decides_between_words(spark):
    c = spark.createDataFrame([("k", "bàn", 9.0, 9.0, None, 10.0, None), ("k", "bán", 9.0, 9.0, None, 10.0, None), ("k", "ban", 9.0, None, 9.0, None, 10.0)], "keys string, word string, score double, as_vi double, as_en double, vi double, en double")
    contexts = spark.createDataFrame([("k", "cái", 0.0), ("k", "người", 0.0), ("k", "", 1.0), ("k", "", -1.0)], "keys string, before string, vote double")
    pairs = spark.createDataFrame([("cái", "bàn", 0.2), ("người", "bán", 0.3)], "prev string, word string, p double")
    got = {(r.before, r.vote, r.word): r.score for r in rank.contextual(c, contexts, pairs).collect()}
    raised = lambda p: 9.0 - 10.0 + math.log(0.5 * p + 0.5 * math.exp(10.0 - math.log(1e9))) + math.log(1e9)
    assert abs(got["cái", 0.0, "bàn"] - raised(0.2)) < 1e-9 and abs(got["người", 0.0, "bán"] - raised(0.3)) < 1e-9
    assert abs(got["cái", 0.0, "bán"] - 9.0) < 1e-9 and abs(got["", 1.0, "ban"] - 6.0) < 1e-9 and abs(got["", -1.0, "bàn"] - 6.0) < 1e-9 and abs(got["", -1.0, "ban"] - 9.0) < 1e-9
    one = spark.createDataFrame([(10.0, 9.0, 0.2), (10.0, 9.0, None), (None, 9.0, 0.2)], "a double, b double, p double")
    bonus = [r[0] for r in one.select(rank.right_bonus(F.col("a"), F.col("b"), F.col("p"))).collect()]
    alone = math.exp(9.0) / 1e9
    assert abs(bonus[0] - math.log((0.5 * 0.2 + 0.5 * alone) / alone)) < 1e-9 and abs(bonus[1] - math.log(0.5)) < 1e-9 and bonus[2] == 0.0


def test_long_runs_are_cut(spark):
    """Runs of any length, in one row: words of a run of eighty keys."""
    words = spark.createDataFrame([("quan", 13.0, 5.0), ("hệ", 13.0, None), ("a", 14.0, None)], "word string, vi double, en double")
    pairs = spark.createDataFrame([("quan", "hệ", 0.4), ("hệ", "quan", 0.4)], "prev string, word string, p double")
    keys = spark.createDataFrame([("quanheej" * 10,), ("quanquan",), ("xyzzyxyz",)], "keys string")
    assert rows(rank.split_runs(keys, words, pairs)) == [("quanheej" * 10, " ".join(["quan hệ"] * 10))]


def test_decisions(spark):
    lex = spark.createDataFrame([(l, i, w, n) for i, (l, w, n) in enumerate(LEXICON)], "lexicon string, line_no long, word string, per_billion long")
    words = rank.languages(lex)
    typed = ["khoong", "khong", "teh", "Teh", "seperate", "untill", "khogn", "quanheej", "xyzzy", "ab", "jabc", "tieengs", "The", "mywrd", "igno", "x1y"]
    cases = spark.createDataFrame([(i, w, []) for i, w in enumerate(typed)] + [(90, "Khogn", ["the"]), (92, "vietj", ["until"]), (93, "vietj", [])], "case_id int, raw string, history array<string>")
    own = spark.createDataFrame([("mywrd", "my word"), ("igno", None)], "word string, fix string")
    pairs = spark.createDataFrame([("quan", "hệ", 0.4), ("của", "việt", 0.2)], "prev string, word string, p double")
    got = {r.case_id: (r.stage, r.fix) for r in rank.decide(cases, words, personal=own, bigrams=pairs).collect()}
    by = {w: got[i] for i, w in enumerate(typed)}
    assert by["khoong"][0] == by["tieengs"][0] == by["The"][0] == "known"
    assert by["khong"] == ("restored", "không") and by["teh"] == ("near", "the") and by["Teh"] == ("near", "The")
    assert by["untill"] == ("near", "until") and by["seperate"][1] in ("separate", None)
    assert by["khogn"][0] in ("near", "far") and by["khogn"][1] == "không" and by["quanheej"] == ("split", "quan hệ")
    assert by["xyzzy"] == ("none", None) and by["ab"][0] == by["x1y"][0] == "not scored" and by["jabc"][0] == "protected"
    assert by["mywrd"] == ("personal fix", "my word") and by["igno"] == ("personal ignore", None) and got[90] == ("name", None)
    assert got[92] == ("english phrase", None) and got[93] == ("near", "việt")
    # Without English a plain best candidate leaves the word alone, and without pairs nothing is cut.
    few = cases.where("raw in ('teh', 'khogn', 'quanheej')")
    code = {r.case_id: (r.stage, r.fix) for r in rank.decide(few, words, english=False).collect()}
    assert code[typed.index("teh")] == ("plain", None) and code[typed.index("khogn")] == ("plain", None) and code[typed.index("quanheej")] == ("none", None)
    votes = rank.history_votes(spark.createDataFrame([(1, ["the", "không"]), (2, ["zz"])], "k int, h array<string>"), "k", "h", words)
    assert [(r.k, round(r.vote, 6)) for r in votes.orderBy("k").collect()] == [(1, 0.3), (2, 0.0)]
    revised = spark.createDataFrame([(1, "việt", 9.0, 0.0, False), (1, "viet", 99.0, 0.0, False), (2, "hệ", 9.0, 0.0, True)], "k int, word string, score double, keep double, expanded boolean")
    assert rows(rank.revised(revised, ["k"])) == [(1, "việt")]


def test_curves(spark):
    random.seed(9)
    data = [(random.random(), random.randint(0, 3), random.choice([0, 1, None]), random.random() < 0.3) for _ in range(400)]
    d = spark.createDataFrame(data, "p double, pred int, gold int, is_error boolean")
    got = {r.threshold: r for r in evaluate.f1(evaluate.curve(d)).collect()}
    mistakes = sum(r[3] for r in data)
    for tau in evaluate.CURVE:
        changed = [r for r in data if r[0] >= tau]
        right = sum(r[3] and r[1] == r[2] for r in changed)
        r = got[tau]
        assert r.changed == len(changed) and abs(r.right_recall - right / max(1, mistakes)) < 1e-12 and abs(r.right_precision - right / max(1, len(changed))) < 1e-12
        assert abs(r.false_per_1000 - 1000 * sum(not x[3] for x in changed) / (len(data) - mistakes)) < 1e-9
    order = [got[t].changed for t in evaluate.CURVE]
    assert order == sorted(order, reverse=True)
    assert evaluate.curve(d.limit(0)).count() == 0
    p = evaluate.pick(spark.createDataFrame([("a", float(x)) for x in [5, 1, 1, 3, None or 9]] + [("b", 2.0), ("b", None)], "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95})
    assert rows(p) == [("a", 5, 3.0, 5.0), ("b", 1, 2.0, 2.0)]
    o = spark.createDataFrame([("a", "a", "a"), ("a", "a", "b"), ("a", "b", "a"), ("a", "b", "b"), ("a", "b", "c")], "i string, b string, s string")
    kinds = o.select(evaluate.outcomes(F.col("i"), F.col("b"), F.col("s"), F.lit(False), F.col("s")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["kept", "broken", "fixed", "missed", "wrong"]
    a = evaluate.audit_tally(spark.createDataFrame([(True, False, True), (True, True, True), (False, False, True), (True, True, False)], "is_error boolean, right boolean, taken_back boolean"))
    assert rows(a) == [(4, 1, 1, 1)]


def test_samples(spark):
    d = spark.createDataFrame([("hot" if i % 3 else f"s{i % 4}", i) for i in range(300)], "source string, line_no long")
    tail = defaultdict(list)
    for i in range(300):
        tail["hot" if i % 3 else f"s{i % 4}"].append(i)
    assert rows(sampling.training_slice(d, held_out=10)) == sorted((s, i) for s, x in tail.items() for i in x[:-10])
    assert sampling.training_slice(d, held_out=10, whole=("hot",)).where("source = 'hot'").count() == 200
    held = sampling.held_out_slice(d, held_out=25, limit=5)
    assert rows(held) == sorted((s, i) for s, x in tail.items() for k, i in enumerate(x[-25:]) if k % max(1, len(x[-25:]) // 5) == 0 and k // max(1, len(x[-25:]) // 5) < 5)
    capped = sampling.capped(d, ["source"], "line_no", 7)
    assert {r["source"]: r["count"] for r in capped.groupBy("source").count().collect()} == {s: 7 for s in tail}
    assert rows(capped) == rows(sampling.capped(d.repartition(9), ["source"], "line_no", 7))
    r = running(d.withColumn("one", F.lit(1)), ["source"], [F.col("line_no")], F.floor(F.col("line_no") / 17), F.col("one"), "n")
    assert rows(r, "source", "line_no", "n") == sorted((s, i, k + 1) for s, x in tail.items() for k, i in enumerate(x))
    import hashlib

    t = spark.createDataFrame([("a",), ("việt",), ("",)], "t string")
    assert [x.v for x in t.select(sampling.tenth(F.col("t")).alias("v")).collect()] == [int(hashlib.md5(s.encode()).hexdigest(), 16) % 10 for s in ("a", "việt", "")]
    pool = spark.createDataFrame([(1, p, f"{p}{k}", 1.0 + k, False, "tone", False) for p in range(4) for k in range(3)] + [(1, 9, "low", 0.1, True, "tone", False), (1, 8, "valid", 2.0, True, "tone", True)], "s int, p int, key string, margin double, seen boolean, kind string, valid boolean")
    picked = sampling.picked_errors(pool, "s", "p", "key", {"tone": 1.0}).collect()
    assert len(picked) == 2 and len({x.p for x in picked}) == 2 and not {"low", "valid"} & {x.key for x in picked}


def test_lexicons(spark):
    raw = spark.createDataFrame([("a", 1, "Một", 50), ("a", 2, "một", 70), ("a", 3, "# x", 9), ("a", 4, "hai", 0), ("b", 1, "hai", 30), ("b", 2, None, 3), ("b", 3, "x y", 5)], "lexicon string, line_no long, word string, per_billion long")
    assert rows(lexicon.parsed_lexicon(raw), "lexicon", "word", "id", "per_billion") == [("a", "một", 0, 50), ("b", "hai", 0, 30), ("b", "x y", 1, 5)]
    assert rows(lexicon.vocabulary(raw, 1)) == [(1, "một", 50)]
    c = spark.createDataFrame([("s", "a", 3), ("s", "b", 1), ("t", "a", 1)], "source string, word string, n long")
    assert rows(lexicon.combine(c)) == [("a", 875_000_000.0, 2), ("b", 125_000_000.0, 1)]
    assert rows(lexicon.combine(c.limit(0))) == []
    s = spark.createDataFrame([("- Xin chào bạn nhé.",), ("Câu 1:",), ("ba <b> chữ x y",), ("một hai ba bốn \" năm",), ("日本 một hai ba bốn",)], "t string")
    assert [r.x for r in s.select(lexicon.plain_sentence(F.col("t")).alias("x")).collect()] == [True, False, False, False, False]
    d = spark.createDataFrame([(3, "A b!"), (1, "a, B"), (2, "c")], "id long, text string")
    assert rows(lexicon.first_of_equal(d, "text", "id"), "id") == [(1,), (2,)]
    assert spark.range(1).select(lexicon.reply_lines(F.lit('1. "xin chào"\n- bạn\n\n')).alias("x")).first().x == ["xin chào", "bạn"]
    v = spark.range(1).select(lexicon.reply_versions(F.lit('ok\n{"typed": "a", "edits": [{"i": 0, "from": "b", "to": "a"}]}\n{"typed": "x"}\n{bad')).alias("x")).first().x
    assert [(o.typed, o.edits[0].to) for o in v] == [("a", "a")]


def test_mining(spark):
    a = [{"current_syllable": "Viet,", "is_correct": False, "alternative_syllables": ["Việt"]}, {"current_syllable": "ok", "is_correct": True, "alternative_syllables": []}, {"current_syllable": "x", "is_correct": False, "alternative_syllables": ["y", "z"]}]
    v = spark.createDataFrame([(1, a), (1, a), (None, a), (2, None)], "vsec_id long, annotations array<struct<current_syllable:string,is_correct:boolean,alternative_syllables:array<string>>>")
    f = mining.fixes(mining.syllables(v))
    assert rows(f) == [(1, 0, "viet", "việt")]
    m = mining.mined(f, spark.createDataFrame([("viet",)], "word string"))
    assert rows(m) == [("việt", "viet", "tone_drop", 1, True)] and rows(mining.operations(m)) == [("tone_drop", 1, 1)]
    assert mining.confusion_maps(m).first().confusions == {"viet": 1}
    e = "array<struct<i:int,`from`:string,`to`:string>>"
    good = (["một", "hai"], ["mot", "hai"], [(0, "một", "mot")], 1)
    bad = [(["một", "hai"], ["mot", "hoi"], [(0, "một", "mot")], 1), (["má", "hai"], ["mà", "hai"], [(0, "má", "mà")], 1), (["một"], ["mot", "x"], [(0, "một", "mot")], 1), (["hôi", "hoi"], ["hoi", "hoi"], [(0, "hôi", "hoi")], 4)]
    good = (["má", "hai"], ["ma", "hai"], [(0, "má", "ma")], 1)
    d = spark.createDataFrame([good, *bad], f"clean array<string>, typed array<string>, edits {e}, rule int")
    assert [r.typed for r in mining.verified(d).collect()] == [["ma", "hai"]]
    w = spark.createDataFrame([(1, 0, "an"), (1, 3, "bé")], "doc long, start long, token string")
    fit, rest = mining.annotate(w, spark.createDataFrame([(1, "3", "bé", ["be"]), (1, "4", "x", []), (1, "z", "an", [])], "doc long, start string, text string, suggest array<string>"), ["doc"])
    assert rows(fit, "token", "suggest") == [("an", None), ("bé", ["be"])] and rest.count() == 2
    t = spark.createDataFrame([(1, ["Một", "hai", "zz"] * 30)], "k long, t array<string>")
    c = mining.corrupted_tokens(t, "k", "t", spark.createDataFrame([("một",), ("hai",)], "word string"), 0.5)
    got = c.collect()
    assert len(got) == 90 and 10 < sum(r.kind is not None for r in got) < 50 and all(r.kind is None and r.shown == "zz" for r in got if r.token == "zz")


def test_journal(spark):
    j = [("u", 1, 0.0, "FIX", "teh", "the"), ("u", 2, 1.0, "UNDO", "teh", "the"), ("u", 3, 2.0, "UNDO", "teh", "the"), ("u", 4, 9.0, "FIX", "khogn", "không"), ("v", 1, 0.0, "FIX", "khogn", "không")]
    d = spark.createDataFrame(j, "user string, seq long, ts double, kind string, keys string, fix string")
    assert rows(journal.by_pair(d)) == [("khogn", "không", 2, 0), ("teh", "the", 1, 2)]
    assert rows(journal.report(d, 1)) == [("kept", 1, "khogn", "không", 2, 0), ("undone", 1, "teh", "the", 1, 2)]
    assert rows(journal.learned(d)) == [("u", "teh", 2)] and journal.undo_share(d).first().undos == 2
    c = d.withColumns({"left": F.lit("a b"), "context": F.lit("b"), "mode": F.lit(None).cast("string"), "app": F.lit("Code"), "right": F.lit(None).cast("string")})
    assert rows(journal.cases(c), "grp", "mode", "context", "expected", "level") == [("journal-kept", "code", "a b", "không", "must"), ("journal-undone", "en", "a b", "=", "goal")]
    e = spark.createDataFrame([("u", i, float(t), w, w == ".") for i, (t, w) in enumerate([(0, "a"), (1, "b"), (2, "."), (3, "c"), (70, "d"), (71, "e")])], "user string, seq long, ts double, w string, stop boolean").withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))
    f = journal.following(e, "user", ["seq"], "ts", "w", F.col("stop"))
    assert [r.right for r in f.orderBy("seq").collect()] == [["b", "."], ["."], [], [], ["e"], []]
    assert [r.next for r in journal.pending(e, "user", ["seq"], "w", F.col("stop")).orderBy("seq").collect()] == ["b", None, "c", "d", "e", None]
    s = journal.screen(spark.createDataFrame([("u", 1, 0, "teh"), ("u", 2, 2, "he "), ("v", 1, 5, "x")], "user string, seq long, backspaces int, text string"), "user", ["seq"], "backspaces", "text")
    assert rows(s) == [("u", "the "), ("v", "x")]
    k = journal.untracked(spark.createDataFrame([("u", i, x) for i, x in enumerate([2, -1, -3, 4])], "user string, seq long, step int"), "user", ["seq"], F.col("step"))
    assert [(r.committed, r.untracked) for r in k.orderBy("seq").collect()] == [(2, False), (1, False), (0, True), (4, False)]


def test_network(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    dim, classes = 8, 11
    shapes = {"grams": (64, dim), "in.weight": (dim, dim), "in.bias": (dim,), "shape": (6, dim), "place": (41, dim), "0.qkv.weight": (3 * dim, dim), "0.qkv.bias": (3 * dim,), "0.out.weight": (dim, dim), "0.out.bias": (dim,), "0.norm1.weight": (dim,), "0.norm1.bias": (dim,), "0.norm2.weight": (dim,), "0.norm2.bias": (dim,), "0.up.weight": (16, dim), "0.up.bias": (16,), "0.down.weight": (dim, 16), "0.down.bias": (dim,), "head.weight": (classes, dim), "head.bias": (classes,)}
    model = {k: rng.normal(size=s).astype(np.float32) for k, s in shapes.items()}
    data = neural.write_model(model)
    again = neural.read_model(data)
    assert again.keys() == model.keys() and all((again[k] == model[k]).all() for k in model)
    for broken in (b"XXXX" + data[4:], data + b"\0", data[:-3]):
        with pytest.raises(ValueError):
            neural.read_model(broken)
    d = spark.createDataFrame([(1, [[1, 2], [3], []], [0, 1, 4])], "id long, buckets array<array<int>>, shapes array<int>")
    got = neural.judge(d, again, "id", heads=2, top=3).orderBy("pos").collect()
    want = neural.forward(model, [[1, 2], [3], []], [0, 1, 4], 2)
    assert [r.pos for r in got] == [0, 1, 2] and np.allclose(np.exp(want).sum(-1), 1, atol=1e-5)
    assert [[c["class"] for c in r.top] for r in got] == [list(np.argsort(-row)[:3]) for row in want]


def test_learned_choice(spark):
    random.seed(11)
    data = []
    for i in range(200):
        gold = random.choice(["việt", "hệ"])
        for place, w in enumerate(("việt", "hệ")):
            data.append((i, gold[:-1] + "x", None, w, 5.0 if w == gold else 1.0, "near", place + 1, 2, 1.0, gold))
    d = spark.createDataFrame(data, "case_id int, typed string, typed_score double, word string, score double, stage string, place int, n int, gap double, golds string")
    f = learned.features(d)
    out = learned.decide(learned.fit(f), f).collect()
    golds = {r[0]: r[-1] for r in data}
    assert len(out) > 150 and sum(r.word == golds[r.case_id] for r in out) / len(out) > 0.95
