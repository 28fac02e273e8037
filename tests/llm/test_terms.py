import random
from collections import Counter, defaultdict

from lexiforge.llm import terms


def brute(rows, max_n):
    total, count, records = Counter(), Counter(), defaultdict(set)
    for record, words, weight in rows:
        words = [w for w in words or [] if w is not None]
        for n in range(1, max_n + 1):
            for i in range(len(words) - n + 1):
                g = tuple(words[i : i + n])
                total[g] += weight or 0
                count[g] += 1
                records[g].add(record)
    return {g: (len(g), total[g], count[g], len(records[g])) for g in count}


def test_ngrams_equal_brute_force(spark):
    random.seed(5)
    rows = [(random.choice(["a", "b", "c", None]), [random.choice(["x", "y", "z", None]) for _ in range(random.randint(0, 9))], random.choice([1, 2, None])) for _ in range(120)]
    rows += [("a", None, 1), ("hot", ["x"] * 400, 3)]
    d = spark.createDataFrame(rows, "source string, words array<string>, n long")
    for max_n in (1, 3):
        for parts in (1, 5):
            got = terms.ngram_frequencies(d.repartition(parts), "source", "words", "n", max_n)
            assert {tuple(r.gram): (r.n, r.total, r.rows, r.records) for r in got.collect()} == brute(rows, max_n)


def test_without_weight_and_empty(spark):
    d = spark.createDataFrame([(1, ["x", "x"], "k"), (1, ["x"], "k")], "gram long, words array<string>, total string")
    assert [tuple(r)[1:] for r in terms.ngram_frequencies(d, "gram", "words").collect()] == [(1, 3, 3, 1)]
    assert terms.ngram_frequencies(d.limit(0), "gram", "words", max_n=2).count() == 0


def test_marks(spark):
    rows = [(f"s{i}", " Và", 900) for i in range(3)] + [("s0", "và", 100), ("s0", "hiếm", 4), ("s1", "vừa", 5), ("s1", None, 9), ("s2", " ", 9), ("s2", "bad", 0), ("s2", "bad", None), ("s0", "hai", 2), ("s1", "hai", 2)]
    c = spark.createDataFrame(rows, "source string, word string, n long")
    got = {r.word: (r.total, r.rows, r.records, r.mark) for r in terms.marked_counts(c).collect()}
    assert got == {"và": (2800, 4, 3, "common"), "hiếm": (4, 1, 1, "rare"), "vừa": (5, 1, 1, None), "hai": (4, 2, 2, None)}
    lex = [(f"l{i}", 1, "là", 5) for i in range(7)] + [("l0", 2, "một", 3), ("l0", 3, "đôi", 3), ("l0", 4, "đôi", 3), ("l0", 5, "# note", 7), ("l1", 6, "không", None)]
    x = spark.createDataFrame(lex, "lexicon string, line_no long, word string, per_billion long")
    assert {r.word: r.mark for r in terms.marked_lexicon(x).collect()} == {"là": "common", "một": "rare", "đôi": None}
    assert terms.marked_words(c.limit(0), x.limit(0)).count() == 0
