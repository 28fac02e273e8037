import math
import random

from lexiforge.llm import rankfuse


def place_order(scores, weights):
    n = len(scores[0])
    out = []
    for i in range(n):
        ranks = [1 + sum(x > s[i] for x in s) for s in scores]
        acc, median = 0.0, None
        for r, w in sorted(zip(ranks, weights)):
            acc += w
            if median is None and acc >= sum(weights) / 2:
                median = r
        out.append((median, sum(r * w for r, w in zip(ranks, weights)) / sum(weights), i))
    return [i for *_, i in sorted(out)]


def test_lists(spark):
    random.seed(2)
    rows = []
    for i in range(60):
        n = random.randint(0, 8)
        rows.append((i, *[[float(random.randint(0, 4)) for _ in range(n)] for _ in range(3)]))
    rows += [(90, None, [1.0], [1.0]), (91, [1.0], [float("nan")], [1.0]), (92, [1.0], [None], [1.0]), (93, [1.0], [1.0, 2.0], [1.0])]
    d = spark.createDataFrame(rows, "id int, a array<double>, b array<double>, c array<double>")
    for weights in ([1.0, 1.0, 1.0], [3.0, 1.0, 1.0]):
        got = {r.id: r.ranking for r in rankfuse.fuse_lists(d, ["a", "b", "c"], weights).collect()}
        for i, *scores in rows:
            if i >= 90:
                assert got[i] is None
            else:
                assert [x.pos for x in got[i]] == (place_order(scores, weights) if scores[0] else [])


def test_rows_with_a_hot_group_and_ties(spark):
    random.seed(4)
    rows = [("hot" if i % 3 else f"g{i % 5}", i, float(random.randint(0, 9)), random.random(), "x") for i in range(200)]
    rows += [("hot", 900, None, 1.0, "x"), ("hot", 901, float("nan"), 1.0, "x"), (None, 902, 1.0, 1.0, "x")]
    d = spark.createDataFrame(rows, "g string, item int, s double, r double, median string")
    got = rankfuse.fuse_rows(d, ["g"], "item", ["s", "r"]).collect()
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g and r[2] is not None and not math.isnan(r[2])]
        want = [own[i][1] for i in place_order([[r[2] for r in own], [r[3] for r in own]], [1, 1])]
        assert [r.item for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == want
    assert rankfuse.fuse_rows(d.limit(0), ["g"], "item", ["s", "r"]).count() == 0


def test_outvoted(spark):
    c = "id string, candidates array<struct<t:string,s:double,r:double>>, exported_at timestamp"
    t = "id string, model string, ll_left array<double>, ll_full array<double>, scored_at timestamp"
    a = [{"t": "a", "s": 2.0, "r": 2.0}, {"t": "b", "s": 1.0, "r": 1.0}]
    samples = spark.createDataFrame([("1", a, None), ("1", a, None), ("2", a, None), ("3", None, None)], c)
    teachers = spark.createDataFrame([("1", "m", [2.0, 1.0], [0.0, 99.0], None), ("2", "m", [2.0, 1.0], [3.0, 1.0], None), ("2", "n", [2.0], [3.0, 1.0], None), ("1", None, [2.0, 1.0], [0.0, 9.0], None)], t)
    f = rankfuse.fused_samples(samples, teachers)
    assert sorted((r.id, r.model) for r in f.collect()) == [("1", "m"), ("2", "m")]
    assert [tuple(r) for r in rankfuse.outvoted(f).collect()] == [("1", "m", 0)]
