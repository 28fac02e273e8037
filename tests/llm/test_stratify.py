import hashlib
import random

import pytest

from lexiforge.llm.stratify import Stratified


def naive(cells, size):
    """Records as (beyond the minimum, priority, cell, rank), the smallest `size` of them."""
    rows = []
    for name, (n, share, least) in cells.items():
        for rank in range(1, n + 1):
            if rank <= least or share > 0:
                rows.append((rank > least, (rank - 0.5) / share if share > 0 else float("inf"), name, rank))
    taken = sorted(rows)[:size]
    return {name: sum(r[2] == name for r in taken) for name in cells}


def test_seats_equal_the_smallest_priorities(spark):
    random.seed(1)
    for _ in range(4):
        cells = {f"k{i}": (random.randint(0, 40), random.choice([0.0, 0.1, 0.25, 0.5]), random.randint(0, 5)) for i in range(6)}
        size = random.randint(0, 60)
        d = spark.createDataFrame([(f"{c}-{i}", c) for c, (n, *_) in cells.items() for i in range(n)], "id string, kind string")
        t = spark.createDataFrame([(c, s, m) for c, (_, s, m) in cells.items()], "kind string, share double, min_rows long")
        s = Stratified(d, "id", ["kind"], t, size=size)
        assert {r.kind: r.seats for r in s.report().collect()} == naive(cells, size)
        # Within a category the first by hash are taken.
        rows = {r.id for r in s.sample().collect()}
        for c, (n, *_) in cells.items():
            order = sorted((hashlib.md5(f"7{c}-{i}".encode()).hexdigest(), f"{c}-{i}") for i in range(n))
            assert {k for _, k in order[: naive(cells, size)[c]]} == {k for k in rows if k.startswith(c + "-")}


@pytest.fixture
def data(spark):
    rows = [(f"v{i}", " VI", "One slip", "x") for i in range(300)] + [(f"e{i}", "en", "one_slip", "x") for i in range(10)] + [(f"c{i}", "vi", "CLEAN", "x") for i in range(50)]
    rows += [("v0", "vi", "one-slip", "x"), (None, "vi", "clean", "x"), ("n1", None, "clean", "x"), ("n2", "zz", "clean", "x")]
    targets = [("vi", "one-slip", 0.3, 5), ("en", "one-slip", 0.4, 5), ("vi", "clean", 0.2, 5), ("en", "clean", 0.1, 7), (None, "clean", 0.1, 1)]
    return spark.createDataFrame(rows, "id string, set string, class string, seats string"), spark.createDataFrame(targets, "set string, class string, share double, min_rows long")


def test_sample_and_report(data):
    s = Stratified(data[0], "id", ["set", "class"], data[1])
    assert s.size == 90
    r = {(x["set"], x["class"]): x for x in s.report().collect()}
    assert {k: (x.available, x.short) for k, x in r.items()} == {("vi", "one-slip"): (300, False), ("en", "one-slip"): (10, True), ("vi", "clean"): (50, False), ("en", "clean"): (0, True)}
    rows = s.sample().collect()
    assert len(rows) == len({x.id for x in rows}) == 90
    for k, x in r.items():
        assert sum((y["set"], y["class"]) == k for y in rows) == x.seats
    again = Stratified(data[0].repartition(9), "id", ["set", "class"], data[1]).sample().collect()
    assert sorted(rows) == sorted(again)


def test_targets_of_one_spelling_add_up(spark, data):
    t = spark.createDataFrame([("vi", "one-slip", 0.25, 2), ("VI ", "one_slip", 0.25, 1), ("vi", "clean", None, None)], "set string, class string, share double, min_rows long")
    r = {(x["set"], x["class"]): x for x in Stratified(data[0], "id", ["set", "class"], t, size=20).report().collect()}
    assert {k: (x.share, x.min_rows, x.seats, x.short) for k, x in r.items()} == {("VI ", "one-slip"): (0.5, 3, 20, False), ("vi", "clean"): (0.0, 0, 0, False)}


def test_empty(data):
    s = Stratified(data[0].limit(0), "id", ["set", "class"], data[1])
    assert s.size == 0 and s.sample().count() == 0 and {(x["set"], x["class"]): x.short for x in s.report().collect()} == {("vi", "one-slip"): True, ("en", "one-slip"): True, ("vi", "clean"): True, ("en", "clean"): True}
    none = Stratified(data[0], "id", ["set", "class"], data[1].limit(0))
    assert none.sample().count() == 0 and none.report().count() == 0
