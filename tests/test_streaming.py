import json
import random
import time

from pyspark.sql import functions as F

from lexiforge.streaming import engine, windows

CORRECTOR = engine.TableCorrector({"teh": "the", "khogn": "không", "quanheej": "quan hệ"}, {"that là": "thật"})


def play(keys, **kw):
    """Keys: letters, ' ', punctuation, < backspace, ^ undo, # reset, % select all."""
    t = engine.Typing(CORRECTOR, "u", **kw)
    out = []
    kinds = {" ": "space", "<": "backspace", "^": "undo", "#": "reset", "%": "select_all"}
    screen = ""
    for n, c in enumerate(keys):
        got = t.press(n, float(n), kinds.get(c, "char" if c.isalpha() else "punct"), c)
        action = next((r for r in got if r["row"] == "action"), None)
        if action:
            screen = screen[: len(screen) - action["backspaces"]] + action["text"]
        if c == "<":
            screen = screen[:-1]
        elif c not in "^#%" and not (action and c.isalpha() or action and c == " "):
            screen += c
        out += got
    return screen, out, t


def kinds(out, row="journal"):
    return [(r["kind"], r["keys"], r["fix"]) for r in out if r["row"] == row]


def test_composition_and_correction():
    assert play("vieetj nam ")[0] == "việt nam " and play("teh cat ")[0] == "the cat " and play("teh, ")[0] == "the, "
    assert play("vieetj", vietnamese=False)[0] == "vieetj" and play("tesst ")[0] == "test "
    assert play("quanheej ")[0] == "quan hệ "


def test_undo_is_learned():
    screen, out, t = play("teh ^teh ^teh ")
    screen, out, t = play("teh ^a teh ^b teh c ")
    assert screen.startswith("teh a teh b teh c") and t.s["undos"] == {"teh": 2}
    assert [r["keys"] for r in out if r["row"] == "learned"] == ["teh"]
    assert [k for k, *_ in kinds(out, "decision")].count("ignored") == 1


def test_undo_right_after_is_left_alone():
    assert [k for k, *_ in kinds(play("teh ^<< teh ")[1], "decision")][0] == "corrected"


def test_late_revision():
    screen, out, _ = play("that laf nhe. ")
    assert screen == "thật là nhe. " and ("LATE", "that", "thật") in kinds(out)
    assert play("that, laf ")[0] == "that, là "


def test_backspace_and_untracked():
    screen, out, t = play("abc <<d ")
    assert screen == "abd " and [k for k, *_ in kinds(out, "decision")] == ["none", "none"]
    assert ("EDIT", "abc", "abd") in [(w["kind"], w["keys"], w["fix"]) for w in t.s["waiting"]]
    assert [k for k, *_ in kinds(play("<teh ")[1], "decision")] == ["untracked"]
    assert [k for k, *_ in kinds(play("ab <<<teh ")[1], "decision")][-1] == "corrected"
    assert play("ab%<teh ")[2].s["typed"] == 4


def test_journal_waits_for_the_words_that_follow():
    _, out, t = play("teh a b c ")
    j = [r for r in out if r["row"] == "journal"]
    assert [(r["kind"], r["right"]) for r in j] == [("FIX", "a b c")] and not t.s["waiting"]
    assert [r["right"] for r in play("teh a. b ")[1] if r["row"] == "journal"] == ["a"]
    assert [r["right"] for r in play("teh a #")[1] if r["row"] == "journal"] == ["a"]
    t = engine.Typing(CORRECTOR, "u")
    for n, c in enumerate("teh"):
        t.press(n, float(n), "char", c)
    t.press(3, 3.0, "space", " ")
    assert [r["row"] for r in t.press(4, 100.0, "char", "x")] == ["journal"]


def events(seed=1, users=12):
    random.seed(seed)
    rows = []
    for u in range(users):
        for n in range(random.randint(5, 60)):
            c = random.choice(["t", "e", "h", "teh ", "khogn ", " ", "<", "^", "that laf ", "."])
            for k in c:
                kind = {" ": "space", "<": "backspace", "^": "undo", ".": "punct"}.get(k, "char")
                rows.append((f"u{u}", len(rows), float(len(rows)), kind, k))
    return rows


def test_replay_does_not_depend_on_partitions(spark):
    rows = events()
    d = spark.createDataFrame([*rows, (None, 1, 1.0, "char", "x"), ("u1", None, 1.0, "char", "x")], engine.EVENTS)
    want = []
    for u in sorted({r[0] for r in rows}):
        t = engine.Typing(CORRECTOR, u)
        for _, seq, ts, kind, ch in (r for r in rows if r[0] == u):
            want += t.press(seq, ts, kind, ch)
        want += engine._end(t)
    key = lambda r: (r["user"], r["seq"], r["row"], r["kind"], json.dumps(r, sort_keys=True))
    got = [r.asDict() for r in engine.replay(d.repartition(5), CORRECTOR).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert engine.replay(d.limit(0), CORRECTOR).count() == 0


def test_stream_equals_replay(spark, tmp_path):
    rows = events(2, 5)
    d = spark.createDataFrame(rows, engine.EVENTS)
    half = len(rows) // 2
    for k, part in enumerate((d.where(F.col("seq") < half), d.where(F.col("seq") >= half))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = engine.stream(s, CORRECTOR).writeStream.format("memory").queryName("typed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        # A query with processing-time timeouts always has another batch to run, so it is never idle.
        end = time.time() + 90
        while sum(p.numInputRows for p in q.recentProgress) < len(rows) and time.time() < end:
            time.sleep(0.5)
        got = spark.table("typed").where("row in ('decision', 'learned', 'action')").collect()
    finally:
        q.stop()
    want = engine.replay(d, CORRECTOR).where("row in ('decision', 'learned', 'action')").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_two_lanes():
    rows = engine.two_lanes([["the", "cat", "khong"]], CORRECTOR, [["teh", "cat", "khogn"]])
    assert [r["outcome"] for r in rows] == ["fixed", "kept", "wrong"]


def test_windows_and_current_tables(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0), ("2024-01-01 01:00:00", "b", None)], "ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.kind, r.n, r.total) for r in windows.counts_by_window(d, "ts", "kind", "value").collect()) == [("a", 2, 3.0), ("b", 1, None)]
    seen, tables = [], [spark.createDataFrame([("a", 1)], "kind string, x int"), spark.createDataFrame([("a", 2)], "kind string, x int")]
    each = windows.with_current(lambda: tables.pop(0), "kind", lambda batch, n: seen.append(sorted({r.x for r in batch.collect() if r.x})))
    each(d, 0)
    each(d, 1)
    assert seen == [[1], [2]]


def test_cases_are_corrected_by_their_training_split(spark):
    from lexiforge.plans.catalog import _replayed

    rows = [(1, "vsec_train", None, "khogn", "không"), (2, "vsec_train", "", "khogn\u00a0", "không"), (3, "vsec_train", "", "nhà", "nhà"), (4, "viwiki", "khogn  nhà", "khogn", "không"), (5, "viwiki", "a, b", "khogn", "khống"), (6, "viwiki", "", "b2-x", "b2-x")]
    got = _replayed(spark.createDataFrame(rows, "case_id long, source string, history string, typed string, gold string")).collect()
    of = lambda user, row: [(r.kind, r.keys, r.fix) for r in sorted(got, key=lambda r: r.seq) if r.user == user and r.row == row]
    fixed = ("corrected", "khogn", "không")
    assert of("c4", "decision") == [fixed, ("none", "nhaf", "nhà"), fixed]
    assert [(r.kind, r.left, r.right) for r in sorted(got, key=lambda r: r.seq) if r.user == "c4" and r.row == "journal"] == [("FIX", "", "nhà không"), ("FIX", "không nhà", "")]
    assert [k for k, *_ in of("c5", "journal")] == ["FIX", "UNDO"] and of("c5", "decision")[-1] == fixed
    assert [k for _, k, _ in of("c6", "decision")] == ["b2", "x"] and {r.user for r in got} == {f"c{i}" for i in range(1, 7)}
    assert [(r.backspaces, r.text) for r in got if r.user == "c1" and r.row == "action"] == [(3, "ông ")]
