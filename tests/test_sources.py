from pyspark.sql import functions as F

from lexiforge.sources import readers


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_word_counts(spark, tmp_path):
    write(tmp_path / "news-words.txt", "1\tmột\t5\n2\tmột\t3\n3\thai\tx\n4\ta b\t2\nbroken\n")
    write(tmp_path / "subs-words.txt", "một 7\nba bốn 3\nnăm\n\n")
    write(tmp_path / "other.txt", "x 1\n")
    assert rows(readers.word_counts(spark, str(tmp_path))) == [("news", "a b", 2), ("news", "một", 8), ("subs", "một", 7)]


def test_sentences_and_lexicon(spark, tmp_path):
    write(tmp_path / "web-sentences.txt", "1\tXin chào.\n2\n3\tBa\tbốn\n")
    assert rows(readers.sentences(spark, str(tmp_path))) == [("web", 1, "1", "Xin chào."), ("web", 2, "2", ""), ("web", 3, "3", "Ba\tbốn")]
    assert readers.sentences(spark, str(tmp_path / "none")).count() == 0
    p = write(tmp_path / "vi.tsv", "# c\nmột\t5\nhai\tx\nba\t0\nbốn\t2.5\n")
    d = readers.lexicon(spark, p)
    assert rows(d) == [("vi", 2, "một", 5.0), ("vi", 5, "bốn", 2.5)]
    out = str(tmp_path / "out")
    readers.write_lexicon(spark.createDataFrame([("b", 2.4), ("a", 9.6), ("c", 9.6)], "word string, per_billion double"), out)
    assert [r.value for r in spark.read.text(out).collect()] == ["# word\tper billion words", "a\t10", "c\t10", "b\t2"]


def test_small_tables(spark, tmp_path):
    m = write(tmp_path / "m.tsv", "# x\nTeh\tthe\nab\tx\ntoans\ttoán\n")
    assert rows(readers.misspellings(spark, m)) == [("teh", "the")]
    p = write(tmp_path / "p.tsv", "ignore\tFoo\nfix\tteh\tThe\nfix\tteh\tthe\nfix\tx\t\nignore\tteh\nbad\ty\n")
    assert {(r.word, r.fix) for r in readers.personal(spark, p).collect()} == {("foo", None), ("teh", "the")}
    a = readers.app_policy(spark, write(tmp_path / "a.tsv", "code\tX.exe\noff\tx.exe\nnoguard\tx.exe\nwhat\ty.exe\n"))
    assert rows(a) == [("x.exe", "off", False)]
    builtin = spark.createDataFrame([("x.exe", "code", True), ("z.exe", "code", None)], "exe string, mode string, guard boolean")
    apps = spark.createDataFrame([("X.EXE",), ("z.exe",), ("q.exe",)], "exe string")
    assert rows(readers.classify_apps(apps, a, builtin)) == [("X.EXE", "off", False), ("q.exe", "normal", True), ("z.exe", "code", True)]
    s = readers.settings("english=0\nmethod=vni\npreset=wild\ntau=2\n\nnoise\nvietnamese=yes")
    assert (s["english"], s["method"], s["preset"], s["tau"], s["vietnamese"]) == (False, "vni", "balanced", 0.999, True)
    k, h = readers.keyboard(spark, write(tmp_path / "k.json", '{"min_overlap": 0.15,\n"keys": [{"name": "a", "x0": 0, "x1": 1, "y0": 0, "y1": 1}], "habits": {"a": {"partners": "qs", "heavy": "s"}}}'))
    assert rows(k) == [("a", 0.0, 1.0, 0.0, 1.0)] and rows(h) == [("a", "qs", "s")]


def test_json_and_cases(spark, tmp_path):
    j = write(tmp_path / "x.jsonl", '{"id": "1", "set": "vi", "candidates": [{"t": "a", "s": 1.5}]}\n\nbroken{\n{"id": "2"}\n')
    d = readers.json_lines(spark, j, readers.EXPORT)
    assert rows(d, "id") == [("1",), ("2",)]
    readers.write_json_lines(d, str(tmp_path / "o"))
    assert rows(readers.shards(spark, [str(tmp_path / "o")], readers.EXPORT), "id", F.col("candidates")[0]["s"]) == [("1", 1.5), ("2", None)]
    assert readers.as_json(spark.createDataFrame([('a"\n',)], "x string")).first().line == '{"x":"a\\"\\n"}'
    c = spark.createDataFrame([("s", 1, "a \"b", "x", "x|y", 1), ("s", 2, None, "z", "z", 0)], "source string, id long, history string, typed string, gold string, is_error int")
    readers.write_cases(c, str(tmp_path / "c"))
    assert rows(readers.cases(spark, str(tmp_path / "c")), "id", "history", "gold") == [(1, 'a "b', "x|y"), (2, None, "z")]


def test_models_and_journal(spark, tmp_path):
    m = spark.createDataFrame([("b", "w", 5), ("a", "w", 6)], "b string, w string, q int")
    readers.write_model({"pairs": m}, str(tmp_path / "m"), 10)
    assert rows(readers.read_model(spark, str(tmp_path / "m"), "pairs", 10)) == [("a", "w", 6), ("b", "w", 5)]
    assert readers.read_model(spark, str(tmp_path / "m"), "pairs", 11).count() == 0
    j = spark.createDataFrame([(1, "FIX", None)], "ts long, kind string, fix string")
    path = str(tmp_path / "j")
    assert readers.append_journal(j, path) and readers.append_journal(j, path) and not readers.append_journal(j, path, 5)
    assert [r.value for r in spark.read.text(path).collect()] == ["1\tFIX\t"] * 2
