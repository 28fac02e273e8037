"""Mistakes mined from corrected text, and windows to learn from."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.corrupt import RULES
from ..functions.edits import slip_kind
from ..functions.text import core_split, match_case, nfc


def syllables(vsec: DataFrame) -> DataFrame:
    """(vsec_id, pos, current, correct, alternatives) of each record, once."""
    one = vsec.where("vsec_id is not null").groupBy("vsec_id").agg(F.first("annotations").alias("annotations"))
    return one.select("vsec_id", F.posexplode("annotations").alias("pos", "a")).select("vsec_id", "pos", F.col("a.current_syllable").alias("current"), F.col("a.is_correct").alias("correct"), F.col("a.alternative_syllables").alias("alternatives"))


def fixes(rows: DataFrame) -> DataFrame:
    """(vsec_id, pos, wrong, right): mistakes with exactly one alternative, as lower-case NFC cores."""
    d = rows.where("correct = false and size(alternatives) = 1 and current is not null and alternatives[0] is not null")
    core = lambda c: F.lower(core_split(nfc(c))["core"])
    return d.select("vsec_id", "pos", core("current").alias("wrong"), core(F.col("alternatives")[0]).alias("right"))


def mined(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(right, wrong, kind, n, valid): confusions that are one slip, with how often they occur and
    whether the wrong form is a known word. Each distinct pair is classified once."""
    d = pairs.groupBy("right", "wrong").agg(F.count("*").alias("n")).withColumn("kind", slip_kind("wrong", "right")).where("kind is not null")
    return d.join(known.select(F.col("word").alias("wrong"), F.lit(True).alias("_v")), "wrong", "left").select("right", "wrong", "kind", "n", F.coalesce("_v", F.lit(False)).alias("valid"))


def operations(mined_: DataFrame) -> DataFrame:
    """(kind, n, valid)."""
    return mined_.groupBy("kind").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("valid"), F.col("n")).otherwise(0)).alias("valid"))


def confusion_maps(mined_: DataFrame) -> DataFrame:
    """M7: (right, confusions): map of wrong forms to counts."""
    return mined_.groupBy("right").agg(F.map_from_entries(F.collect_list(F.struct("wrong", "n"))).alias("confusions"))


def negatives(words: DataFrame, confusions: DataFrame, siblings: DataFrame, made: DataFrame, limit: int = 8) -> DataFrame:
    """(gold, wrong, kind, seen): up to four seen confusions, then made ones, then up to two words
    of the same letters; each wrong form once, the first source wins, `limit` in all.
    All are (gold, wrong, kind, weight) but words (gold)."""
    from ..operators.sampling import hashed, top_k

    def part(df: DataFrame, source: int, most: int) -> DataFrame:
        d = top_k(df.join(words, "gold", "left_semi"), ["gold"], [F.desc("weight"), hashed(F.concat_ws("|", "gold", "wrong"), "n"), F.col("wrong")], most, "_p")
        return d.select("gold", "wrong", "kind", F.lit(source).alias("_s"), "_p")

    d = part(confusions, 0, 4).unionByName(part(made, 1, limit - 2)).unionByName(part(siblings, 2, 2)).where("wrong != gold and coalesce(kind, '') != 'tone_convention'")
    d = d.groupBy("gold", "wrong").agg(F.min_by(F.struct("kind", "_s", "_p"), F.struct("_s", "_p")).alias("x"))
    d = d.select("gold", "wrong", F.coalesce("x.kind", F.lit("substitute")).alias("kind"), (F.col("x._s") == 0).alias("seen"), "x._s", "x._p")
    return top_k(d, ["gold"], [F.col("_s"), F.col("_p"), F.col("wrong")], limit, "place").select("gold", "wrong", "kind", "seen", "place")


def diff(clean: Column, typed: Column) -> Column:
    """M8: the places (from 0) where two token arrays of one length differ; null for other lengths."""
    pairs = F.zip_with(clean, typed, lambda a, b: ~a.eqNullSafe(b))
    return F.when(F.size(clean) == F.size(typed), F.filter(F.transform(pairs, lambda x, i: F.when(x, i)), lambda i: i.isNotNull()))


#: Short forms of chat, which are no mistakes.
CHAT_FORMS = "ko k dc đc đk dk vs j ntn ròi hok hông z".split()


@F.arrow_udf(T.BooleanType())
def rule_accepts(rules: pa.Array, right: pa.Array, wrong: pa.Array) -> pa.Array:
    """Whether the checker of a rule takes (right, wrong) for one of its mistakes."""
    checks = {r.id: r.check for r in RULES}
    rows = zip(rules.to_pylist(), right.to_pylist(), wrong.to_pylist())
    return pa.array([bool(r in checks and a and b and a != b and checks[r](a, b)) for r, a, b in rows], pa.bool_())


def verified(df: DataFrame, rule: str = "rule", low: int = 1, high: int = 2) -> DataFrame:
    """Rows (clean, typed: token arrays, edits: array of (i, from, to), rule) whose listed edits
    are exactly their differences, each a mistake of the rule, of letters and digits, no chat form and
    no other word of the sentence."""
    changed = diff(F.col("clean"), F.col("typed"))
    listed = F.array_sort(F.transform("edits", lambda e: e["i"]))
    d = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_c", changed).where(F.size("_c").between(low, high) & (F.col("_c") == listed))
    e = d.select("_id", rule, "clean", "typed", F.explode("edits").alias("e"))
    a, b = F.get("clean", F.col("e.i")), F.get("typed", F.col("e.i"))
    others = F.transform(F.filter("clean", lambda t: t != a), lambda t: F.lower(t))
    ok = (F.col("e.from") == a) & (F.col("e.to") == b) & a.rlike(r"^\p{L}+$") & b.rlike(r"^[\p{L}\p{N}]+$") & ~F.lower(b).isin(*CHAT_FORMS) & ~F.array_contains(others, F.lower(b))
    good = e.withColumn("_ok", ok & rule_accepts(F.col(rule), F.lower(a), F.lower(b))).groupBy("_id").agg(F.bool_and("_ok").alias("_ok")).where("_ok").select("_id")
    return d.join(good, "_id", "left_semi").drop("_id", "_c")


def corrupted_tokens(df: DataFrame, key: str, tokens: str, known: DataFrame, rate: float, seed: str = "7") -> DataFrame:
    """F21 on texts: (key, pos, token, shown, kind): known words become mistakes at a rate, by the hash
    of text and place; the others stay, kind null."""
    from ..functions.corrupt import corrupted
    from ..session import small
    from .sampling import hashed

    d = df.select(key, F.posexplode(tokens).alias("pos", "token")).withColumn("word", F.lower("token"))
    place = F.concat_ws("/", key, "pos")
    u = F.conv(F.substring(hashed(place, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    d = d.join(small(known.select("word", F.lit(True).alias("_k"))), "word", "left").withColumn("_draw", F.col("_k").isNotNull() & (u < rate))
    made = d.where("_draw").withColumn("m", corrupted("word", place))
    made = made.select(key, "pos", "token", F.coalesce(match_case(F.col("token"), F.col("m.wrong")), F.col("token")).alias("shown"), F.col("m.kind").alias("kind"))
    return made.unionByName(d.where("not _draw").select(key, "pos", "token", F.col("token").alias("shown"), F.lit(None).cast("string").alias("kind")))


def annotate(words: DataFrame, mistakes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Words (keys, start, token) with the suggestions of mistakes (keys, start, text, suggest) that
    begin there and have that text; and the mistakes that fit no word (J4)."""
    m = mistakes.withColumn("start", F.try_to_number(F.col("start").cast("string"), F.lit("999999999999")).cast("long"))
    on = [*keys, "start", "token"]
    m = m.withColumnRenamed("text", "token")
    return words.join(m, on, "left"), m.join(words, on, "left_anti")
