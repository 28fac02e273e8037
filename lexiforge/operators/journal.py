"""The journal of corrections: reports, cases, learned words, words that follow (A19, J5, ST3-ST9).

A journal has rows (user, ts, seq, kind, keys, fix, ...). Windows run per user, the natural unit of
an event stream; a user's events are in the order of (ts, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ranged, running


def by_pair(journal: DataFrame) -> DataFrame:
    """(keys, fix, fixed, undone)."""
    return journal.groupBy("keys", "fix").agg(F.count_if(F.col("kind") == "FIX").alias("fixed"), F.count_if(F.col("kind") == "UNDO").alias("undone"))


def report(journal: DataFrame, k: int = 20) -> DataFrame:
    """(list, place, keys, fix, fixed, undone): the k most undone pairs, and the k most frequent never undone."""
    d = by_pair(journal)
    most = d.where("undone > 0").orderBy(F.desc("undone"), F.desc("fixed"), "keys", "fix").limit(k).withColumn("list", F.lit("undone"))
    kept = d.where("undone = 0").orderBy(F.desc("fixed"), "keys", "fix").limit(k).withColumn("list", F.lit("kept"))
    w = W.partitionBy("list").orderBy(F.desc("undone"), F.desc("fixed"), "keys", "fix")
    return most.unionByName(kept).select("list", F.row_number().over(w).alias("place"), "keys", "fix", "fixed", "undone")


def undo_share(journal: DataFrame) -> DataFrame:
    return journal.agg(F.count_if(F.col("kind") == "FIX").alias("fixes"), F.count_if(F.col("kind") == "UNDO").alias("undos")).withColumn("percent", 100 * F.col("undos") / F.greatest("fixes", F.lit(1)))


def cases(journal: DataFrame) -> DataFrame:
    """J5, journal to cases: distinct corrections; those whose pair was ever undone are expected to be
    left alone. A missing mode is guessed from the fix; code in a Vietnamese mode is `code`."""
    d = journal.where("kind in ('FIX', 'UNDO')")
    undone = d.where("kind = 'UNDO'").select("keys", "fix").distinct().withColumn("_u", F.lit(True))
    context = F.coalesce(F.nullif("left", F.lit("")), F.col("context"), F.lit(""))
    mode = F.coalesce(F.nullif("mode", F.lit("")), F.when(F.col("fix").rlike("^[\\x00-\\x7F]*$"), "en").otherwise("vi"))
    app = F.coalesce("app", F.lit("Normal"))
    d = d.select("keys", "fix", context.alias("context"), F.when((app == "Code") & (mode == "vi"), "code").otherwise(mode).alias("mode"), app.alias("app"), F.coalesce("right", F.lit("")).alias("right")).distinct()
    d = d.join(undone, ["keys", "fix"], "left")
    bad = F.coalesce("_u", F.lit(False))
    return d.select(F.when(bad, "journal-undone").otherwise("journal-kept").alias("grp"), "mode", "context", F.col("keys").alias("typed"), F.when(bad, "=").otherwise(F.col("fix")).alias("expected"), F.when(bad, "goal").otherwise("must").alias("level"), "app", "right")


def learned(journal: DataFrame, after: int = 2) -> DataFrame:
    """ST4: (user, keys): words whose correction a user undid so often that they are ignored from then on."""
    return journal.where("kind = 'UNDO'").groupBy("user", F.lower("keys").alias("keys")).agg(F.count("*").alias("undos")).where(F.col("undos") >= after)


def sessions(events: DataFrame, user: str, order: list[str], resets: Column, out: str = "session") -> DataFrame:
    """ST7: adds the number of resets so far; a reset begins a session. Sums are carried over ranges of
    (user, order), so a user with a third of all events is spread."""
    order_ = [F.col(c) for c in order]
    d = ranged(events.withColumn("_reset", F.coalesce(resets, F.lit(False)).cast("int")), F.col(user), *order_)
    return running(d, [user], order_, F.col("_range"), F.col("_reset"), out).drop("_reset", "_range")


def following(events: DataFrame, user: str, order: list[str], ts: str, word: str, ends: Column, n: int = 3, seconds: int = 60) -> DataFrame:
    """ST8 in batch: adds `right`: up to n following words of the user within the time, not past the end of a sentence."""
    w = W.partitionBy(user).orderBy(*order)
    up_to = w.rowsBetween(W.unboundedPreceding, 0)
    d = events.withColumn("_ends", F.sum(F.coalesce(ends, F.lit(False)).cast("int")).over(up_to)).withColumn("_s", F.col("_ends") - F.coalesce(ends, F.lit(False)).cast("int"))
    # The row that ends a sentence still belongs to it.
    nxt = [F.struct(F.lead(word, k).over(w).alias("w"), F.lead("_s", k).over(w).alias("s"), F.lead(ts, k).over(w).alias("t")) for k in range(1, n + 1)]
    d = d.withColumn("_n", F.array(*nxt))
    ok = F.filter("_n", lambda x: (x["s"] == F.col("_s")) & (x["t"].cast("timestamp").cast("double") - F.col(ts).cast("timestamp").cast("double") < seconds))
    return d.withColumn("right", F.transform(ok, lambda x: x["w"])).drop("_n", "_s", "_ends")


def pending(events: DataFrame, user: str, order: list[str], word: str, breaks: Column) -> DataFrame:
    """ST3: adds `next`: the word after, by which a word is looked at again; null before a break."""
    w = W.partitionBy(user).orderBy(*order)
    d = events.withColumn("_b", F.coalesce(breaks, F.lit(False)))
    return d.withColumn("next", F.when(~F.lead("_b").over(w), F.lead(word).over(w))).drop("_b")


def manual_edits(events: DataFrame, before: str, after: str, most: int = 3) -> DataFrame:
    """ST6: rows whose word came back changed by a few letters."""
    return events.where((F.col(before) != F.col(after)) & (F.levenshtein(before, after) <= most) & (F.col(after) != ""))


def untracked(events: DataFrame, user: str, order: list[str], step: Column) -> DataFrame:
    """ST5: adds `committed`, the characters known on screen: the running sum of steps (+ typed, - deleted)
    above its lowest point so far, and `untracked` where deleting went past what was typed."""
    w = W.partitionBy(user).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = events.withColumn("_sum", F.sum(step).over(w))
    d = d.withColumn("_low", F.least(F.min("_sum").over(w), F.lit(0)))
    before = F.coalesce(F.lag("_low").over(W.partitionBy(user).orderBy(*order)), F.lit(0))
    return d.withColumn("committed", F.col("_sum") - F.col("_low")).withColumn("untracked", F.col("_low") < before).drop("_sum", "_low")


def screen(actions: DataFrame, user: str, order: list[str], backspaces: str, text: str) -> DataFrame:
    """ST12: (user, screen): actions applied in order to an empty line. One line of text per user."""
    g = actions.groupBy(user).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(backspaces).alias("b"), F.col(text).alias("t")))).alias("_a"))
    step = lambda acc, a: F.concat(F.substr(acc, F.lit(1), F.greatest(F.char_length(acc) - a["b"], F.lit(0))), a["t"])
    return g.select(user, F.aggregate("_a", F.lit(""), step).alias("screen"))
