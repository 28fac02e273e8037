"""Lexicons from word counts, and what is known by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import nfc
from ..session import small


def word_counts(raw: DataFrame) -> DataFrame:
    """(source, word, n): counts of NFC lower-case words; bad rows are skipped, repeats added."""
    d = raw.where("n > 0 and word is not null and source is not null").select("source", F.trim(F.lower(nfc("word"))).alias("word"), "n").where("word != ''")
    return d.groupBy("source", "word").agg(F.sum("n").alias("n"))


def english_word(col: Column) -> Column:
    """Lower case if all of a-z, and longer than one letter unless a or i; else null."""
    low = F.lower(col)
    return F.when(low.rlike("^[a-z]+$") & ((F.char_length(low) > 1) | low.isin("a", "i")), low)


def combine(counts: DataFrame, per: float = 1e9) -> DataFrame:
    """A1: (word, per_billion, sources): each source's relative frequencies, averaged over all sources."""
    totals = counts.groupBy("source").agg(F.sum("n").alias("_all"))
    number = totals.agg(F.count("*").alias("n")).select("n").scalar()
    share = counts.join(small(totals), "source").withColumn("_share", F.col("n") / F.col("_all"))
    return share.groupBy("word").agg((F.sum("_share") / number * per).alias("per_billion"), F.count("*").alias("sources"))


def frequent(combined: DataFrame, least: float = 100, sure: float = 200, sources: int = 2) -> DataFrame:
    """Frequent enough, and seen in several sources or very frequent."""
    return combined.where((F.col("per_billion") >= least) & ((F.col("sources") >= sources) | (F.col("per_billion") >= sure)))


def parsed_lexicon(raw: DataFrame) -> DataFrame:
    """(lexicon, word, id, per_billion, ln): rows that are no comment and have a frequency; the
    first of a word counts; ids run by line from 0 within each lexicon."""
    d = raw.where("per_billion > 0 and word is not null and not startswith(word, '#')").select("lexicon", "line_no", F.trim(F.lower(nfc("word"))).alias("word"), "per_billion").where("word != ''")
    first = d.groupBy("lexicon", "word").agg(F.min("line_no").alias("line_no"), F.min_by("per_billion", "line_no").alias("per_billion"))
    w = W.partitionBy("lexicon").orderBy("line_no", "word")
    return first.select("lexicon", "word", (F.row_number().over(w) - 1).alias("id"), "per_billion", F.ln("per_billion").alias("ln"))


def known_words(raw: DataFrame) -> DataFrame:
    """(word): the distinct words of letters of all lexicons."""
    return parsed_lexicon(raw).where(F.col("word").rlike(r"^\p{L}+$")).select("word").distinct()


def vocabulary(raw: DataFrame, size: int = 8000) -> DataFrame:
    """(rank, word, per_billion): the most frequent words of letters; ties by word, falling."""
    best = parsed_lexicon(raw).where(F.col("word").rlike(r"^\p{L}+$")).groupBy("word").agg(F.max("per_billion").alias("per_billion"))
    head = best.orderBy(F.desc("per_billion"), F.desc("word")).limit(size)
    # The head is at most `size` rows, so one task may number it.
    return head.select(F.row_number().over(W.orderBy(F.desc("per_billion"), F.desc("word"))).alias("rank"), "word", "per_billion")


def exported(combined: DataFrame) -> DataFrame:
    """Whole frequencies, falling, then by word."""
    return combined.select("word", F.round("per_billion").cast("long").alias("per_billion")).orderBy(F.desc("per_billion"), "word")


def sentence_stats(sent: DataFrame, keys: list[str], text: str, known: DataFrame) -> DataFrame:
    """(keys, words, known): the words of each sentence and how many of them are known.

    The known words are joined to the distinct words of each sentence, by hash if they are few."""
    d = sent.select(*keys, F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)).alias("_w"))
    rows = d.select(*keys, F.explode("_w").alias("word"))
    rows = rows.join(small(known.select("word").withColumn("_known", F.lit(1))), "word", "left")
    return rows.groupBy(*keys).agg(F.count("*").alias("words"), F.count("_known").alias("known"))


def usable(stats: DataFrame, low: int = 4, high: int = 40, share: float = 0.9) -> DataFrame:
    """P4."""
    return stats.where(F.col("words").between(low, high) & (F.col("known") >= share * F.col("words")))


# What labels the lines of a list, phrases of a program that talks of itself, scripts and signs of no plain sentence.
LABELS, NUMBERED = ["câu", "tin", "ví dụ", "dòng", "message"], ["câu", "tin nhắn"]
OF_A_PROGRAM = ["được lập trình để", "được lập trình bởi", "là một trí tuệ nhân tạo", "là một mô hình ai", "là một ai", "với tư cách là một ai", "với tư cách là một trợ lý", "tôi không có khả năng", "tôi là trợ lý"]
FOREIGN, MARKUP = ["Han", "Hiragana", "Katakana", "Hangul", "Cyrillic", "Arabic", "Thai"], "<>{}[]|\\_#*"


def sentence_patterns(script: str) -> list[str]:
    """Patterns of which a plain sentence matches none, built from the lists above; `script` is how the
    engine names a script. The text is lower case."""
    some = lambda of: "(?:" + "|".join(of) + ")"
    return [
        "[" + "".join(script.format(x) for x in FOREIGN) + "]",
        "[" + "".join("\\" + c for c in MARKUP) + "]",
        r"^\s*" + some(LABELS) + r"[\s\d:.)]*$",
        r"^\s*" + some(NUMBERED) + r"\s+\d",
        some(OF_A_PROGRAM) + r"(?:[^\p{L}\p{N}]|$)",
    ]


def plain_sentence(col: Column, low: int = 4, high: int = 45) -> Column:
    """P5 but for the known words: length, no foreign script, no markup, no list label, no talk of
    being a program, closed quotes."""
    n = F.regexp_count(col, F.lit(r"\p{L}+"))
    quotes = (F.regexp_count(col, F.lit('"')) % 2 == 0) & (F.regexp_count(col, F.lit("“")) == F.regexp_count(col, F.lit("”")))
    return reduce(lambda ok, p: ok & ~F.lower(col).rlike(p), sentence_patterns(r"\p{{Is{}}}"), n.between(low, high) & quotes)


def first_of_equal(df: DataFrame, text: str, order: str) -> DataFrame:
    """Of texts with equal lower-case words, the first by `order`.

    A text that a third of all rows hold is reduced where it is read: min_by keeps one row a task."""
    key = F.xxhash64(F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), " "))
    rest = [c for c in df.columns if c != order]
    kept = df.withColumn("_k", key).groupBy("_k").agg(F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in rest])
    return kept.select(*df.columns)


def reply_lines(text: Column) -> Column:
    """The sentences of a reply, one a line, without list marks (dashes, stars, dots, numbers) and quotes."""
    numbered = lambda x: F.regexp_replace(x, r"^\(?\d+[.)]", "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(numbered(F.ltrim(x, F.lit(" -*•"))), F.lit(" \"")))
    return F.filter(lines, lambda x: x != "")


def reply_versions(text: Column) -> Column:
    """The objects of a reply with `typed` and `edits`, one a line."""
    schema = "typed string, edits array<struct<i:int,`from`:string,`to`:string>>"
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^`+|`+$", "")))
    objects = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("{"))), lambda x: F.from_json(x, schema))
    return F.filter(objects, lambda o: o["typed"].isNotNull() & o["edits"].isNotNull())
