"""Words, breaks and phrases of texts.

Everything that looks at neighbours works inside the array of one text, so no text is shuffled or
sorted to find its n-grams, contexts or phrases. A break stands in the array as an empty word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN, nfc
from ..session import widen


def token_array(text: Column) -> Column:
    """T1 on NFC text: lower-case words, and "" for each other visible character."""
    raw = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.transform(raw, lambda t: F.when(t.rlike(r"^\p{L}"), F.lower(t)).otherwise(F.lit("")))


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """Rows with a text, and their tokens."""
    return widen(df.where(F.col(text).isNotNull())).withColumn("_nfc", nfc(text)).withColumn(out, token_array(F.col("_nfc"))).drop("_nfc")


def sliding(tokens: Column, n: int) -> Column:
    """All runs of n tokens, breaks among them."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<string>>"))


def token_rows(df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, pos, word, is_break), positions from 1."""
    return df.select(key, F.posexplode(tokens).alias("pos", "t")).select(key, (F.col("pos") + 1).alias("pos"), F.when(F.col("t") != "", F.col("t")).alias("word"), (F.col("t") == "").alias("is_break"))


def phrases(tokens: Column) -> Column:
    """The words of a text by phrase, an array of arrays; phrases end at breaks."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"))

    def close(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])

    def step(acc: Column, t: Column) -> Column:
        shut = F.struct(close(acc).alias("done"), F.array().cast("array<string>").alias("open"))
        grown = F.struct(acc["done"].alias("done"), F.array_append(acc["open"], t).alias("open"))
        return F.when(t == "", shut).otherwise(grown)

    return F.aggregate(tokens, start, step, close)


def phrase_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, phrase, words): phrases of a text from 0, cut at every break. Words are lower case.

    Breaks are cut by a pattern, in time linear in the text, unlike phrases() with its growing arrays."""
    d = widen(df.where(F.col(text).isNotNull()).select(key, text)).select(key, nfc(text).alias("_t"))
    parts = F.filter(F.split(F.lower("_t"), r"[^\p{L}\s\p{Z}]+"), lambda p: p.rlike(r"\p{L}"))
    d = d.select(key, F.posexplode(parts).alias("phrase", "_p"))
    return d.select(key, "phrase", F.regexp_extract_all("_p", F.lit(r"\p{L}+"), F.lit(0)).alias("words"))


def contexts(df: DataFrame, keys: list[str], words: str = "words", left: int = 3, right: int = 3) -> DataFrame:
    """(keys, pos, word, history, right): each word with the words before and behind it in its phrase."""
    d = df.select(*keys, words, F.posexplode(words).alias("pos", "word"))
    begin = F.greatest(F.col("pos") - left + 1, F.lit(1))
    return d.select(*keys, "pos", "word", F.slice(words, begin, F.col("pos") - begin + 1).alias("history"), F.slice(words, F.col("pos") + 2, right).alias("right"))


def raw_tokens(text: Column) -> Column:
    """Runs of letters, digits and _, and single other characters."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"), F.lit(0))


def screen_words(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """T4: (key, pos, token, start, end) with 0-based places in characters.

    Pieces are cut at the borders of words, so a token's start is the length of the pieces before it."""
    d = df.where(F.col(text).isNotNull()).select(key, nfc(text).alias("_t"))
    pieces = F.regexp_extract_all("_t", F.lit(r"(?s)[\p{L}\p{N}_]+|."), F.lit(0))
    d = d.select(key, F.posexplode(pieces).alias("_i", "token"))
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy("_i")
    d = d.withColumn("_end", F.sum(F.char_length("token")).over(w)).where(~F.col("token").rlike(r"^[\s\p{Z}]$"))
    return d.select(key, F.row_number().over(w).alias("pos"), "token", (F.col("_end") - F.char_length("token")).alias("start"), F.col("_end").alias("end"))


def sentences(text: Column) -> Column:
    """Sentences end at a line's end and behind . ! ?"""
    return F.filter(F.transform(F.split(text, r"[\n\r]+|(?<=[.!?])"), lambda s: F.trim(s)), lambda s: s != "")


def windows_ending(tokens: Column, end: Column, width: int = 40, supervised: int = 4) -> Column:
    """The window of up to `width` tokens that ends at `end`, behind a token of the environment,
    and the places in it that count."""
    low = F.greatest(end - width, F.lit(0))
    n = end - low
    first = F.greatest(n - supervised + 1, F.lit(1))
    return F.struct(F.concat(F.array(F.lit("<env>")), F.slice(tokens, low + 1, n)).alias("tokens"), F.when(n >= first, F.sequence(first, F.greatest(n, first))).otherwise(F.array().cast("array<int>")).alias("supervised"))


def right_windows(df: DataFrame, key: str, tokens: str, right: int = 1, width: int = 40) -> DataFrame:
    """One window per token with exactly `right` tokens behind it: (key, pos, at, tokens)."""
    d = df.select(key, tokens, F.posexplode(tokens).alias("pos", "_w")).where(F.col("pos") + right + 1 <= F.size(tokens))
    end = F.col("pos") + right + 1
    low = F.greatest(end - width, F.lit(0))
    return d.select(key, "pos", (F.col("pos") - low + 1).alias("at"), F.concat(F.array(F.lit("<env>")), F.slice(tokens, low + 1, end - low)).alias("window"))
