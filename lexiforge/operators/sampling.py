"""Slices, splits and samples that any partitioning repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import hash_order, running, small


def numbered_from_end(df: DataFrame, source: str, order: str) -> DataFrame:
    """Adds `_tail`, 1 for the last row of its source. A row's number is the size of its source less
    the rows before it, which running() counts without one task per source."""
    size = df.groupBy(source).agg(F.count("*").alias("_size"), F.min(order).alias("_low"), F.max(order).alias("_high"))
    d = df.join(small(size), source)
    bucket = F.floor((F.col(order) - F.col("_low")) * 256 / (F.col("_high") - F.col("_low") + 1))
    d = running(d, [source], [F.col(order)], bucket, F.lit(1), "_up_to")
    return d.withColumn("_tail", F.col("_size") - F.col("_up_to") + 1).drop("_size", "_low", "_high", "_up_to")


def training_slice(df: DataFrame, source: str = "source", order: str = "line_no", held_out: int = 20_000, whole: tuple[str, ...] = ()) -> DataFrame:
    """All but the last `held_out` rows of each source; the sources `whole` are kept in full."""
    d = numbered_from_end(df, source, order)
    keep = F.col("_tail") > held_out
    return d.where(keep | F.col(source).isin(*whole) if whole else keep).drop("_tail")


def held_out_slice(df: DataFrame, source: str = "source", order: str = "line_no", held_out: int = 20_000, limit: int = 800) -> DataFrame:
    """Of the last rows of each source every stride-th, at most `limit`; stride = rows / limit."""
    d = numbered_from_end(df, source, order).where(F.col("_tail") <= held_out)
    n = d.groupBy(source).agg(F.count("*").alias("_n"))
    d = d.join(small(n), source).withColumn("_at", F.col("_n") - F.col("_tail"))
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / limit))
    return d.where((F.col("_at") % stride == 0) & (F.col("_at") / stride < limit)).drop("_tail", "_n", "_at")


def shard(df: DataFrame, number: Column, which: int, of: int) -> DataFrame:
    """S21."""
    return df.where(number % of == which)


def tenth(text: Column) -> Column:
    """K8: md5 of a text modulo 10. All powers of 16 above the first are 6 modulo 10."""
    h = F.md5(text.cast("binary"))
    digits = F.transform(F.split(F.substring(h, 1, 31), ""), lambda c: F.conv(F.when(c == "", "0").otherwise(c), 16, 10).cast("int"))
    head = F.aggregate(digits, F.lit(0), lambda a, x: a + x)
    return (head * 6 + F.conv(F.substring(h, 32, 1), 16, 10).cast("int")) % 10


def hashed(key: Column, seed: str) -> Column:
    """An order that SQL engines share: md5 of seed and key."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def take_by_hash(df: DataFrame, key: str, n: int, seed: str = "7") -> DataFrame:
    """K5: n rows in a random order that never changes."""
    return df.orderBy(hashed(F.col(key), seed), key).limit(n)


def capped(df: DataFrame, groups: list[str], key: str, n: int, seed: str = "7") -> DataFrame:
    """K6: at most n rows of each group, by hash. Within a group, ranges of the hash are counted first
    and those past the cap dropped, so a large group never meets in one task."""
    d = df.withColumn("_h", hashed(F.col(key), seed))
    bucket = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    d = running(d, groups, [F.col("_h"), F.col(key)], bucket, F.lit(1), "_up_to")
    return d.where(F.col("_up_to") <= n).drop("_h", "_up_to")


def errors_and_some(df: DataFrame, is_error: Column, key: str, share: float, seed: str = "7") -> DataFrame:
    """K7: all errors, and a share of the rest by hash."""
    u = F.conv(F.substring(hashed(F.col(key), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.where(is_error | (u < share))


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int, out: str = "place") -> DataFrame:
    """K2: Spark prunes rows past k where they are read (WindowGroupLimit), before the shuffle."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col(out) <= k)


def weighted_order(weight: Column, key: Column, seed: int = 7) -> Column:
    """Order by it for a weighted draw without replacement: -ln(u) / weight, least first."""
    u = (F.shiftrightunsigned(hash_order(key, seed=seed), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.when(weight > 0, -F.ln(u) / weight)


def picked_errors(pool: DataFrame, sentence: str, position: str, key: str, shares: dict[str, float], per_sentence: int = 2, seed: int = 7) -> DataFrame:
    """From pool (sentence, position, key, margin, seen, kind, valid): candidates that lose to the
    original by enough, one a position, `per_sentence` a sentence, drawn by weight: close ones, seen
    ones, and kinds by their measured share over their share in the sentence's pool."""
    floor = F.when(F.col("valid"), 3.0).otherwise(0.5)
    d = pool.where(F.col("margin") >= floor)
    kinds = d.groupBy(sentence, "kind").agg(F.count("*").alias("_n"))
    share = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    d = d.join(kinds, [sentence, "kind"])
    weight = F.coalesce(F.try_element_at(share, F.col("kind")), F.lit(0.01)) / F.col("_n") * F.when(~F.col("valid") & ~F.col("seen"), 0.3).otherwise(1.0) * F.when(F.col("seen"), 3.0).otherwise(1.0) * F.exp(-F.col("margin") / 1.5)
    d = d.withColumn("_o", weighted_order(weight, F.col(key), seed))
    d = top_k(d, [sentence, position], [F.col("_o"), F.col(key)], 1, "_p")
    return top_k(d, [sentence], [F.col("_o"), F.col(key)], per_sentence, "_s").drop("_n", "_o", "_p", "_s")


def running_ids(df: DataFrame, source: str, order: str, is_error: Column) -> DataFrame:
    """Adds `id` (from 1 within its source, by `order`) and `errors` so far."""
    ends = df.groupBy(source).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    d = df.join(small(ends), source)
    bucket = F.floor((F.col(order) - F.col("_low")) * 256 / (F.col("_high") - F.col("_low") + 1))
    d = d.withColumn("_b", bucket).drop("_low", "_high")
    d = running(d, [source], [F.col(order)], F.col("_b"), F.lit(1), "running_id")
    return running(d, [source], [F.col(order)], F.col("_b"), is_error.cast("int"), "errors").drop("_b")


def mixed_stream(real: DataFrame, made: DataFrame, rest: DataFrame, key: str, shares: tuple[float, float] = (0.15, 0.10)) -> DataFrame:
    """ST13: a union in which each part keeps the rows that its share of a common hash range lets in."""
    u = F.shiftrightunsigned(hash_order(key), 11) / F.lit(float(1 << 53))
    return real.where(u < shares[0]).unionByName(made.where(u < shares[1])).unionByName(rest.where(u < 1 - sum(shares)))
