"""A sample that matches target proportions of categories (problem 4).

Divisor method. Within its category each record has a random row number, its rank; its priority is
(rank - 0.5) / target share. Records within a category's minimum come first, then all by rising
priority; the first `size` of that order are the sample. So seats that an exhausted category can't
fill go to the others by themselves. Neither the ranks of a category nor the order of all records
meets in one task: both are counted in ranges, and the ranges' sums are carried over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, leading, md5_order, ranged, running, small

#: Random ranks are counted in 16 ** RANGE_DIGITS ranges per category, so that none meets in one task.
RANGE_DIGITS = 3


def spelled(col: str) -> Column:
    """One spelling of a category: trimmed, lower case, `-` for blanks and `_`."""
    return F.regexp_replace(F.lower(F.trim(F.col(col).cast("string"))), r"[\s_]+", "-")


class Stratified:
    """ranked: every record that a target names, with its rank, priority and place in the order of all;
    size: that of the sample; report, sample: see there."""

    def __init__(self, df: DataFrame, key: str, cols: list[str], targets: DataFrame, size: int | None = None, fraction: float = 0.25, share: str = "share", least: str = "min_rows", seed: int = 7) -> None:
        """Rows with a null key or a category that no target names don't count; repeated keys count
        once per category. Without `size`, `fraction` of all keys, rounded down. Targets with a null
        category don't count; of several whose spellings are one, shares and minimums are added.
        A category without a share gives its minimum only. Equal priorities go by category and rank."""
        names = [f"_c{i}" for i in range(len(cols))]
        t = targets.select(*[spelled(c).alias(n) for c, n in zip(cols, names)], *[F.col(c).cast("string").alias(f"{n}_name") for c, n in zip(cols, names)], F.coalesce(F.col(share).cast("double"), F.lit(0.0)).alias("share"), F.coalesce(F.col(least).cast("long"), F.lit(0)).alias("least")).dropna(subset=names)
        self.targets = cut(t.groupBy(*names).agg(*[F.min(f"{n}_name").alias(f"{n}_name") for n in names], F.sum("share").alias("share"), F.sum("least").alias("least")))
        d = df.select(F.col(key).alias("_key"), *[spelled(c).alias(n) for c, n in zip(cols, names)]).where("_key is not null")
        d = d.join(small(self.targets.select(*names, "share", "least")), names).dropDuplicates(["_key", *names])
        h = md5_order("_key", seed)
        d = running(d.withColumn("_h", h), names, [F.col("_h"), F.col("_key")], leading(F.col("_h"), RANGE_DIGITS), F.lit(1), "_rank")
        d = d.withColumn("_beyond", F.col("_rank") > F.col("least")).withColumn("_priority", F.when(F.col("share") > 0, (F.col("_rank") - F.lit(0.5)) / F.col("share")).otherwise(F.lit(math.inf)))
        order = [F.col("_beyond"), F.col("_priority"), *[F.col(n) for n in names], F.col("_rank")]
        d = ranged(d.select("_key", *names, "_rank", "_beyond", "_priority"), *order)
        self.size = math.floor(fraction * d.count()) if size is None else size
        self.ranked = running(d, [], order, F.col("_range"), F.lit(1), "_place").withColumn("_taken", (F.col("_place") <= self.size) & ~(F.col("_beyond") & (F.col("_priority") == math.inf)))
        self.key, self.cols, self.names = key, cols, names

    def report(self) -> DataFrame:
        """Per category: share asked, available records, seats given, share reached, and `short`
        where the sample has less than the larger of share * size and the minimum, and no more was there."""
        drawn = self.ranked.groupBy(*self.names).agg(F.count("*").alias("available"), F.count_if("_taken").alias("seats"))
        d = self.targets.join(drawn, self.names, "left").fillna(0, ["available", "seats"])
        wanted = F.greatest(F.col("share") * self.size, F.col("least"))
        short = (F.col("seats") < wanted) & (F.col("available") < wanted)
        return d.select(*[F.col(f"{n}_name").alias(c) for c, n in zip(self.cols, self.names)], "share", F.col("least").alias("min_rows"), "available", "seats", (F.col("seats") / F.lit(max(1, self.size))).alias("reached"), short.alias("short"))

    def sample(self) -> DataFrame:
        """(key, category columns): the sample, without repeats, the same in every run."""
        d = self.ranked.where("_taken").join(small(self.targets.select(*self.names, *[f"{n}_name" for n in self.names])), self.names)
        return d.select(F.col("_key").alias(self.key), *[F.col(f"{n}_name").alias(c) for c, n in zip(self.cols, self.names)])
