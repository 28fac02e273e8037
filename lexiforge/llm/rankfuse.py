"""One ranking from several differently scaled scores, by median rank (problem 3).

Ranks replace scores, so no scale counts. An item's place follows from the weighted median of its
ranks, then their mean, then its identifier. `fuse_lists` ranks the items of one row's arrays
(short candidate lists) without a shuffle; `fuse_rows` ranks items over rows in groups of any size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, running


def weighted_median(ranks: list[Column], weights: list[float]) -> Column:
    """The smallest rank at which half of the weight is reached (the lower median)."""
    half = sum(weights) / 2
    pairs = F.array_sort(F.array(*[F.struct(r.cast("double").alias("r"), F.lit(float(w)).alias("w")) for r, w in zip(ranks, weights)]))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
    step = lambda acc, x: F.struct((acc["sum"] + x["w"]).alias("sum"), F.when(acc["at"].isNotNull(), acc["at"]).when(acc["sum"] + x["w"] >= half, x["r"]).alias("at"))
    return F.aggregate(pairs, start, step, lambda acc: acc["at"])


def fuse_lists(df: DataFrame, lists: list[str], weights: list[float] | None = None, out: str = "ranking") -> DataFrame:
    """Adds `out`: the items of the row's score arrays in fused order, best first, as structs
    (pos, median, mean, alone, total): 0-based place, weighted median and mean rank, on how many
    scores the item alone is highest, and the plain sum of its scores.

    A rank is 1 + the number of higher scores, so equal scores share a rank: an item's rank is the
    first place of its score in the sorted array. `out` is null where an array is null, of another
    length than the first, or holds a null or NaN; empty arrays give an empty ranking."""
    weights = weights or [1.0] * len(lists)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.size(c) == F.size(lists[0])) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x)) for c in lists])
    # Generators keep the optimizer from repeating the sorted arrays, or the ranking, in every place that uses them.
    ordered = F.struct(*[F.sort_array(c, asc=False).alias(f"o{k}") for k, c in enumerate(lists)])
    d = df.withColumn("_sorted", F.explode(F.array(F.when(whole, ordered))))

    def placed(i: Column) -> Column:
        fields = [i.cast("int").alias("pos")]
        for k, c in enumerate(lists):
            fields += [F.col(c)[i].alias(f"s{k}"), F.array_position(F.col("_sorted")[f"o{k}"], F.col(c)[i]).alias(f"r{k}")]
        return F.struct(*fields)

    def item(x: Column) -> Column:
        ranks = [x[f"r{k}"] for k in range(len(lists))]
        second = [F.try_element_at(F.col("_sorted")[f"o{k}"], F.lit(2)) for k in range(len(lists))]
        alone = [((r == 1) & F.coalesce(o < x[f"s{k}"], F.lit(True))).cast("int") for k, (r, o) in enumerate(zip(ranks, second))]
        mean = reduce(lambda a, b: a + b, [r * F.lit(float(w)) for r, w in zip(ranks, weights)]) / sum(weights)
        total = reduce(lambda a, b: a + b, [x[f"s{k}"] for k in range(len(lists))])
        return F.struct(weighted_median(ranks, weights).alias("median"), mean.alias("mean"), x["pos"].alias("pos"), reduce(lambda a, b: a + b, alone).alias("alone"), total.alias("total"))

    n = F.size(lists[0])
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    ranking = F.array_sort(F.transform(F.transform(places, placed), item))
    return d.withColumn(out, F.explode(F.array(F.when(F.col("_sorted").isNotNull(), ranking)))).drop("_sorted")


def rank_of(df: DataFrame, group: list[str], score: str, out: str) -> DataFrame:
    """Adds `out`: 1 + the number of rows of the group with a higher score; null for a null or NaN score.

    Distinct values are counted first and sorted by range over all tasks; counts run on over range
    borders. So neither a large group nor a frequent value meets in one task."""
    d = df.withColumn("_score", F.when(~F.isnan(score), F.col(score).cast("double")))
    values = d.where("_score is not null").groupBy(*group, "_score").agg(F.count("*").alias("_n"))
    order = F.col("_score").desc()
    values = values.repartitionByRange(*group, order).withColumn("_range", F.spark_partition_id())
    # The ranges are drawn from a sample: the borders must not be drawn again by another reader.
    values = running(cut(values), group, [order], F.col("_range"), F.col("_n"), "_up_to")
    values = values.select(*group, "_score", (F.col("_up_to") - F.col("_n") + 1).alias(out))
    left, right = d.alias("l"), values.alias("r")
    on = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group] + [F.col("l._score") == F.col("r._score")]
    return left.join(right, on, "left").select("l.*", f"r.{out}").drop("_score")


def fuse_rows(df: DataFrame, group: list[str], item: str, scores: list[str], weights: list[float] | None = None) -> DataFrame:
    """(group..., item, median, mean, place): one fused ranking per group of rows, of any size.

    Rows with a null or NaN score are left out before ranking; repeated rows are ranked each, and
    rows that tie on everything get places in an arbitrary order."""
    weights = weights or [1.0] * len(scores)
    d = df.select(*group, item, *scores)
    d = d.where(reduce(lambda a, b: a & b, [F.col(s).isNotNull() & ~F.isnan(s) for s in scores]))
    for k, s in enumerate(scores):
        d = rank_of(d, group, s, f"_rank{k}")
    ranks = [F.col(f"_rank{k}") for k in range(len(scores))]
    mean = reduce(lambda a, b: a + b, [r * F.lit(float(w)) for r, w in zip(ranks, weights)]) / sum(weights)
    d = d.select(*group, item, weighted_median(ranks, weights).alias("median"), mean.alias("mean"))
    order = [F.col("median"), F.col("mean"), F.col(item)]
    d = cut(d.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    return running(d, group, order, F.col("_range"), F.lit(1), "place").drop("_range")


def latest(value: str, at: str) -> Column:
    """The value delivered last; of those of one time, or of none, the same in every run."""
    return F.max_by(value, F.struct(F.coalesce(F.col(at), F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), F.xxhash64(value).alias("tie")))


def _joined(samples: DataFrame, teachers: DataFrame) -> DataFrame:
    """(id, model, s, r, ll_left, ll_full): the latest delivery of each sample with that of each teacher."""
    keep = samples.where("id is not null and candidates is not null")
    one = keep.groupBy("id").agg(latest("candidates", "exported_at").alias("c")).select("id", F.col("c.s").alias("s"), F.col("c.r").alias("r"))
    t = teachers.where("id is not null and model is not null").select("id", "model", "scored_at", F.struct("ll_left", "ll_full").alias("t"))
    t = t.groupBy("id", "model").agg(latest("t", "scored_at").alias("t")).select("id", "model", "t.ll_left", "t.ll_full")
    return one.join(t, "id")


def fused_samples(samples: DataFrame, teachers: DataFrame) -> DataFrame:
    """(id, model, ranking): the candidates of each sample that a teacher has scored, ranked over
    s, r, ll_left and ll_full. Repeats count once (the latest); incomplete ones have no row."""
    return fuse_lists(_joined(samples, teachers), ["s", "r", "ll_left", "ll_full"]).where("ranking is not null").select("id", "model", "ranking")


def scored_candidates(samples: DataFrame, teachers: DataFrame) -> DataFrame:
    """(model, item, s, r, ll_left, ll_full): the candidates of complete samples as rows, item = id#place."""
    names = ["s", "r", "ll_left", "ll_full"]
    d = _joined(samples, teachers).select("id", "model", F.posexplode(F.arrays_zip(*names)).alias("pos", "x"))
    return d.select("model", F.concat_ws("#", "id", "pos").alias("item"), *[F.col(f"x.{c}").alias(c) for c in names])


def outvoted(fused: DataFrame, least: int = 3) -> DataFrame:
    """(id, model, pos): first by median rank and alone highest on `least` scores, yet not by plain sum."""
    best = F.col("ranking")[0]
    return fused.where(F.size("ranking") > 0).where((best["alone"] >= least) & (F.array_max(F.transform("ranking", lambda x: x["total"])) > best["total"])).select("id", "model", best["pos"].alias("pos"))


