"""Mixing sources to target weights, sized in tokens of a public tokenizer (problem 7).

A source that is to give T tokens of its S gives floor(T / S) whole copies of each record, and the
rest by Pareto order sampling: with u a uniform number from the record's hash and p its inclusion
probability, records are taken in the order of (u / (1 - u)) / (p / (1 - p)) up to the tokens
wanted. p differs between sources; within one it is in proportion to a preference, where one is
given, and records whose p would reach 1 are taken for certain before the others share what is left.
No record is used more often than its source allows; what is then missing is reported.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, leading, md5_order, ranged, running, small
from .words import slices

#: A rank file of a public byte-level BPE; any other may be given.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of that file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Instead of a rank file: every byte is a token, as in byte-level models; sized without Python.
BYTES = "bytes"
#: Sums in Pareto order are made in so many ranges per source, so that none meets in one task.
RANGES = 1024


@lru_cache(4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            for part in slices(batch, "text"):
                n = np.array([len(encode(x)) if x else 0 for x in part.column(part.num_columns - 1).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n)], [*part.schema.names[:-1], "tokens"])

    return run


def token_sizes(df: DataFrame, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns `keep` and the size of each whole text in tokens; null and empty texts have 0."""
    d = df.select(*keep, F.col(text).cast("string").alias("text"))
    if tokenizer == BYTES:
        return d.select(*keep, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("tokens"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema[: len(keep)]) + ", tokens long"
    return d.mapInArrow(_sizes(tokenizer), schema)


class Mixture:
    """sizes: (key, source, tokens) of all records with a source; plan: per source the tokens it has
    and is to give, whole copies, and the tokens of the rest."""

    def __init__(self, docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, seed: int = 7, appeal: str | None = None) -> None:
        """Rows without a source have no part. A null max_repeats means 1 use, a null weight 0.
        `appeal`: a column of numbers in proportion to which records are preferred, none at 0 or below
        unless nothing else is left. Repeated rows are records of their own."""
        d = docs.where(F.col(source).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("source"), (F.col(appeal).cast("double") if appeal else F.lit(1.0)).alias("appeal"), F.col(text).alias("text"))
        self.sizes = cut(token_sizes(d, "text", ["key", "source", "appeal"], tokenizer))
        self.seed, self.preferring = seed, appeal is not None
        per = self.sizes.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("records"), F.sum(F.col("tokens") * F.greatest("appeal", F.lit(0.0))).alias("drawn"))
        budget = per.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
        t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.coalesce(F.col("weight"), F.lit(0.0))).alias("weight"), F.max(F.coalesce(F.col("max_repeats"), F.lit(1))).alias("max_repeats"))
        p = t.join(per, "source", "left").select("source", "weight", "max_repeats", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("drawn", F.lit(0.0)).alias("drawn"))
        p = p.withColumn("target", F.col("weight") * budget.select("budget").scalar())
        p = p.withColumn("short", F.col("size") * F.col("max_repeats") < F.col("target"))
        p = p.withColumn("copies", F.when(F.col("short"), F.col("max_repeats")).otherwise(F.floor(F.col("target") / F.greatest("size", F.lit(1)))).cast("long"))
        self.plan = cut(p.withColumn("rest", F.when(F.col("short"), 0.0).otherwise(F.col("target") - F.col("copies") * F.col("size"))))

    def _with_odds(self, d: DataFrame) -> tuple[DataFrame, list[Column], Column]:
        """d with _odds, its Pareto order within a source, and a number that never falls along it."""
        u = (leading(md5_order(F.concat(F.col("key").cast("string"), F.lit("/"), F.col("source")), self.seed), 13) + F.lit(0.5)) / F.lit(float(1 << 52))
        d, order = d.withColumn("_u", u), [F.col("_odds"), F.col("key")]
        odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
        if not self.preferring:  # one p for a whole source: the order is that of u
            return d.withColumn("_p", F.col("rest") / F.col("size")).withColumn("_odds", odds), order, F.floor(F.col("_u") * RANGES)
        d = ranged(d.withColumn("_a", F.greatest("appeal", F.lit(0.0))), F.col("source"), F.desc("_a"), F.col("key"))
        fall = [F.desc("_a"), F.col("key")]
        d = running(d, ["source"], fall, F.col("_range"), F.col("tokens"), "_upto")
        d = running(d, ["source"], fall, F.col("_range"), F.col("_a") * F.col("tokens"), "_drawn")
        before, own = F.col("_upto") - F.col("tokens"), F.col("_a") * F.col("tokens")
        d = cut(d.withColumn("_sure", (F.col("_a") > 0) & ((F.col("rest") - before) * F.col("_a") >= F.col("drawn") - (F.col("_drawn") - own))))
        sure = d.where("_sure").groupBy("source").agg(F.sum("tokens").alias("_st"), F.sum(F.col("_a") * F.col("tokens")).alias("_sa"))
        d = d.drop("_range").join(small(sure), "source", "left")
        p = (F.col("rest") - F.coalesce("_st", F.lit(0))) * F.col("_a") / F.greatest(F.col("drawn") - F.coalesce("_sa", F.lit(0.0)), F.lit(1e-300))
        d = d.withColumn("_p", F.least(F.greatest(p, F.lit(0.0)), F.lit(1 - 1e-12)))
        d = d.withColumn("_odds", F.when(F.col("_sure"), -1.0).when(F.col("_p") <= 0, F.lit(float("inf"))).otherwise(odds))
        return ranged(d, F.col("source"), *order), order, F.col("_range")

    def sample(self) -> DataFrame:
        """(key, source, tokens, uses): every record used at least once."""
        d = self.sizes.join(small(self.plan.select("source", "copies", "rest", "size", "drawn")), "source")
        drawn, order, bucket = self._with_odds(d.where("rest > 0 and tokens > 0"))
        drawn = running(drawn, ["source"], order, bucket, F.col("tokens"), "_up_to")
        # The record at the border is taken if more than half of it is wanted.
        extra = (F.col("_up_to") - F.col("tokens") / 2 < F.col("rest")).cast("long")
        columns = ["key", "source", "tokens"]
        whole = d.where("not (rest > 0 and tokens > 0)").select(*columns, F.col("copies").alias("uses"))
        return drawn.select(*columns, (F.col("copies") + extra).alias("uses")).unionByName(whole).where("uses > 0")

    def report(self) -> DataFrame:
        """Per source: size, tokens wanted and given, share wanted and reached, and `short` where
        the tokens given stay below the target as all records as often as allowed don't reach it."""
        given = self.sample().groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("given"), F.max("uses").alias("uses"))
        d = self.plan.join(given, "source", "left").withColumn("given", F.coalesce("given", F.lit(0)))
        # One small row of sums; the plan has one row per source named in the targets.
        total = d.agg(F.sum("given").alias("total")).select("total").scalar()
        return d.select("source", "weight", "max_repeats", "records", "size", "target", "given", F.coalesce("uses", F.lit(0)).alias("uses"), (F.col("given") / F.greatest(total, F.lit(1))).alias("share"), (F.col("short") & (F.col("given") < F.col("target"))).alias("short"))
