"""Same or near-same records across splits, by winnowed fingerprints (problem 5).

A record is a list of words; two are near-same if the lists are equal or differ by one word
replaced, added or left out. Equal lists are one class, whatever number of records has them.
Lists shorter than `least` words meet by equality alone: one word is too much of them.

1. Seeds. A list is padded with a start and an end. Rolling hashes run over its runs of k words; of
   every w successive ones the least is selected, those with a pad last. One changed word leaves
   half of the padded list unchanged on one side, so with k + w - 1 within that for the shortest
   list, each near pair shares a selected seed.
2. Selected seeds are joined across splits. A seed that would make more than HOT_PAIRS pairs is first
   extended to both ends of its list: over each gap of one word that leaves the seed whole, the
   seed is joined together with the hash of all other words. No group makes all its pairs unless
   they agree on all words but one.
3. Seeds of a pair are chained if they are collinear: shifted by no more than the lists' lengths
   differ.
4. Chained pairs are aligned word by word, which decides, and gives the coverage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small, write_table
from .unify import has_beyond_ascii, to_points, unified
from .words import mix, value_hashes, word_hashes

#: Odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(6364136223846793005)
#: The second number of a list's identity is made with this base.
BASE2 = np.uint64(0x9E3779B97F4A7C15 | 5)
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: A seed is paired as it is if the numbers of its rows on both sides multiply to at most this.
HOT_PAIRS = 4096


def consistent(col: Column) -> Column:
    """Consistent form and lower case; ASCII text is in that form already."""
    return F.lower(F.when(has_beyond_ascii(col), unified(col)).otherwise(col))


def split_words(col: Column) -> Column:
    """The words of a text, split at white space."""
    return F.filter(F.split(col, r"(?U)\s+"), lambda x: x != "")


def _powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


LISTED = T.StructType([T.StructField("list", T.BinaryType()), T.StructField("words", T.ArrayType(T.LongType()))])


def _listed(hashes: np.ndarray, first: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Word hashes as lists, each with an identity of 128 bits."""
    size = np.diff(first)
    ids = np.zeros((len(size), 2), np.uint64)
    full = size > 0
    if full.any():
        within = np.arange(len(hashes)) - np.repeat(first[:-1], size)
        for k, base in enumerate((BASE, BASE2)):
            sums = np.add.reduceat(hashes.view(np.uint64) * _powers(int(size.max()), base)[within], first[:-1][full])
            ids[full, k] = mix(sums + size[full].astype(np.uint64))
    offsets = np.arange(len(size) + 1, dtype=np.int32) * 16
    mask = pa.array(missing)
    lists = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
    words = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes))
    return pa.StructArray.from_arrays([lists, words], ["list", "words"], mask=mask)


@F.arrow_udf(LISTED)
def list_of_text(text: pa.Array) -> pa.Array:
    """A text's words, split at white space in consistent form and lower case, as hashes; null stays null."""
    hashes, first = word_hashes(*to_points(text), blanks=True)
    return _listed(hashes, first, np.asarray(text.is_null()))


@F.arrow_udf(LISTED)
def list_of_words(words: pa.Array) -> pa.Array:
    """An array of words, each taken as it is, as hashes; null stays null."""
    size = np.where(np.asarray(words.is_valid()), np.asarray(words.value_lengths().fill_null(0), np.int64), 0)
    return _listed(value_hashes(*to_points(words.flatten())), np.concatenate([[0], np.cumsum(size)]), np.asarray(words.is_null()))


def _new_lists(b: pa.RecordBatch) -> np.ndarray:
    """The first row of each (list, side) of a batch: copies that stand together are worked on once."""
    raw = np.frombuffer(b.column(0).cast(pa.binary(16)).buffers()[1], "V16")[b.column(0).offset :][: b.num_rows]
    _, codes = np.unique(raw, return_inverse=True)
    return np.sort(np.unique(codes * 2 + np.asarray(b.column(1)), return_index=True)[1])


def _seeds(k: int, w: int):
    """(list, side, words) to the selected seeds of each list and their places among the padded words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            b = b.take(pa.array(_new_lists(b)))
            size = np.asarray(b.column(2).value_lengths(), np.int64) + 2
            first = np.cumsum(size) - size
            padded = np.empty(int(size.sum()), np.uint64)
            inner = np.ones(len(padded), bool)
            inner[first] = inner[first + size - 1] = False
            padded[inner] = np.asarray(b.column(2).flatten()).view(np.uint64)
            padded[first], padded[first + size - 1] = START, END
            grams = size - k + 1  # of each list
            row = np.repeat(np.arange(len(size)), grams)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams)
            at = first[row] + pos
            rolled = np.zeros(len(at), np.uint64)
            edge = np.zeros(len(at), bool)
            for j in range(k):
                rolled = rolled * BASE + padded[at + j]
                edge |= ~inner[at + j]
            rolled = mix(rolled) >> np.uint64(1) | edge.astype(np.uint64) << np.uint64(63)
            window = np.flatnonzero(pos + w <= grams[row])
            least = np.minimum.reduce([rolled[window + j] for j in range(w)])
            keep = np.zeros(len(rolled), bool)
            for j in range(w):
                keep[window[rolled[window + j] == least] + j] = True
            row, pos, rolled = row[keep], pos[keep], rolled[keep]
            at = pa.array(row)
            n = (size[row] - 2).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(n), pa.array(rolled.view(np.int64)), pa.array(pos.astype(np.int32))], ["list", "side", "n", "seed", "pos"])

    return run


def _extended(k: int):
    """(list, side, words, seed, pos) to the hashes of all words, and of all but one outside the seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words, pos = b.column(2), np.asarray(b.column(4), np.int64) - 1  # among the words themselves
            size = np.asarray(words.value_lengths(), np.int64)
            first = np.cumsum(size) - size
            h = np.asarray(words.flatten()).view(np.uint64)
            power = _powers(int(size.max()) + 1)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(h)) - first[row]
            terms = h * power[place]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
            whole = sums[first + size] - sums[first]
            # Without the word at a place: what stands behind it moves up by one.
            behind = h * power[np.maximum(place - 1, 0)]
            moved = np.concatenate([[np.uint64(0)], np.cumsum(behind, dtype=np.uint64)])
            at = np.arange(len(h))
            gone = (sums[at] - sums[first[row]]) + (moved[(first + size)[row]] - moved[at + 1])
            same = np.zeros(len(h), bool)  # a repeated word leaves the same list as the one before it
            same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
            outside = (place < pos[row]) | (place >= pos[row] + k)
            same[1:] &= outside[:-1]
            use = outside & ~same
            key = lambda sums, n: mix(sums + mix(n.astype(np.uint64))).view(np.int64)
            rows = np.concatenate([np.arange(len(size)), row[use]])
            keys = np.concatenate([key(whole, size), key(gone[use], size[row[use]] - 1)])
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(3).take(at), pa.array(keys)], ["list", "side", "seed", "flank"])

    return run


def one_word_apart(a: Column, b: Column) -> Column:
    """Whether two arrays are equal or one word replaced, added or left out apart."""

    def without(long: Column, short: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(long), F.lit(1)))
        return F.exists(places, lambda i: F.concat(F.slice(long, 1, i - 1), F.slice(long, i + 1, F.size(long))) == short)

    off = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: ~same))
    gap = F.size(a) - F.size(b)
    return F.when(gap == 0, off <= 1).when(gap == 1, without(a, b)).when(gap == -1, without(b, a)).otherwise(False)


class Overlap:
    """The overlap of evaluation and training records.

    members: (key, side, source, list, words), where `list` names a class of equal lists and `words`
    are its hashes; near: (eval_list, train_list, n, m) of different near-same lists and their
    lengths. Copies are never multiplied before record_pairs."""

    def __init__(self, records: DataFrame, key: str, side: str, source: str, words: Column, least: int = 4, k: int = 2, w: int = 2) -> None:
        """side: 0 evaluation, 1 training; other rows, null keys, and null or empty lists have no part.
        words: list_of_words or list_of_text of a column. Repeated keys count once per list and side."""
        if k + w - 1 > (least + 2) // 2:
            raise ValueError("k + w - 1 must not exceed half of the shortest list with its pads, less the changed word: seeds could be missed")
        d = records.select(F.col(key).alias("key"), F.col(side).cast("int").alias("side"), F.col(source).alias("source"), words.alias("_l")).where("key is not null and side in (0, 1)")
        self.members = write_table(d.select("key", "side", "source", "_l.list", "_l.words").where("size(words) > 0"), "members")
        self.least = least
        lists = self.members.where(F.size("words") >= least).select("list", "side", "words")
        seeds = lists.mapInArrow(_seeds(k, w), "list binary, side int, n int, seed long, pos int")
        rows = seeds.groupBy("seed").agg(F.count_if(F.col("side") == 0).alias("_e"), F.count_if(F.col("side") == 1).alias("_t")).where("_e > 0 and _t > 0")
        both = write_table(rows.select("seed", (F.col("_e") * F.col("_t") > HOT_PAIRS).alias("hot")), "seeds")
        # Copies of a list come from several tasks: once is enough.
        matched = write_table(seeds.join(small(both), "seed").distinct(), "matched")
        one = lambda d, side, *cols: d.where(F.col("side") == side).select(*[F.col(c).alias(c if c in ("seed", "flank") else f"{c}{side}") for c in cols])
        cold = matched.where("not hot")
        shift = F.col("pos0") - F.col("pos1")
        longer = F.col("n0") - F.col("n1")
        collinear = (F.abs(longer) <= 1) & F.when(longer == 0, shift == 0).when(longer > 0, shift.between(0, longer)).otherwise(shift.between(longer, 0))
        pairs = one(cold, 0, "seed", "list", "n", "pos").join(one(cold, 1, "seed", "list", "n", "pos"), "seed").where(collinear)
        warm = lists.join(matched.where("hot").select("list", "side", "seed", "pos"), ["list", "side"])
        flanks = warm.select("list", "side", "words", "seed", "pos").mapInArrow(_extended(k), "list binary, side int, seed long, flank long").distinct()
        more = one(flanks, 0, "seed", "flank", "list").join(one(flanks, 1, "seed", "flank", "list"), ["seed", "flank"])
        pairs = pairs.select("list0", "list1").unionByName(more.select("list0", "list1")).where("list0 != list1").distinct()
        pairs = write_table(pairs, "pairs")
        needed = pairs.select(F.col("list0").alias("list")).unionByName(pairs.select(F.col("list1").alias("list"))).distinct()
        texts = lists.join(small(needed), "list", "left_semi").select("list", "words").dropDuplicates(["list"])
        side = lambda k: texts.select(F.col("list").alias(f"list{k}"), F.col("words").alias(f"words{k}"))
        aligned = pairs.join(side(0), "list0").join(side(1), "list1").where(one_word_apart(F.col("words0"), F.col("words1")))
        self.near = aligned.select(F.col("list0").alias("eval_list"), F.col("list1").alias("train_list"), F.size("words0").alias("n"), F.size("words1").alias("m"))

    def _of(self, side: int, least: int = 1) -> DataFrame:
        return self.members.where((F.col("side") == side) & (F.size("words") >= least))

    def record_pairs(self, least: int = 1) -> DataFrame:
        """(eval_key, train_key) of near-same records of at least `least` words."""
        e = self._of(0, least).select(F.col("key").alias("eval_key"), F.col("list").alias("eval_list")).distinct()
        t = self._of(1, least).select(F.col("key").alias("train_key"), F.col("list").alias("train_list")).distinct()
        near = self.near.select("eval_list", "train_list")
        same = e.join(t, F.col("eval_list") == F.col("train_list")).select("eval_key", "train_key")
        return near.join(e, "eval_list").join(t, "train_list").select("eval_key", "train_key").unionByName(same)

    def per_record(self) -> DataFrame:
        """Per evaluation record: its near-same training lists, whether one is equal, and the share
        of its words that the best covers. No pairs of records are made."""
        covered = F.when(F.col("n") < F.col("m"), F.col("n")).otherwise(F.col("n") - 1) / F.col("n")
        best = self.near.groupBy(F.col("eval_list").alias("list")).agg(F.count("*").alias("near"), F.max(covered).alias("covered"))
        train = self._of(1).select("list").distinct().withColumn("same", F.lit(1))
        d = self._of(0).select("key", "source", "list").distinct().join(best, "list", "left").join(train, "list", "left")
        same = F.coalesce("same", F.lit(0))
        return d.select("key", "source", (F.coalesce("near", F.lit(0)) + same).alias("lists"), same.alias("same"), F.when(same == 1, 1.0).otherwise(F.coalesce("covered", F.lit(0.0))).alias("coverage"))

    def report(self) -> DataFrame:
        """Per evaluation source: records, those with an equal or near-same one in training, mean coverage."""
        return self.per_record().groupBy("source").agg(F.count("*").alias("records"), F.sum("same").alias("same"), F.sum(((F.col("same") == 0) & (F.col("lists") > 0)).cast("int")).alias("near"), F.round(F.avg("coverage"), 6).alias("coverage"))


#: Splits by source name, in the one spelling of case_records.
SIDES = {"vsec_dev": 0, "viwiki": 0, "synth_dev": 0, "vsec_train": 1, "synth_train": 1}


def case_records(cases: DataFrame) -> DataFrame:
    """(case_id, side, source, text) of the latest delivery of each case with a typed word."""
    d = cases.where("case_id is not null").groupBy("case_id").agg(F.max_by(F.struct("source", "history", "typed"), F.coalesce(F.col("loaded_at"), F.lit("0001-01-01").cast("timestamp"))).alias("c"))
    source = F.regexp_replace(F.lower(F.trim("c.source")), r"[\s-]+", "_")
    side = F.coalesce(*[F.when(source == name, F.lit(n)) for name, n in SIDES.items()])
    text = F.concat_ws(" ", "c.history", "c.typed")
    return d.where(F.col("c.typed").isNotNull()).select("case_id", side.alias("side"), source.alias("source"), text.alias("text"))


def case_overlap(cases: DataFrame) -> Overlap:
    return Overlap(case_records(cases), "case_id", "side", "source", list_of_text("text"))
