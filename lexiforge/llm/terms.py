"""Frequency of every distinct term and n-gram, and in how many records (problem 1).

A distributed suffix array over words. Equal suffixes of a record that stand in one Arrow batch are
added up where they are read. Within a record, sorted, each suffix knows how many words it shares
with the one before it: that many of its prefixes repeat an earlier one of the same record, a
duplicate adjacency. Then all suffixes are sorted by range of (suffix, record), so that a suffix
held by a third of all records runs over many tasks. Rows that share their first d words form a
common-prefix interval, an n-gram of d words: its occurrences are the interval's sum, and its
records the interval's rows less the duplicate adjacencies. Interval sums are made in numpy over
whole Arrow batches; the parts of an interval that a batch or a range cuts are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .unify import composed


def _shared_words(a: Column, b: Column, max_n: int) -> Column:
    """How many leading words two arrays share, at most max_n."""
    out = F.lit(0)
    for d in range(1, max_n + 1):
        same = (F.size(a) >= d) & (F.size(b) >= d) & (F.slice(a, 1, d) == F.slice(b, 1, d))
        out = F.when(same, F.lit(d)).otherwise(out)
    return F.when(a.isNull() | b.isNull(), F.lit(0)).otherwise(out)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal (record, suffix) of a batch as one row, before anything is shuffled."""
    for b in batches:
        if not b.num_rows:
            continue
        words = b.column(1)
        size = np.asarray(words.value_lengths(), np.int64)
        first = np.cumsum(size) - size
        codes = np.asarray(words.flatten().dictionary_encode().indices, np.int64)
        record = b.column(0).dictionary_encode(null_encoding="encode")
        keys = [np.asarray(record.indices, np.int64)]
        for d in range(int(size.max())):
            keys.append(np.where(size > d, codes[np.where(size > d, first + d, 0)], -1))
        order = np.lexsort(keys)
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        cut = np.flatnonzero(new)
        at = pa.array(order[cut])
        total = np.add.reduceat(np.asarray(b.column(2))[order], cut)
        rows = np.diff(np.append(cut, len(order)))
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), words.take(at), pa.array(total), pa.array(rows.astype(np.int64))], ["_record", "_suffix", "_total", "_rows"])


def _intervals(max_n: int):
    """Sums over the common-prefix intervals of each Arrow batch of sorted suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words, total, rows, shared = b.column(0), np.asarray(b.column(1)), np.asarray(b.column(2)), np.asarray(b.column(3))
            flat = words.flatten()
            size = np.asarray(words.value_lengths(), np.int64)
            begin = np.cumsum(size) - size
            codes = np.asarray(flat.dictionary_encode().indices)
            same = np.ones(b.num_rows, bool)
            same[0] = False
            for d in range(1, max_n + 1):
                deep = size >= d
                if not deep.any():
                    break
                code = np.where(deep, codes[np.where(deep, begin + d - 1, 0)], -1)
                same[1:] &= (code[1:] == code[:-1]) & deep[1:]
                # Rows too short for d words stand before the longer ones of their interval.
                first = np.flatnonzero(~same & deep)
                use = np.flatnonzero(deep)
                cut = np.searchsorted(use, first)
                records = 1 - (shared >= d)  # less the duplicate adjacencies
                sums = [np.add.reduceat(x[use], cut) for x in (total, rows, records)]
                offsets = np.arange(len(first) + 1, dtype=np.int32) * d
                grams = pa.ListArray.from_arrays(pa.array(offsets), flat.take(pa.array((begin[first][:, None] + np.arange(d)).ravel())))
                yield pa.RecordBatch.from_arrays([grams, pa.array(np.full(len(first), d, np.int32)), *(pa.array(x.astype(np.int64)) for x in sums)], ["gram", "n", "total", "rows", "records"])

    return run


def ngram_frequencies(df: DataFrame, record: str, words: str, weight: str | None = None, max_n: int = 1) -> DataFrame:
    """(gram, n, total, rows, records) for every n-gram of up to max_n words; longer ones are not counted.

    `words`: an array of words; a record may span many rows. `total`: the weighted occurrences (1 a
    row without `weight`), `rows`: the occurrences, `records`: the distinct records (null is a
    record). Rows with null or empty words have no grams, null words are left out, a null weight
    counts as 0."""
    w = F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(1).cast("long")
    d = df.select(F.col(record).alias("_record"), F.filter(F.col(words), lambda x: x.isNotNull()).alias("_words"), w.alias("_w")).where(F.size("_words") > 0)
    cut = F.transform(F.sequence(F.lit(1), F.size("_words")), lambda i: F.slice("_words", i, max_n))
    suffix = d.select("_record", F.explode(cut).alias("_suffix"), "_w")
    kind = suffix.schema["_record"].dataType.simpleString()
    own = suffix.mapInArrow(_combined, f"_record {kind}, _suffix array<string>, _total long, _rows long")
    # Only suffixes that begin alike can share words: a large record is split by its first words.
    w_own = W.partitionBy("_record", F.col("_suffix")[0]).orderBy("_suffix")
    own = own.withColumn("_same", _shared_words(F.col("_suffix"), F.lag("_suffix").over(w_own), max_n))
    array = own.repartitionByRange("_suffix", "_record").sortWithinPartitions("_suffix").select("_suffix", "_total", "_rows", "_same")
    grams = array.mapInArrow(_intervals(max_n), "gram array<string>, n int, total long, rows long, records long")
    return grams.groupBy("gram", "n").agg(*(F.sum(c).alias(c) for c in ("total", "rows", "records")))


_BLANK = r"(?U)^\s+|\s+$"


def clean_word(col: str) -> Column:
    """NFC, lower case, without outer blanks."""
    return F.regexp_replace(F.lower(composed(col)), _BLANK, "")


def _filled(col: str) -> Column:
    """Whether a value is more than blanks, judged without NFC: composition makes no blank."""
    return F.col(col).isNotNull() & (F.regexp_replace(col, _BLANK, "") != "")


def marked_counts(counts: DataFrame, rare_below: int = 5, common_share: int = 500) -> DataFrame:
    """(word, total, rows, records, mark) over word counts (source, word, n): `rare` is in one
    source with a total below `rare_below`, `common` in every source with more than one
    `common_share`-th of all counts, else null. Rows with n null or below 1, or a null or blank word, don't count."""
    usable = counts.where(F.col("n") > 0).where(_filled("word")).select("source", "word", F.col("n").cast("long").alias("n"))
    d = usable.select("source", F.array(clean_word("word")).alias("words"), "n")
    f = ngram_frequencies(d, "source", "words", "n")
    whole = usable.agg(F.struct(F.sum("n").alias("all"), F.count_distinct(F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).alias("sources")).alias("whole")).scalar()
    everywhere = F.col("records") == whole["sources"]
    mark = F.when((F.col("records") == 1) & (F.col("total") < rare_below), "rare").when(everywhere & (F.col("total") * common_share > whole["all"]), "common")
    return f.select(F.col("gram")[0].alias("word"), "total", "rows", "records", mark.alias("mark"))


def marked_lexicon(lexicon: DataFrame, common_in: int = 7) -> DataFrame:
    """(word, total, rows, records, mark) over lexicon rows (lexicon, word, per_billion): `rare` is
    on one row of the whole table, `common` in at least `common_in` lexicons. Comment lines, null or
    blank words and frequencies below 1 don't count."""
    usable = lexicon.where(F.col("per_billion") > 0).where(_filled("word") & ~F.startswith("word", F.lit("#")))
    d = usable.select("lexicon", F.array(clean_word("word")).alias("words"), F.col("per_billion").cast("long").alias("n"))
    f = ngram_frequencies(d, "lexicon", "words", "n")
    mark = F.when(F.col("rows") == 1, "rare").when(F.col("records") >= common_in, "common")
    return f.select(F.col("gram")[0].alias("word"), "total", "rows", "records", mark.alias("mark"))


def marked_words(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Both scopes: (scope, word, total, rows, records, mark)."""
    a = marked_counts(counts).select(F.lit("counts").alias("scope"), "*")
    return a.unionByName(marked_lexicon(lexicon).select(F.lit("lexicon").alias("scope"), "*"))
