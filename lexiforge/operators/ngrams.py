"""Counts and probabilities of word sequences: conditional, and interpolated Kneser-Ney.

N-grams are cut inside each text, counted with a partial count where they are read, and only then
meet the lexicon, except for triples, of which unknown ones are dropped before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import quantise
from ..session import cut, small
from .tokens import sliding

#: Backoff weight of a context that was pruned.
DEFAULT_GAMMA = 0.85


def _known(df: DataFrame, cols: list[str], known: DataFrame) -> DataFrame:
    for c in cols:
        df = df.join(small(known.select(F.col("word").alias(c))), c, "left_semi")
    return df


def counts(tokens: DataFrame, n: int, known: DataFrame | None = None, weight: Column | None = None, names: tuple[str, ...] = ("a", "b", "w"), must: int | None = None) -> DataFrame:
    """A4: (names[-n:], n) of word runs without a break between them; of known words only if given, or of
    runs whose first `must` words are known. Unknown ones are dropped before they are counted or shuffled."""
    cols = list(names[-n:])
    d = tokens.select(F.explode(sliding(F.col("tokens"), n)).alias("g"), (weight if weight is not None else F.lit(1)).cast("long").alias("weight"))
    d = d.where(reduce(lambda p, q: p & q, [F.col("g")[i] != "" for i in range(n)]))
    d = d.select(*[F.col("g")[i].alias(c) for i, c in enumerate(cols)], "weight")
    if known is not None:
        d = _known(d, cols[:must], known)
    return d.groupBy(*cols).agg(F.sum("weight").alias("n"))


def bigram_probabilities(tokens: DataFrame, known: DataFrame, least: int = 6) -> DataFrame:
    """A2: (prev, word, n, total, q): pairs of known words; a total counts every word, known or not,
    behind a known one, and no break or end."""
    pairs = counts(tokens, 2, known, names=("prev", "word"), must=1)
    totals = pairs.groupBy("prev").agg(F.sum("n").alias("total"))
    kept = _known(pairs.where(F.col("n") >= least), ["word"], known)
    return kept.join(totals, "prev").withColumn("q", quantise(F.col("n") / F.col("total")))


def trigram_probabilities(tokens: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """A3: (first, second, word, n, total, q)."""
    d = counts(tokens, 3, known, names=("first", "second", "word"), must=2)
    totals = d.groupBy("first", "second").agg(F.sum("n").alias("total"))
    kept = _known(d.where(F.col("n") >= least), ["word"], known)
    return kept.join(totals, ["first", "second"]).withColumn("q", quantise(F.col("n") / F.col("total")))


def discount(df: DataFrame, n: str) -> DataFrame:
    """One row (d, n1, n2)."""
    d = df.agg(F.count_if(F.col(n) == 1).alias("n1"), F.count_if(F.col(n) == 2).alias("n2"))
    raw = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))
    return d.select(F.when(F.col("n1") + 2 * F.col("n2") == 0, 0.75).otherwise(F.least(F.greatest(raw, F.lit(0.1)), F.lit(0.95))).alias("d"), "n1", "n2")


class KneserNey:
    """An interpolated Kneser-Ney model of a vocabulary.

    unigrams (word, p1, g2), bigrams (b, w, n, p), trigrams (a, b, w, n, p), gammas (a, b, g3)."""

    def __init__(self, tokens: DataFrame, known: DataFrame, pair: int = 6, triple: int = 3, weight: Column | None = None) -> None:
        # Written once: every table below is made from these counts.
        self.c2 = cut(counts(tokens, 2, known, weight))
        self.c3 = cut(counts(tokens, 3, known, weight))
        self.n2 = self.c3.groupBy("b", "w").agg(F.count("*").alias("n2"))
        n1 = self.c2.groupBy("w").agg(F.count("*").alias("n1"))
        self.context3 = self.c3.groupBy("a", "b").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        context2 = self.n2.groupBy("b").agg(F.sum("n2").alias("sum2"), F.count("*").alias("types2"))
        self.d3, self.d2 = discount(self.c3, "n"), discount(self.n2, "n2")
        d2, d3 = self.d2.select("d").scalar(), self.d3.select("d").scalar()
        all1 = F.greatest(n1.agg(F.sum("n1").alias("s")).select("s").scalar(), F.lit(1))
        u = known.select("word").join(n1.withColumnRenamed("w", "word"), "word", "left").join(context2.withColumnRenamed("b", "word"), "word", "left")
        self.unigrams = u.select("word", (F.greatest(F.coalesce("n1", F.lit(0)).cast("double"), F.lit(0.5)) / all1).alias("p1"), F.coalesce(d2 * F.col("types2") / F.col("sum2"), F.lit(1.0)).alias("g2"), F.coalesce("sum2", F.lit(0)).alias("sum2"))
        self.bigrams = self._p2(self.c2.where(F.col("n") >= pair), d2).select("b", "w", "n", F.col("p2").alias("p"))
        kept = self._p2(self.c3.where(F.col("n") >= triple), d2).join(self.context3, ["a", "b"])
        g3 = d3 * F.col("types") / F.col("total")
        self.trigrams = kept.select("a", "b", "w", "n", (F.greatest(F.col("n") - d3, F.lit(0.0)) / F.col("total") + g3 * F.col("p2")).alias("p"))
        self.gammas = self.context3.join(self.trigrams.select("a", "b").distinct(), ["a", "b"], "left_semi").select("a", "b", (d3 * F.col("types") / F.col("total")).alias("g3"))

    def _p2(self, df: DataFrame, d2: Column) -> DataFrame:
        """Adds p2 of (b, w)."""
        uni = self.unigrams
        d = df.join(self.n2, ["b", "w"], "left").join(uni.select(F.col("word").alias("w"), "p1"), "w").join(uni.select(F.col("word").alias("b"), "g2", "sum2"), "b")
        high = F.greatest(F.coalesce("n2", F.lit(0)) - d2, F.lit(0.0)) / F.greatest("sum2", F.lit(1))
        return d.withColumn("p2", F.when(F.col("sum2") == 0, F.col("p1")).otherwise(high + F.col("g2") * F.col("p1")))

    def score(self, df: DataFrame, first: str, second: str, word: str, out: str = "ln_p") -> DataFrame:
        """Adds ln P(word | first, second): the triple, else its context's weight times the pair,
        else the pair's context's weight times the word. `first` may be null; null for unknown words."""
        uni, d = self.unigrams, df
        d = d.join(self.trigrams.select(F.col("a").alias(first), F.col("b").alias(second), F.col("w").alias(word), F.col("p").alias("_p3")), [first, second, word], "left")
        d = d.join(self.gammas.select(F.col("a").alias(first), F.col("b").alias(second), F.col("g3").alias("_g3")), [first, second], "left")
        d = d.join(self.bigrams.select(F.col("b").alias(second), F.col("w").alias(word), F.col("p").alias("_p2")), [second, word], "left")
        d = d.join(small(uni.select(F.col("word").alias(second), F.col("g2").alias("_g2"))), second, "left")
        d = d.join(small(uni.select(F.col("word").alias(word), F.col("p1").alias("_p1"))), word, "left")
        p2 = F.coalesce("_p2", F.col("_g2") * F.col("_p1"))
        p = F.when(F.col(first).isNull(), p2).otherwise(F.coalesce("_p3", F.coalesce("_g3", F.lit(DEFAULT_GAMMA)) * p2))
        return d.withColumn(out, F.ln(p)).drop("_p3", "_g3", "_p2", "_g2", "_p1")


def mixed(pair: Column, triple: Column, single: Column, pair_weight: float = 0.5, triple_weight: float = 0.7) -> Column:
    """The linear mixture of the probabilities that are there."""
    two = F.when(pair.isNotNull(), pair_weight * pair + (1 - pair_weight) * single).otherwise(single)
    return F.when(triple.isNotNull(), triple_weight * triple + (1 - triple_weight) * two).otherwise(two)


def successions(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, first, second, word): each word with the one or two words before it in its phrase;
    words at the start of a phrase have no row."""
    padded = F.concat(F.array(F.lit("")), F.col("tokens"))
    d = tokens.select(*keys, F.posexplode(sliding(padded, 3)).alias("pos", "g")).where((F.col("g")[1] != "") & (F.col("g")[2] != ""))
    return d.select(*keys, "pos", F.when(F.col("g")[0] != "", F.col("g")[0]).alias("first"), F.col("g")[1].alias("second"), F.col("g")[2].alias("word"))


def text_scores(model: KneserNey, tokens: DataFrame, keys: list[str], unknown: float = -16.0) -> DataFrame:
    """R13 over whole texts: (keys, words, known, ln_p): the sum of ln P of the words that follow one,
    with a flat penalty for those the model doesn't know."""
    d = model.score(successions(tokens, keys), "first", "second", "word")
    return d.groupBy(*keys).agg(F.count("*").alias("words"), F.count("ln_p").alias("known"), F.sum(F.coalesce("ln_p", F.lit(unknown))).alias("ln_p"))
