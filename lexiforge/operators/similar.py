"""Words alike: by bare letters, by deletions, by slips and by weighted alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edits import FAR_COST, alignment_cost, slip_variants
from ..functions.text import bag_distance, bare, deletions
from ..session import small, spread


def same_letters(words: DataFrame, word: str = "word") -> DataFrame:
    """(letters, words, n): classes of words with equal bare letters, of two words or more.
    Classes instead of pairs, so that a large class stays one row per letters."""
    return words.select(bare(F.col(word)).alias("letters"), F.col(word).alias("word")).distinct().groupBy("letters").agg(F.count("*").alias("n"), F.min("word").alias("first"), F.max("word").alias("last")).where("n > 1")


def accented_forms(bare_words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """The lexicon words whose bare letters are a given word's (R8's competitors)."""
    forms = lexicon.select(F.col("word").alias("form"), bare(F.col("word")).alias("_b"), "per_billion")
    return bare_words.join(small(forms), F.col(word) == F.col("_b")).where(F.col("form") != F.col(word)).drop("_b")


def one_letter_apart(left: DataFrame, right: DataFrame, word: str = "word") -> DataFrame:
    """(word, other): pairs that share a deletion key and differ in bare letters. Each side
    gives one row a key, so the join is on equality and spreads by key."""
    a = left.select(F.col(word).alias("word")).distinct().select("word", F.explode(deletions(F.col("word"))).alias("_k"))
    b = right.select(F.col(word).alias("other")).distinct().select("other", F.explode(deletions(F.col("other"))).alias("_k"))
    return a.join(b, "_k").where((F.col("word") != F.col("other")) & (bare(F.col("word")) != bare(F.col("other")))).select("word", "other").distinct()


def slips_into(typed: DataFrame, lexicon: DataFrame, keys: str = "keys") -> DataFrame:
    """(keys, target, cost, marks): lexicon keys that one slip turns into what was typed. Distinct
    typed keys are varied once; lexicon (target, ...) is joined by equality."""
    d = spread(typed.select(keys).distinct(), keys).withColumn("_s", F.explode(slip_variants(keys)))
    d = d.select(keys, F.col("_s.keys").alias("target"), F.col("_s.cost").alias("cost"), F.col("_s.marks").alias("marks"))
    return d.join(small(lexicon), "target")


def two_slips_away(typed: DataFrame, lexicon: DataFrame, keys: str = "keys", target: str = "target", least: int = 4, limit: float = FAR_COST) -> DataFrame:
    """(keys, target, cost): lexicon words within `limit` of what was typed.

    Two slips delete, add, change or exchange letters, so both words come to one form after at most
    two deletions a side. Those forms are joined by equality; then length, letters and alignment
    decide. No pair of words is compared that shares no form."""
    a = typed.select(keys).distinct().where((F.char_length(keys) >= least) & F.col(keys).rlike("^[a-z]+$"))
    b = lexicon.select(target).distinct().where(F.col(target).rlike("^[a-z]+$") & (F.char_length(target) <= 31))

    def forms(col: str):
        once = deletions(F.col(col))
        return F.array_distinct(F.flatten(F.transform(once, lambda x: deletions(x))))

    a = a.select(keys, F.explode(forms(keys)).alias("_k"))
    b = b.select(target, F.explode(forms(target)).alias("_k"))
    c = a.join(b, "_k").where((F.col(keys) != F.col(target)) & (F.abs(F.char_length(keys) - F.char_length(target)) <= 2)).select(keys, target).distinct()
    c = c.where(bag_distance(F.col(keys), F.col(target)) <= 4)
    return spread(c, keys).withColumn("cost", alignment_cost(keys, target)).where(F.col("cost") <= limit)


def layout(rows: list[tuple[float, list[tuple[str, float]]]]) -> list[tuple[str, float, float, float, float]]:
    """(name, y0, y1, x0, x1) of keys in rows of given widths."""
    out = []
    for y, (start, keys) in enumerate(rows):
        x = start
        for name, width in keys:
            out.append((name, float(y), y + 1.0, float(x), float(x + width)))
            x += width
    return out


#: A common 60 per cent keyboard: widths in units of a letter key.
KEYBOARD = layout(
    [
        (0, [(c, 1.0) for c in "`1234567890-="] + [("backspace", 2.0)]),
        (0, [("tab", 1.5)] + [(c, 1.0) for c in "qwertyuiop[]"] + [("\\", 1.5)]),
        (0, [("caps", 1.75)] + [(c, 1.0) for c in "asdfghjkl;'"] + [("enter", 2.25)]),
        (0, [("lshift", 2.25)] + [(c, 1.0) for c in "zxcvbnm,./"] + [("rshift", 2.75)]),
        (0, [("lctrl", 1.25), ("lwin", 1.25), ("lalt", 1.25), ("space", 6.25), ("ralt", 1.25), ("rwin", 1.25), ("menu", 1.25), ("rctrl", 1.25)]),
    ]
)


def touching_keys(keys: DataFrame, overlap: float = 0.15, eps: float = 1e-6) -> DataFrame:
    """(key, other): keys side by side, or one above the other, that touch along `overlap` or
    more. Keys meet on the edge they share, a join on equality; keys is (name, y0, y1, x0, x1)."""
    a = keys.select(*[F.col(c).alias(f"a_{c}") for c in ("name", "y0", "y1", "x0", "x1")])
    b = keys.select(*[F.col(c).alias(f"b_{c}") for c in ("name", "y0", "y1", "x0", "x1")])
    r = lambda c: F.round(c, 4)
    along = lambda p, q: F.least(f"a_{q}", f"b_{q}") - F.greatest(f"a_{p}", f"b_{p}") >= overlap - eps
    side = a.join(b, r("a_x1") == r("b_x0")).where(along("y0", "y1"))
    stack = a.join(b, r("a_y1") == r("b_y0")).where(along("x0", "x1"))
    pairs = side.select("a_name", "b_name").unionByName(stack.select("a_name", "b_name"))
    both = pairs.unionByName(pairs.select(F.col("b_name").alias("a_name"), F.col("a_name").alias("b_name")))
    return both.select(F.col("a_name").alias("key"), F.col("b_name").alias("other")).distinct()
