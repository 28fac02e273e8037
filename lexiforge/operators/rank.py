"""From typed keys to a decision: readings, candidates, context, margins and the cascade.

Candidates are made once per distinct sequence of keys, in long form, and joined to the cases that
typed it; the expensive searches run only over keys that the cheap stages leave open."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import LN_BILLION
from ..functions.edits import slips
from ..functions.syllable import compose, telex, telex_keys, to_keys
from ..functions.text import bare, match_case, same_word, struct_type
from ..session import cut, small, spread
from .lexicon import parsed_lexicon
from .similar import two_slips_away

#: The score of a well-formed syllable no lexicon has, and the least keys of a word.
UNSEEN, MIN_KEYS, FAR_KEYS, ACRONYM = 3.0, 3, 4, 9.0


@dataclass(frozen=True)
class Tuning:
    """Thresholds of the decision, in nats. The presets."""

    known_word: float = 5.5
    known_syllable: float = 6.9
    rare: float = 0.5
    floor: float = 5.5
    margin: float = 3.5
    ambiguity: float = 1.0
    far_floor: float = 5.5
    far_ambiguity: float = 1.0
    penalty: float = 3.0
    decay: float = 0.7
    restore_margin: float = 6.5
    restore_ambiguity: float = 1.5
    restore_english: float = 8.0
    audit_margin: float = 4.0
    revise_margin: float = 8.0
    revise_far: float = 12.0
    revise_ambiguity: float = 3.0
    pair_weight: float = 0.5
    split_margin: float = 2.0
    split_lift: float = 1.0
    split_floor: float = 5.0


BALANCED = Tuning()
CAREFUL = replace(BALANCED, known_word=4.5, known_syllable=6.0, margin=5.5, floor=6.5, far_floor=7.5, restore_margin=8.0)
BOLD = replace(BALANCED, known_word=6.9, known_syllable=7.5, margin=1.5, floor=4.5, far_floor=5.0, restore_margin=5.0)
PRESETS = {"careful": CAREFUL, "balanced": BALANCED, "bold": BOLD}


def languages(lexicon: DataFrame) -> DataFrame:
    """(word, vi, en): ln frequency per language, null where a language lacks the word."""
    d = parsed_lexicon(lexicon).where(F.col("word").rlike(r"^\p{L}+$"))
    of = lambda p: F.max(F.when(F.startswith("lexicon", F.lit(p)), F.col("ln")))
    return d.groupBy("word").agg(of("vi").alias("vi"), of("en").alias("en")).where("vi is not null or en is not null")


def vote(lang: Column, decay: float = 0.7) -> Column:
    """The decayed vote of up to four last words: +1 for a word of Vietnamese only, -1 for English
    only; `lang` is an array of those numbers, oldest first. Between -1 and 1."""
    last = F.slice(F.reverse(lang), 1, 4)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("weight"))
    step = lambda acc, x: F.struct((acc["sum"] + acc["weight"] * x).alias("sum"), (acc["weight"] * decay).alias("weight"))
    return F.aggregate(last, start, step, lambda acc: F.least(F.greatest(acc["sum"], F.lit(-1.0)), F.lit(1.0)))


def history_votes(df: DataFrame, key: str, history: str, words: DataFrame, decay: float = 0.7) -> DataFrame:
    """(key, vote) for rows with a history (array of words, oldest first)."""
    d = df.select(key, F.posexplode(F.slice(F.reverse(history), 1, 4)).alias("_k", "_w")).withColumn("word", F.lower("_w"))
    d = d.join(small(words.select("word", "vi", "en")), "word", "left")
    side = F.when(F.col("vi").isNotNull() & F.col("en").isNull(), 1.0).when(F.col("en").isNotNull() & F.col("vi").isNull(), -1.0).otherwise(0.0)
    total = F.sum(side * F.pow(F.lit(decay), F.col("_k")))
    return d.groupBy(key).agg(F.least(F.greatest(total, F.lit(-1.0)), F.lit(1.0)).alias("vote"))


def language_bias(vote_: Column, vi: Column, en: Column, penalty: float = 3.0) -> Column:
    """What a word of the other language only loses."""
    against = ((vote_ < 0) & vi.isNotNull() & en.isNull()) | ((vote_ > 0) & en.isNotNull() & vi.isNull())
    return F.when(against, -penalty * F.abs(vote_)).otherwise(0.0)


def in_context(ln: Column, p: Column, weight: float = BALANCED.pair_weight) -> Column:
    """R2: ln per billion of a word, raised (or lowered) by its probability p behind the word before;
    as it is where p is null."""
    mixed = F.ln(weight * p + (1 - weight) * F.exp(ln - LN_BILLION)) + LN_BILLION
    return F.when(p.isNull(), ln).otherwise(mixed)


def right_bonus(word_ln: Column, next_ln: Column, p: Column, weight: float = BALANCED.pair_weight) -> Column:
    """What the word that follows says for a word: ln of how much likelier it is there than alone.
    0 if either is unknown; p is the probability of the pair, null if it was never seen."""
    alone = F.exp(next_ln - LN_BILLION)
    bonus = F.when(p.isNull(), math.log(1 - weight)).otherwise(F.ln(weight * p + (1 - weight) * alone) - F.ln(alone))
    return F.when(word_ln.isNull() | next_ln.isNull(), 0.0).otherwise(bonus)


def log_add(score: str) -> Column:
    """A10 as an aggregate: ln of the sum of exponentials, without overflow. Scores here lie between
    -60 and 30, so their exponentials do not leave the range of doubles."""
    return F.ln(F.sum(F.exp(score)))


def ranked(df: DataFrame, keys: list[str], word: str = "word", score: str = "score") -> DataFrame:
    """Adds `place`: by falling score, then word."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), F.col(word))))


def top_two(df: DataFrame, keys: list[str], word: str = "word", score: str = "score") -> DataFrame:
    """(keys, best, best_score, second_score): the leaders of short candidate lists."""
    r = ranked(df, keys, word, score).where("place <= 2")
    return r.groupBy(*keys).agg(F.max(F.when(F.col("place") == 1, F.col(word))).alias("best"), F.max(F.when(F.col("place") == 1, F.col(score))).alias("best_score"), F.max(F.when(F.col("place") == 2, F.col(score))).alias("second_score"))


def confident(best: Column, typed: Column, second: Column, margin: float, floor: float, ambiguity: float) -> Column:
    """A best score above the floor that leads what was typed and the runner-up; null is minus infinity."""
    return F.coalesce((best >= floor) & (typed.isNull() | (best - typed >= margin)) & (second.isNull() | (best - second >= ambiguity)), F.lit(False))


def signature(keys: str) -> str:
    """The letters of keys in order, without any tone key but the last: equal for all ways to type a
    syllable that use the same keys. z, which clears a tone, is left out with all tones."""
    tones = [c for c in keys if c in "sfrxj"]
    rest = [c for c in keys if c not in "sfrxjz"]
    if keys[:1] in "sfrxj":  # the initial consonant is no tone
        rest.append(keys[:1])
        tones = tones[1:]
    return "".join(sorted(rest)) + "|" + ("" if "z" in keys else tones[-1] if tones else "")


def signatures(word: str) -> list[str]:
    """The signatures of the ways to type a word: as to_keys has it, with one w for both letters of
    ươ, and with w alone for ư."""
    ways = {to_keys(word)}
    ways |= {k.replace("uwow", "uow") for k in ways}
    ways |= {k.replace("uw", "w", 1) for k in ways}
    ways |= {"w" + k for k in ways if "aa" in k or "oo" in k}  # a hat typed over a horn or breve
    ways |= {k.rstrip("sfrxj") + "z" for k in ways if k[-1:] not in "sfrxj"}
    return sorted({signature(k) for k in ways})


SLIPS = T.ArrayType(struct_type(keys=T.StringType(), cost=T.DoubleType(), marks=T.BooleanType(), signature=T.StringType()))


@F.arrow_udf(SLIPS)
def signed_slips(keys: pa.Array) -> pa.Array:
    """The slips of keys, each with its signature."""
    out = [[{"keys": t, "cost": c, "marks": m, "signature": signature(t)} for (t, m), c in slips(k).items()] if k else [] for k in keys.to_pylist()]
    return pa.array(out, pa.list_(pa.struct([("keys", pa.string()), ("cost", pa.float64()), ("marks", pa.bool_()), ("signature", pa.string())])))


@F.arrow_udf(T.ArrayType(T.StringType()))
def word_signatures(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else signatures(w) for w in words.to_pylist()], pa.list_(pa.string()))


def typed_scores(keys: DataFrame, words: DataFrame, tuning: Tuning = BALANCED) -> DataFrame:
    """(keys, shown, kind, en_score, syllable, typed): what distinct keys show and how well it is
    known: the best of the English word, the Vietnamese one, an escaped English word, and UNSEEN for a
    well-formed syllable; null if unknown."""
    d = spread(keys.select("keys").distinct(), "keys").withColumn("_t", telex("keys"))
    d = d.select("keys", F.col("_t.text").alias("shown"), F.col("_t.kind").alias("kind"))
    d = d.withColumn("syllable", F.when(F.col("kind") == "vietnamese", F.col("shown")))
    w = small(words)
    d = d.join(w.select(F.col("word").alias("keys"), F.col("en").alias("en_score")), "keys", "left")
    d = d.join(w.select(F.col("word").alias("syllable"), F.col("vi").alias("vi_score")), "syllable", "left")
    escaped = F.when((F.col("kind") == "literal") & (F.col("shown") != F.col("keys")), F.col("shown"))
    d = d.withColumn("_e", escaped).join(w.select(F.col("word").alias("_e"), F.col("en").alias("_ee")), "_e", "left")
    typed = F.greatest("en_score", "vi_score", F.when(F.col("_ee") >= tuning.known_word, F.col("_ee")), F.when(F.col("syllable").isNotNull(), UNSEEN))
    return d.select("keys", "shown", "kind", "syllable", "en_score", "vi_score", typed.alias("typed"))


def near_candidates(keys: DataFrame, words: DataFrame, restrict: bool = True) -> DataFrame:
    """(keys, word, score, vi, en): words one slip away. keys has (keys, syllable). With
    restrict, a well-formed syllable only changes its marks: same letters, a like tone.

    Most slips are no word's keys: they are dropped by signature, and only the rest is composed."""
    d = spread(keys.select("keys", "syllable").distinct(), "keys").withColumn("_s", F.explode(signed_slips("keys")))
    d = d.select("keys", "syllable", F.col("_s.cost").alias("cost"), F.col("_s.marks").alias("marks"), F.col("_s.keys").alias("_k"), F.col("_s.signature").alias("_g"))
    if restrict:
        d = d.where(F.col("marks") | F.col("syllable").isNull())
    w = small(words)
    en = d.join(w.where("en is not null").select(F.col("word").alias("_k"), "vi", "en"), "_k").select("keys", "syllable", F.col("_k").alias("word"), (F.col("en") - F.col("cost")).alias("s"), "vi", "en")
    likely = words.where("vi is not null").select(F.explode(word_signatures("word")).alias("_g")).distinct()
    vi = d.join(small(likely), "_g", "left_semi").withColumn("_t", telex("_k")).where("_t.kind = 'vietnamese'").withColumn("_v", F.col("_t.text"))
    vi = vi.join(w.where("vi is not null").select(F.col("word").alias("_v"), "vi", "en"), "_v").select("keys", "syllable", F.col("_v").alias("word"), (F.col("vi") - F.col("cost")).alias("s"), "vi", "en")
    out = en.withColumn("of_en", F.lit(True)).unionByName(vi.withColumn("of_en", F.lit(False))).where((F.col("word") != F.col("keys")) & (F.col("syllable").isNull() | (F.col("word") != F.col("syllable"))))
    if restrict:
        out = out.where(F.col("syllable").isNull() | same_word(F.col("syllable"), F.col("word")))
    return _added(out)


def _added(ways: DataFrame) -> DataFrame:
    """(keys, word, score, as_vi, as_en, vi, en): all ways from keys to a word as one score; also by language."""
    of = lambda test: F.ln(F.sum(F.when(test, F.exp("s"))))
    return ways.groupBy("keys", "word").agg(log_add("s").alias("score"), of(~F.col("of_en")).alias("as_vi"), of(F.col("of_en")).alias("as_en"), F.max("vi").alias("vi"), F.max("en").alias("en"))


def contextual(candidates: DataFrame, contexts: DataFrame, bigrams: DataFrame | None, tuning: Tuning = BALANCED) -> DataFrame:
    """The candidates of keys in each context (keys, before, vote) of theirs, `score` with the word before
    and the language of the phrase. bigrams: (prev, word, p); the reading of each language is raised on its own."""
    d = candidates.join(contexts, "keys")
    if bigrams is not None:
        d = d.join(small(bigrams.select(F.col("prev").alias("before"), "word", F.col("p").alias("_p"))), ["before", "word"], "left")
    else:
        d = d.withColumn("_p", F.lit(None).cast("double"))
    p = F.col("_p")
    raised = lambda part, ln: F.exp(part + in_context(ln, p, tuning.pair_weight) - ln)
    both = F.coalesce(raised(F.col("as_vi"), F.col("vi")), F.lit(0.0)) + F.coalesce(raised(F.col("as_en"), F.col("en")), F.lit(0.0))
    return d.withColumn("score", F.ln(both) + language_bias(F.col("vote"), F.col("vi"), F.col("en"), tuning.penalty)).drop("_p")


def far_candidates(keys: DataFrame, words: DataFrame) -> DataFrame:
    """(keys, word, score, vi, en): words two slips away of unknown keys."""
    en = words.where("en is not null").select(F.col("word").alias("target"), "word", F.col("en").alias("ln"), "vi", "en")
    vi = words.where("vi is not null").select(telex_keys("word").alias("target"), "word", F.col("vi").alias("ln"), "vi", "en")
    targets = en.withColumn("of_en", F.lit(True)).unionByName(vi.withColumn("of_en", F.lit(False)))
    d = two_slips_away(keys, targets).join(small(targets), "target").where(F.col("word") != F.col("keys"))
    return _added(d.withColumn("s", F.col("ln") - F.col("cost")))


def restored(keys: DataFrame, words: DataFrame, tuning: Tuning = BALANCED) -> DataFrame:
    """(keys, restored): the accented word meant by keys typed without marks. keys: as typed_scores."""
    vi = words.where("vi is not null")
    forms = vi.select(F.col("word").alias("form"), bare("word").alias("keys"), F.col("vi").alias("score")).where("form != keys")
    d = keys.where((F.col("shown") == F.col("keys")) & (F.coalesce("en_score", F.lit(-math.inf)) < tuning.restore_english)).select("keys", F.coalesce("vi_score", F.lit(UNSEEN)).alias("own"))
    t = top_two(d.join(small(forms), "keys").select("keys", "own", F.col("form").alias("word"), "score"), ["keys", "own"])
    ok = (F.col("best_score") - F.col("own") >= tuning.restore_margin) & (F.col("second_score").isNull() | (F.col("best_score") - F.col("second_score") >= tuning.restore_ambiguity))
    return t.where(ok).select("keys", F.col("best").alias("restored"))


#: The keys of a syllable in a run, and the cuts kept at each place.
PIECE_KEYS, BEAM = (2, 9), 6


@F.arrow_udf(struct_type(split=T.StringType(), score=T.DoubleType(), lift=T.DoubleType(), second=T.DoubleType()))
def cut_runs(keys: pa.Array, pieces: pa.Array, pairs: pa.Array) -> pa.Array:
    """The best cut of keys into syllables: a beam over the places of cuts. pieces: (at, to, word, ln);
    pairs: (prev, word, p). Also its score, the least by which a word is likelier behind the one before it
    than alone, and the score of the runner-up."""
    out = []
    for k, rows, seen in zip(keys.to_pylist(), pieces.to_pylist(), pairs.to_pylist()):
        from_ = {}
        for r in rows or []:
            from_.setdefault(r["at"], []).append(r)
        chance = {(r["prev"], r["word"]): r["p"] for r in seen or []}
        beams = {0: [(0.0, (), math.inf)]}
        for at in range(len(k)):
            for score, words, lift in beams.pop(at, []):
                for r in from_.get(at, []):
                    p = chance.get((words[-1], r["word"])) if words else None
                    ln = r["ln"] if p is None else math.log(BALANCED.pair_weight * p + (1 - BALANCED.pair_weight) * math.exp(r["ln"] - LN_BILLION)) + LN_BILLION
                    one = (score + ln - LN_BILLION, (*words, r["word"]), min(lift, ln - r["ln"]) if words else lift)
                    beams[r["to"]] = sorted([*beams.get(r["to"], []), one], key=lambda x: (-x[0], x[1]))[:BEAM]
        done = beams.get(len(k), [])
        good = bool(done) and len(done[0][1]) >= 2
        out.append({"split": " ".join(done[0][1]), "score": done[0][0], "lift": done[0][2], "second": done[1][0] if len(done) > 1 else None} if good else None)
    return pa.array(out, pa.struct([("split", pa.string()), ("score", pa.float64()), ("lift", pa.float64()), ("second", pa.float64())]))


def split_runs(keys: DataFrame, words: DataFrame, bigrams: DataFrame | None = None, tuning: Tuning = BALANCED) -> DataFrame:
    """(keys, split): unknown keys that are several syllables typed without blanks. Every piece of the keys
    meets the syllables' keys by equality, and two pieces that follow each other the pairs of words
    (prev, word, p); a cut needs every later word to be likelier there by split_lift, so without bigrams
    nothing is cut."""
    d = keys.select("keys").distinct().where(F.col("keys").rlike("^[a-z]{5,}$"))
    low, high = PIECE_KEYS
    n = F.char_length("keys")
    starts = F.sequence(F.lit(0), n - low)
    ends = lambda i: F.sequence(i + low, F.least(n, i + high))
    pieces = F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda j: F.struct(i.alias("at"), j.alias("to"), F.substr("keys", i + 1, j - i).alias("piece")))))
    s = words.where((F.col("vi") >= tuning.split_floor) & (F.char_length("word") >= 2)).select(telex_keys("word").alias("piece"), "word", F.col("vi").alias("ln"))
    p = d.select("keys", F.explode(pieces).alias("x")).select("keys", "x.at", "x.to", "x.piece").join(small(s), "piece").drop("piece")
    row = F.struct("at", "to", "word", "ln")
    g = p.groupBy("keys").agg(F.array_sort(F.collect_list(row)).alias("pieces"))
    empty = F.array().cast("array<struct<prev:string,word:string,p:double>>")
    if bigrams is None:
        g = g.withColumn("pairs", empty)
    else:
        left, right = p.select("keys", F.col("to").alias("at"), F.col("word").alias("prev")), p.select("keys", "at", "word")
        next_to = left.join(right, ["keys", "at"]).select("keys", "prev", "word").distinct().join(small(bigrams.select("prev", "word", "p")), ["prev", "word"])
        g = g.join(next_to.groupBy("keys").agg(F.array_sort(F.collect_list(F.struct("prev", "word", "p"))).alias("pairs")), "keys", "left").withColumn("pairs", F.coalesce("pairs", empty))
    g = g.withColumn("_c", cut_runs("keys", "pieces", "pairs"))
    clear = (F.col("_c.lift") >= tuning.split_lift) & (F.col("_c.second").isNull() | (F.col("_c.score") - F.col("_c.second") >= tuning.split_margin))
    return g.where(clear).select("keys", F.col("_c.split").alias("split"))


def keys_of(col: Column) -> Column:
    """Lower-case keys of a word worth scoring, else null."""
    low = F.lower(col)
    return F.when(low.rlike(f"^[a-z]{{{MIN_KEYS},}}$"), low)


def decide(cases: DataFrame, words: DataFrame, tuning: Tuning = BALANCED, misspellings: DataFrame | None = None, personal: DataFrame | None = None, bigrams: DataFrame | None = None, english: bool = True) -> DataFrame:
    """Cases (case_id, typed keys in `raw`, history array) to (case_id, stage, fix): the first
    stage of the cascade that speaks; `fix` null means the word is left alone.

    personal (word, fix): a null fix means ignore. misspellings (keys, fix). bigrams (prev, word, p): candidates
    are scored behind the word before (R2) and by the language of the phrase (R3). Without `english` a best
    candidate of plain letters wins by leaving the word alone (P13)."""
    d = cases.select("case_id", "raw", "history").withColumn("lower", F.lower("raw")).withColumn("keys", keys_of(F.col("raw")))
    first = F.substring("raw", 1, 1)
    d = d.withColumn("capital", (F.upper(first) == first) & (F.lower(first) != first)).withColumn("follows", F.size("history") > 0)
    d = d.withColumn("before", F.coalesce(F.lower(F.try_element_at("history", F.lit(-1))), F.lit("")))
    d = cut(d.join(history_votes(cases, "case_id", "history", words, tuning.decay), "case_id", "left").withColumn("vote", F.coalesce("vote", F.lit(0.0))))
    empty = d.sparkSession.createDataFrame([], "word string, fix string")
    mine = (personal if personal is not None else empty).select(F.lower("word").alias("lower"), F.col("fix").alias("own_fix"), F.lit(True).alias("own"))
    miss = (misspellings if misspellings is not None else empty.select(F.col("word").alias("keys"), "fix")).select("keys", F.col("fix").alias("misspelt"))
    scored = cut(typed_scores(d.where("keys is not null"), words, tuning))
    known = F.coalesce(F.col("typed") >= F.when(F.col("syllable").isNotNull(), tuning.known_syllable).otherwise(tuning.known_word), F.lit(False))
    open_ = scored.where(~known)
    context = ["keys", "before", "vote"]
    contexts = d.where("keys is not null").select(*context).distinct()

    def leaders(candidates: DataFrame, name: str) -> DataFrame:
        """Per context the best two, what the lexicons say of the best, and whether a candidate is English only."""
        c = cut(contextual(candidates, contexts, bigrams, tuning))
        best = top_two(c, context).select(*context, F.col("best").alias(name), F.col("best_score").alias(f"{name}_score"), F.col("second_score").alias(f"{name}_second"))
        some = c.groupBy(*context).agg(F.max(F.col("en").isNotNull() & F.col("vi").isNull()).alias(f"{name}_en"))
        of = words.select(F.col("word").alias(name), F.col("vi").alias(f"{name}_vi"))
        return best.join(some, context).join(small(of), name, "left")

    near = cut(leaders(near_candidates(open_, words), "near"))
    nothing_said = ~confident(F.col("near_score"), F.lit(None).cast("double"), F.col("near_second"), tuning.margin, tuning.floor, tuning.ambiguity)
    unknown = open_.where("typed is null").select("keys", "syllable", "shown")
    left = contexts.join(unknown.select("keys"), "keys").join(near, context, "left").where(F.col("near_score").isNull() | nothing_said).select("keys").distinct()
    nothing = cut(unknown.join(left, "keys", "left_semi"))
    far = leaders(far_candidates(nothing, words), "far")
    d = d.join(small(mine), "lower", "left").join(small(miss), "keys", "left").join(scored, "keys", "left").join(restored(scored, words, tuning), "keys", "left")
    d = d.join(near, context, "left").join(far, context, "left").join(split_runs(nothing, words, bigrams, tuning), "keys", "left")
    d = d.join(small(words.select(F.col("word").alias("before"), F.col("vi").alias("before_vi"), F.col("en").alias("before_en"))), "before", "left")
    phrase = lambda name: english_phrase(F.col("before_vi"), F.col("before_en"), F.col(f"{name}_vi"), F.col(f"{name}_en"))
    capitals = (F.char_length("raw") >= 2) & (F.upper("raw") == F.col("raw")) & (F.lower("raw") != F.col("raw"))
    acronym = lambda name: capitals & (F.col(f"{name}_score") < ACRONYM)
    plain = lambda name: F.lit(not english) & ~F.col(name).rlike("[^\\x00-\\x7F]")
    near_ok = confident(F.col("near_score"), F.col("typed") - tuning.rare, F.col("near_second"), tuning.margin, tuning.floor, tuning.ambiguity)
    far_ok = F.col("typed").isNull() & ~F.col("capital") & (F.char_length("keys") >= FAR_KEYS)
    far_ok = far_ok & confident(F.col("far_score"), F.lit(None).cast("double"), F.col("far_second"), tuning.margin, tuning.far_floor, tuning.far_ambiguity)
    steps: list[tuple[Column, str, Column | None]] = [
        (F.col("own") & F.col("own_fix").isNotNull(), "personal fix", F.col("own_fix")),
        (F.col("own"), "personal ignore", None),
        (F.col("keys").isNull(), "not scored", None),
        (F.col("keys").rlike("^[jfz]"), "protected", None),
        (F.col("misspelt").isNotNull(), "misspelling", F.col("misspelt")),
        (F.col("restored").isNotNull() & ~F.col("capital"), "restored", F.col("restored")),
        (known, "known", None),
        (F.col("capital") & (F.col("typed").isNotNull() | F.col("follows")), "name", None),
        (F.col("near").isNotNull() & plain("near"), "plain", None),
        (near_ok & phrase("near"), "english phrase", None),
        (near_ok & acronym("near"), "acronym", None),
        (near_ok, "near", F.col("near")),
        (F.col("typed").isNull() & F.col("split").isNotNull(), "split", F.col("split")),
        (far_ok & plain("far"), "plain", None),
        (far_ok & phrase("far"), "english phrase", None),
        (far_ok & acronym("far"), "acronym", None),
        (far_ok, "far", F.col("far")),
    ]
    stage, fix = F.lit("none"), F.lit(None).cast("string")
    for test, name, out in reversed(steps):
        test = F.coalesce(test, F.lit(False))
        stage = F.when(test, name).otherwise(stage)
        fix = F.when(test, match_case(F.col("raw"), out) if out is not None else F.lit(None).cast("string")).otherwise(fix)
    return d.select("case_id", stage.alias("stage"), fix.alias("fix"))


def english_phrase(prev_vi: Column, prev_en: Column, best_vi: Column, candidates_en_only: Column) -> Column:
    """An English-only word before, a Vietnamese best, and an English-only word among the candidates."""
    return prev_en.isNotNull() & prev_vi.isNull() & best_vi.isNotNull() & candidates_en_only


def audited(original: Column, fixed: Column, margin: float = BALANCED.audit_margin) -> Column:
    """Whether a fix is taken back: with what follows, the word as typed beats it by the margin."""
    return F.coalesce(original, F.lit(-99.0)) - F.coalesce(fixed, F.lit(-99.0)) >= margin


def revised(scores: DataFrame, keys: list[str], tuning: Tuning = BALANCED) -> DataFrame:
    """(keys, fix): rows (keys, word, score, keep, expanded) with `score` and `keep` (the typed
    word's) including what follows; only words with marks can win."""
    r = ranked(scores.where("word rlike '[^\\\\x00-\\\\x7F]'"), keys).where("place <= 2")
    one = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    g = r.groupBy(*keys).agg(one("word").alias("fix"), one("score").alias("_a"), one("keep").alias("_k"), one("expanded").alias("_x"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("_b"))
    margin = F.when(F.col("_x"), tuning.revise_far).otherwise(tuning.revise_margin)
    return g.where((F.col("_a") - F.col("_k") >= margin) & (F.col("_b").isNull() | (F.col("_a") - F.col("_b") >= tuning.revise_ambiguity))).select(*keys, "fix")


def close_call(best: Column, second: Column, typed: Column) -> Column:
    """F32: whether a word left alone was a hard case: no clear winner, and not plainly fine as typed."""
    fine = F.coalesce(typed - best > 3.0, F.lit(False))
    clear = F.coalesce((second.isNull() | (best - second >= 2.0)) & (typed.isNull() | (best - typed >= 3.0)), F.lit(False))
    return ~fine & ~clear


def note(best: Column, best_score: Column, second: Column, second_score: Column, typed: Column) -> Column:
    show = lambda s: F.when(s.isNull(), "-").otherwise(F.format_string("%.1f", s))
    return F.format_string("%s %s | %s %s | typed %s", best, show(best_score), F.coalesce(second, F.lit("-")), show(second_score), show(typed))
