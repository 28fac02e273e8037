"""The queries of the core by name, each over its whole tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, edits, text
from ..functions.corrupt import by_rules, corrupted
from ..functions.syllable import canonical_syllable, telex, telex_keys, vni_keys
from ..functions.typist import typed_with_slip
from ..operators import evaluate, journal, learned, lexicon, mining, ngrams, rank, sampling, similar, tokens
from ..session import cut, running, small, spread
from ..sources import readers
from ..streaming import engine, windows
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql_text: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql_text:
            _SQL[f.__name__] = sql_text
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _tok(s: SparkSession, d: str) -> DataFrame:
    return tokens.with_tokens(_t(s, d, "documents").select("doc_id", "source", "text"))


def _known(s: SparkSession, d: str) -> DataFrame:
    """Cut: it is joined several times in most plans."""
    return cut(lexicon.known_words(_t(s, d, "lexicon")))


def _languages(s: SparkSession, d: str) -> DataFrame:
    return cut(rank.languages(_t(s, d, "lexicon")))


def _r(c, n: int = 6):
    return F.round(c, n)


# Words and phrases.


@query(f"with {sql.TOK} select doc_id, pos, case when w <> '' then w end as word, w = '' as is_break from tok")
def token_stream(s, d):
    return tokens.token_rows(_tok(s, d), "doc_id")


@query(f"with {sql.TOK} select source, count(*) filter (w <> '') as words, count(*) filter (w = '') as breaks, count(distinct case when w <> '' then w end) as distinct_words from tok group by source")
def token_breaks(s, d):
    rows = _tok(s, d).select("source", F.explode("tokens").alias("w")).groupBy("source", "w").agg(F.count("*").alias("n"))
    return rows.groupBy("source").agg(F.sum(F.when(F.col("w") != "", F.col("n")).otherwise(0)).alias("words"), F.sum(F.when(F.col("w") == "", F.col("n")).otherwise(0)).alias("breaks"), F.count_if(F.col("w") != "").alias("distinct_words"))


@query(f"with {sql.PHRASE} select doc_id, phrase, count(*) as words, string_agg(w, ' ' order by pos) as text from phr group by doc_id, phrase")
def phrase_words(s, d):
    p = tokens.phrase_rows(_t(s, d, "documents"), "doc_id")
    return p.select("doc_id", "phrase", F.size("words").cast("long").alias("words"), F.array_join("words", " ").alias("text"))


@query(f"""with {sql.PHRASE}, o as (select *, row_number() over (partition by doc_id, phrase order by pos) - 1 as k,
string_agg(w, ' ') over (partition by doc_id, phrase order by pos rows between 3 preceding and 1 preceding) as h,
string_agg(w, ' ') over (partition by doc_id, phrase order by pos rows between 1 following and 3 following) as r from phr)
select doc_id, phrase, cast(k as int) as pos, w as word, coalesce(h, '') as history, coalesce(r, '') as "right" from o""")
def word_contexts(s, d):
    c = tokens.contexts(tokens.phrase_rows(_t(s, d, "documents"), "doc_id"), ["doc_id", "phrase"])
    return c.select("doc_id", "phrase", "pos", "word", F.array_join("history", " ").alias("history"), F.array_join("right", " ").alias("right"))


@query(r"""with t as (select distinct vsec_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]') as tk from vsec where vsec_id is not null and text is not null),
e as (select vsec_id, tk, unnest(range(0, len(tk))) as pos from t)
select vsec_id, cast(pos as int) as pos, cast(pos - greatest(pos + 2 - 40, 0) + 1 as int) as "at", '<env> ' || array_to_string(tk[greatest(pos + 2 - 40, 0) + 1 : pos + 2], ' ') as "window" from e where pos + 2 <= len(tk)""")
def right_windows(s, d):
    v = _t(s, d, "vsec").where("vsec_id is not null and text is not null").select("vsec_id", "text").distinct().withColumn("tokens", tokens.raw_tokens(F.col("text")))
    w = tokens.right_windows(v, "vsec_id", "tokens")
    return w.select("vsec_id", "pos", "at", F.array_join("window", " ").alias("window"))


@query(r"""with t as (select vsec_id, any_value(nfc_normalize(text)) as t from vsec where vsec_id is not null and text is not null group by vsec_id),
p as (select vsec_id, regexp_extract_all(t, '(?s)[\p{L}\p{N}_]+|.') as p from t), e as (select vsec_id, unnest(p) as token, unnest(range(1, len(p) + 1)) as i from p),
c as (select *, sum(length(token)) over (partition by vsec_id order by i) as b from e)
select vsec_id, cast(row_number() over (partition by vsec_id order by i) as int) as pos, token, cast(b - length(token) as bigint) as start, cast(b as bigint) as "end" from c where not regexp_full_match(token, '[\s\p{Z}]')""")
def token_spans(s, d):
    v = _t(s, d, "vsec").where("vsec_id is not null").dropDuplicates(["vsec_id"])
    return tokens.spans(v, "vsec_id", "text")


@query(f"with {sql.WORDS}, {sql.FORMS} select word, bare, untoned, tone, shape from forms")
def word_forms(s, d):
    w = _t(s, d, "word_counts").where("word is not null").select(F.trim(text.nfc("word")).alias("word")).where("word != ''").distinct()
    return w.select("word", text.bare(F.col("word")).alias("bare"), text.untoned(F.col("word")).alias("untoned"), text.tone_of(F.col("word")).alias("tone"), text.shape(F.col("word")).alias("shape"))


@query()
def syllable_forms(s, d):
    """The canonical form of each known word, its keys, and what they compose to again."""
    w = _known(s, d).select("word", canonical_syllable("word").alias("canonical"), telex_keys("word").alias("telex"), vni_keys("word").alias("vni"))
    return w.withColumn("_t", telex("telex")).select("word", "canonical", "telex", "vni", F.col("_t.text").alias("shown"), F.col("_t.kind").alias("kind"))


@query(f"with {sql.CASES}, p as (select *, len(list_filter(range(1, least(length(typed), length(gold)) + 1), lambda i: substr(typed, 1, i) = substr(gold, 1, i))) as k from c) select case_id, cast(length(typed) - k as int) as backspaces, substr(gold, k + 1) as text from p")
def edit_actions(s, d):
    c = _cases(s, d).withColumn("a", text.edit_action(F.col("typed"), F.col("gold")))
    return c.select("case_id", F.col("a.backspaces").alias("backspaces"), F.col("a.text").alias("text"))


@query(r"""select distinct vsec_id, len(regexp_extract_all(nfc_normalize(text), '[\p{L}\p{N}]+')) as words, len(regexp_extract_all(nfc_normalize(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]')) as tokens from vsec where vsec_id is not null and text is not null""")
def screen_words(s, d):
    v = _t(s, d, "vsec").where("vsec_id is not null and text is not null").select("vsec_id", "text").distinct().withColumn("text", text.nfc("text"))
    return v.select("vsec_id", F.size(tokens.screen_words(F.col("text"))).cast("long").alias("words"), F.size(tokens.raw_tokens(F.col("text"))).cast("long").alias("tokens")).distinct()


# Lexicons.


@query(f"with {sql.COUNTS} select source, word, n from counts")
def word_freq_by_source(s, d):
    return lexicon.word_counts(_t(s, d, "word_counts"))


@query(f"with {sql.COMBINED} select word, round(per_billion, 3) as per_billion, sources from comb")
def lexicon_combined(s, d):
    return lexicon.combine(lexicon.word_counts(_t(s, d, "word_counts"))).select("word", _r("per_billion", 3).alias("per_billion"), "sources")


@query(f"with {sql.COMBINED} select word, sources, row_number() over (order by round(per_billion, 3) desc, word) as place from comb where per_billion >= 100 and (sources >= 2 or per_billion >= 200)")
def lexicon_frequent(s, d):
    """The lexicon to write, in its order; places by range counts, not in one task."""
    f = lexicon.frequent(lexicon.combine(lexicon.word_counts(_t(s, d, "word_counts")))).withColumn("p", _r("per_billion", 3))
    order = [F.desc("p"), F.asc("word")]
    ranged = cut(f.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()))
    return running(ranged.withColumn("_one", F.lit(1)), ["_one"], order, F.col("_b"), F.lit(1), "place").select("word", "sources", F.col("place").cast("long").alias("place"))


@query(f"with {sql.LEX} select lexicon, word, cast(row_number() over (partition by lexicon order by line_no, word) - 1 as int) as id, per_billion, round(ln(per_billion), 6) as ln from lex")
def lexicon_ids(s, d):
    return lexicon.parsed_lexicon(_t(s, d, "lexicon")).withColumn("ln", _r("ln"))


@query(f"with {sql.LEX}, b as (select word, max(per_billion) as per_billion from lex where regexp_full_match(word, '\\p{{L}}+') group by word) select cast(row_number() over (order by per_billion desc, word desc) as int) as rank, word, per_billion from b order by per_billion desc, word desc limit 8000")
def vocab_head(s, d):
    return lexicon.vocabulary(_t(s, d, "lexicon"))


@query("select distinct lower(nfc_normalize(word)) as word from word_counts where regexp_full_match(lower(nfc_normalize(word)), '[a-z]+') and (length(word) > 1 or lower(word) in ('a', 'i'))")
def english_words(s, d):
    w = _t(s, d, "word_counts").where("word is not null").select(lexicon.english_word(text.nfc("word")).alias("word"))
    return w.where("word is not null").distinct()


@query(f"with {sql.COUNTS}, {sql.LEX} select distinct word from counts except select word from lex")
def words_without_lexicon(s, d):
    """U3, J4."""
    return lexicon.word_counts(_t(s, d, "word_counts")).select("word").distinct().join(lexicon.parsed_lexicon(_t(s, d, "lexicon")), "word", "left_anti")


@query(f"with {sql.LINES}, {sql.LEX}, {sql.KNOWN}, w as (select doc_id, line, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as word from lines), g as (select doc_id, line, count(*) as words, count(known.word) as known from w left join known using (word) group by all) select * from g where words between 4 and 40 and known >= 0.9 * words")
def usable_sentences(s, d):
    return lexicon.usable(lexicon.sentence_stats(_lines(s, d), ["doc_id", "line"], "text", _known(s, d)))


_NOT_PLAIN = " and ".join(f"not regexp_matches(lower(text), '{p}')" for p in lexicon.sentence_patterns(r"\p{{{}}}"))


@query(f"""with {sql.LINES} select doc_id, line from lines where len(regexp_extract_all(text, '\\p{{L}}+')) between 4 and 45 and {_NOT_PLAIN}
and (length(text) - length(replace(text, '"', ''))) % 2 = 0 and length(text) - length(replace(text, '“', '')) = length(text) - length(replace(text, '”', ''))""")
def plain_sentences(s, d):
    return _lines(s, d).where(lexicon.plain_sentence(F.col("text"))).select("doc_id", "line")


def _lines(s, d):
    """(doc_id, line, text) of NFC documents."""
    x = _t(s, d, "documents").where("text is not null").select("doc_id", text.nfc("text").alias("t"))
    return x.select("doc_id", F.posexplode(F.split("t", r"[\n\r]+")).alias("line", "text")).where("trim(text) != ''")


@query(f"with k as (select doc_id, array_to_string(regexp_extract_all(lower(nfc_normalize(text)), '\\p{{L}}+'), ' ') as k from documents where text is not null) select min(doc_id) as doc_id, count(*) as copies from k group by k having count(*) > 0")
def exact_dedup(s, d):
    x = _t(s, d, "documents").where("text is not null").select("doc_id", text.nfc("text").alias("text")).withColumn("copies", F.lit(1))
    key = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), " ")
    kept = lexicon.first_of_equal(x, "text", "doc_id").select("doc_id", F.xxhash64(key).alias("_k"))
    n = x.groupBy(F.xxhash64(key).alias("_k")).agg(F.count("*").alias("copies"))
    return kept.join(n, "_k").select("doc_id", "copies")


# Sequences of words.


@query(f"with {sql.TOK}, {sql.LEX}, {sql.KNOWN}, {sql.BIGRAM} select prev, word, n, total, q from bi")
def bigram_prob(s, d):
    return ngrams.bigram_probabilities(_tok(s, d), _known(s, d)).select("prev", "word", "n", "total", "q")


@query(f"""with {sql.TOK}, {sql.LEX}, {sql.KNOWN},
g as (select w as a, lead(w) over o as b, lead(w, 2) over o as c from tok window o as (partition by doc_id order by pos)),
p as (select a, b, c, count(*) as n from g where a <> '' and b <> '' and c <> '' and a in (from known) and b in (from known) group by all),
t as (select a, b, cast(sum(n) as bigint) as total from p group by all)
select a as first, b as second, c as word, n, total, {sql.q('n / total')} as q from p join t using (a, b) where n >= 3 and c in (from known)""")
def trigram_prob(s, d):
    return ngrams.trigram_probabilities(_tok(s, d), _known(s, d)).select("first", "second", "word", "n", "total", "q")


def _kn(s, d):
    return ngrams.KneserNey(_tok(s, d), _known(s, d))


@query(f"with {sql.KN} select 'pair' as level, round(d, 9) as d, n1, n2 from dd2 union all select 'triple', round(d, 9), n1, n2 from dd3")
def kn_discounts(s, d):
    m = _kn(s, d)
    level = lambda df, name: df.select(F.lit(name).alias("level"), _r("d", 9).alias("d"), "n1", "n2")
    return level(m.d2, "pair").unionByName(level(m.d3, "triple"))


@query(f"with {sql.KN} select word, {sql.q('p1')} as p1, {sql.q('g2')} as g2 from uni")
def kn_unigrams(s, d):
    return _kn(s, d).unigrams.select("word", arrays.quantise(F.col("p1")).alias("p1"), arrays.quantise(F.col("g2")).alias("g2"))


@query(f"with {sql.KN} select b, w, n, {sql.q('p')} as q from pairs")
def kn_bigrams(s, d):
    return _kn(s, d).bigrams.select("b", "w", "n", arrays.quantise(F.col("p")).alias("q"))


@query(f"with {sql.KN} select a, b, w, n, {sql.q('p')} as q from triples")
def kn_trigrams(s, d):
    return _kn(s, d).trigrams.select("a", "b", "w", "n", arrays.quantise(F.col("p")).alias("q"))


@query(f"with {sql.KN} select a, b, {sql.q('g3')} as q from gammas")
def kn_gammas(s, d):
    return _kn(s, d).gammas.select("a", "b", arrays.quantise(F.col("g3")).alias("q"))


@query(f"""with {sql.KN},
it as (select item_id, list_prepend('', list_transform(regexp_extract_all(nfc_normalize(text), '\\p{{L}}+|[^\\p{{L}}\\s\\p{{Z}}]'), lambda x: case when regexp_matches(x, '^\\p{{L}}') then lower(x) else '' end)) as tk from eval_items where text is not null),
s3 as (select item_id, unnest(list_transform(range(1, len(tk) - 1), lambda i: {{'a': tk[i], 'b': tk[i + 1], 'w': tk[i + 2]}})) as g from it),
s4 as (select item_id, nullif(g.a, '') as a, g.b as b, g.w as w from s3 where g.b <> '' and g.w <> ''),
sc as (select s4.item_id, case when s4.a is null then coalesce(pairs.p, ub.g2 * uw.p1) else coalesce(triples.p, coalesce(gammas.g3, 0.85) * coalesce(pairs.p, ub.g2 * uw.p1)) end as p from s4
left join triples on triples.a = s4.a and triples.b = s4.b and triples.w = s4.w left join gammas on gammas.a = s4.a and gammas.b = s4.b
left join pairs on pairs.b = s4.b and pairs.w = s4.w left join uni ub on ub.word = s4.b left join uni uw on uw.word = s4.w)
select item_id, count(*) as words, count(p) as known, round(sum(coalesce(ln(p), -16.0)), 4) as ln_p from sc group by item_id""")
def kn_score(s, d):
    items = tokens.with_tokens(_t(s, d, "eval_items").select("item_id", "text"))
    return ngrams.text_scores(_kn(s, d), items, ["item_id"]).withColumn("ln_p", _r("ln_p", 4))


# Words alike.


@query(f"with {sql.LEX}, {sql.KNOWN}, b as (select distinct word, {sql.bare('word')} as letters from known) select letters, count(*) as n, min(word) as first, max(word) as last from b group by letters having count(*) > 1")
def bare_classes(s, d):
    return similar.same_letters(_known(s, d))


@query(f"""with {sql.LEX}, {sql.KNOWN},
k as (select word, unnest(list_distinct(list_prepend(word, list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))))) as k from known)
select distinct a.word as word, b.word as other from k a join k b using (k) where a.word <> b.word and {sql.bare('a.word')} <> {sql.bare('b.word')}""")
def deletion_neighbours(s, d):
    k = _known(s, d)
    return similar.one_letter_apart(k, k)


@query()
def slips_of_typed(s, d):
    """The lexicon words one slip of the keys away from each unknown typed word."""
    w = _languages(s, d)
    keys = _open_keys(s, d, w)
    return rank.near_candidates(keys, w).select("keys", "word", _r("score").alias("score"))


def _open_keys(s, d, w):
    c = _t(s, d, "cases").where("typed is not null").select(telex_keys("typed").alias("raw")).distinct()
    return cut(rank.typed_scores(c.select(rank.keys_of(F.col("raw")).alias("keys")).where("keys is not null"), w).where("typed is null"))


@query()
def far_words(s, d):
    """J11, F14, F15, R7."""
    w = _languages(s, d)
    return rank.far_candidates(_open_keys(s, d, w), w).select("keys", "word", _r("score").alias("score"))


@query()
def split_words(s, d):
    """R9, T11."""
    w = _languages(s, d)
    return rank.split_runs(_open_keys(s, d, w), w, _pairs(s, d))


@query(sql.KEYBOARD)
def keyboard_adjacency(s, d):
    return similar.touching_keys(s.createDataFrame(similar.KEYBOARD, "name string, y0 double, y1 double, x0 double, x1 double"))


@query(f"""with {sql.CASES} select case_id,
case when contains(typed, ' ') or contains(gold, ' ') then 'space' when {sql.bare('typed')} = {sql.bare('gold')} then 'marks or tone only' when abs(length(typed) - length(gold)) <= 1 then 'one letter' else 'other' end as kind,
{sql.bag('typed', 'gold')} as bag from c""")
def case_distances(s, d):
    c = _cases(s, d)
    return c.select("case_id", edits.mistake_kind(F.col("typed"), F.col("gold")).alias("kind"), text.bag_distance(F.col("typed"), F.col("gold")).cast("long").alias("bag"))


@query()
def case_levenshtein(s, d):
    """F16; SQL engines may count bytes."""
    return _cases(s, d).select("case_id", F.levenshtein("typed", "gold").alias("distance"))


def _cases(s, d):
    """The latest delivery of each case with a typed word and one gold, lower-case NFC."""
    c = _t(s, d, "cases").where("case_id is not null").groupBy("case_id").agg(F.max_by(F.struct("source", "typed", "gold", "is_error", "history"), "loaded_at").alias("c")).select("case_id", "c.*")
    source = F.regexp_replace(F.lower(F.trim("source")), "-", "_")
    gold = F.split("gold", r"\|")[0]
    return c.where("typed is not null and gold is not null").select("case_id", source.alias("source"), F.lower(text.nfc("typed")).alias("typed"), F.lower(text.nfc(gold)).alias("gold"), F.col("gold").alias("golds"), "is_error", "history")


# Mistakes.


@query(f"with {sql.FIXES} select vsec_id, pos, wrong, \"right\" from fixes")
def vsec_fixes(s, d):
    return mining.fixes(mining.syllables(_t(s, d, "vsec")))


def _mined(s, d):
    return mining.mined(mining.fixes(mining.syllables(_t(s, d, "vsec"))), _known(s, d))


@query()
def mined_operations(s, d):
    """A22, F18."""
    return mining.operations(_mined(s, d))


@query()
def confusions(s, d):
    return mining.confusion_maps(_mined(s, d)).select("right", F.map_entries("confusions").alias("confusions"))


@query()
def negative_candidates(s, d):
    """Wrong forms for each right syllable of the annotated sentences."""
    m = _mined(s, d).select(F.col("right").alias("gold"), "wrong", "kind", F.col("n").cast("double").alias("weight"))
    gold = m.select("gold").distinct()
    k = _known(s, d).select(F.col("word").alias("wrong"), text.bare(F.col("word")).alias("_b"))
    siblings = gold.withColumn("_b", text.bare(F.col("gold"))).join(k, "_b").select("gold", "wrong", edits.slip_kind("wrong", "gold").alias("kind"), F.lit(1.0).alias("weight"))
    made = gold.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("m", corrupted("gold", F.concat_ws("/", F.lit("neg"), "gold", "i"))).where("m is not null").select("gold", F.col("m.wrong").alias("wrong"), F.col("m.kind").alias("kind"), F.lit(1.0).alias("weight"))
    return mining.negatives(gold, m, siblings, made)


@query()
def corrupted_sentences(s, d):
    """Annotated sentences with fresh mistakes on a tenth of their known words."""
    v = _t(s, d, "vsec").where("vsec_id is not null and text is not null").dropDuplicates(["vsec_id"]).select("vsec_id", tokens.raw_tokens(text.nfc("text")).alias("t"))
    return mining.corrupted_tokens(v, "vsec_id", "t", _known(s, d), 0.1)


@query()
def rule_checks(s, d):
    """Of each rule's mistakes on the known words, how many its checker accepts."""
    w = _known(s, d).select(F.explode(by_rules("word", "word")).alias("x"))
    return w.groupBy(F.col("x.rule").alias("rule")).agg(F.count("*").alias("proposed"), F.count_if("x.ok").alias("kept"))


@query()
def simulated_slips(s, d):
    """the keys of each known word with a slip of the hand."""
    w = _known(s, d).select("word", telex_keys("word").alias("keys")).withColumn("typed", typed_with_slip("keys", "word")).where("typed is not null")
    return w.withColumn("two", edits.two_slips(F.col("keys"), F.col("typed")))


# Ranking.


@query(f"""with {sql.CASES}, {sql.LEX}, {sql.LANGUAGES}, h as (select case_id, list_reverse(list_filter(string_split_regex(trim(history), '[\\s\\p{{Z}}]+'), lambda x: x <> ''))[1:4] as h from c where history is not null),
e as (select case_id, unnest(h) as word, unnest(range(0, len(h))) as k from h)
select case_id, round(least(greatest(sum(case when vi is not null and en is null then 1.0 when en is not null and vi is null then -1.0 else 0.0 end * power(0.7, k)), -1.0), 1.0), 6) as vote from e left join lang on lang.word = lower(e.word) group by case_id""")
def decayed_vote(s, d):
    h = F.filter(F.split(F.trim("history"), r"[\s\p{Z}]+"), lambda x: x != "")
    c = _cases(s, d).where("history is not null").select("case_id", h.alias("history"))
    return rank.history_votes(c, "case_id", "history", _languages(s, d)).withColumn("vote", _r("vote"))


@query()
def typed_readings(s, d):
    """R4, R5, R8."""
    w = _languages(s, d)
    k = _t(s, d, "cases").where("typed is not null").select(rank.keys_of(telex_keys("typed")).alias("keys")).where("keys is not null")
    t = rank.typed_scores(k, w)
    return t.join(rank.restored(t, w), "keys", "left").select("keys", "shown", "kind", _r("typed").alias("typed"), "restored")


def _decisions(s, d):
    h = F.coalesce(F.filter(F.split(F.trim("history"), r"\s+"), lambda x: x != ""), F.array().cast("array<string>"))
    c = _cases(s, d).select("case_id", telex_keys("typed").alias("raw"), h.alias("history"))
    return rank.decide(c, _languages(s, d), bigrams=_pairs(s, d))


def _pairs(s, d):
    """(prev, word, p): how likely a word is behind another, from the documents; cut, as several plans read it."""
    return cut(ngrams.bigram_probabilities(_tok(s, d), _known(s, d)).select("prev", "word", (F.col("n") / F.col("total")).alias("p")))


_LANG_LN = "ln as (select word, vi from lang where vi is not null)"


@query(f"""with {sql.TOK}, {sql.LEX}, {sql.KNOWN}, {sql.LANGUAGES}, {sql.BIGRAM}, {_LANG_LN},
pr as (select distinct w as word, lead(w) over (partition by doc_id order by pos) as next from tok),
p as (select pr.word, pr.next, a.vi as a, b.vi as b, bi.n / bi.total as p from pr left join ln a on a.word = pr.word left join ln b on b.word = pr.next left join bi on bi.prev = pr.word and bi.word = pr.next where pr.word <> '' and pr.next <> '')
select word, next, round(case when a is null or b is null then 0.0 when p is null then ln(0.5) else ln(0.5 * p + 0.5 * exp(b - ln(1e9))) - (b - ln(1e9)) end, 6) as bonus from p""")
def right_bonus(s, d):
    """R14 for every two words that follow one another in the documents."""
    pairs = ngrams.counts(_tok(s, d), 2, names=("word", "next")).select("word", "next")
    vi = _languages(s, d).where("vi is not null")
    j = pairs.join(small(vi.select("word", F.col("vi").alias("a"))), "word", "left").join(small(vi.select(F.col("word").alias("next"), F.col("vi").alias("b"))), "next", "left")
    j = j.join(small(_pairs(s, d).select(F.col("prev").alias("word"), F.col("word").alias("next"), "p")), ["word", "next"], "left")
    return j.select("word", "next", _r(rank.right_bonus(F.col("a"), F.col("b"), F.col("p"))).alias("bonus"))


@query()
def decisions(s, d):
    """R10 over all cases."""
    return _decisions(s, d)


@query()
def decision_score(s, d):
    """A28 of R10, by source."""
    rows = _cases(s, d).join(_decisions(s, d), "case_id").withColumn("output", F.coalesce("fix", F.lit("")))
    return evaluate.system_score(rows, ["source"], golds="golds")


@query(f"""with {sql.SAMPLES}, e as (select id, unnest(candidates) as x from s), r as (select id, x.t as t, x.s as s, row_number() over (partition by id order by x.s desc, x.t) as k from e where x.s is not null)
select id, max(t) filter (k = 1) as best, max(s) filter (k = 1) as best_score, round(max(s) filter (k = 1) - max(s) filter (k = 2), 6) as margin from r group by id""")
def rank_margin(s, d):
    e = _samples(s, d).select("id", F.explode("candidates").alias("x")).select("id", F.col("x.t").alias("word"), F.col("x.s").alias("score")).where("score is not null")
    return rank.top_two(e, ["id"]).select("id", "best", "best_score", _r(F.col("best_score") - F.col("second_score")).alias("margin"))


def _samples(s, d):
    return _t(s, d, "export_samples").where("id is not null").groupBy("id").agg(F.max_by(F.struct("set", "class", "typed", "shown", "truth", "real", "truth_in", "candidates"), "exported_at").alias("c")).select("id", "c.*")


def _teachers(s, d, model: str | None = None):
    t = _t(s, d, "teacher_scores").where("id is not null and model is not null").groupBy("id", "model").agg(F.max_by(F.struct("ll_left", "ll_full"), "scored_at").alias("c")).select("id", "model", "c.*")
    return t.where(F.col("model") == model).drop("model") if model else t


@query(f"with {sql.SAMPLES}, e as (select id, unnest(candidates) as x from s), r as (select id, x.t as t, x.s as s, row_number() over (partition by id order by x.s desc, x.t) as place from e where x.s is not null) select id, cast(place as int) as place, t, s from r where place <= 3")
def topk_candidates(s, d):
    e = _samples(s, d).select("id", F.explode("candidates").alias("x")).select("id", "x.t", "x.s").where("s is not null")
    return sampling.top_k(e, ["id"], [F.desc("s"), F.col("t")], 3)


@query(f"with {sql.SAMPLES}, e as (select id, unnest(candidates) as x from s) select lower(x.t) as word, max(x.s) as best, count(*) as n, round(max(x.s) + ln(sum(exp(x.s - m.m))), 4) as merged from e join (select lower(x.t) as w, max(x.s) as m from e group by 1) m on m.w = lower(x.t) where x.s is not null group by 1")
def merged_readings(s, d):
    """All readings of one word: the best, and their probabilities added."""
    e = _samples(s, d).select(F.explode("candidates").alias("x")).select(F.lower("x.t").alias("word"), F.col("x.s").alias("s")).where("s is not null")
    top = e.groupBy("word").agg(F.max("s").alias("best"), F.count("*").alias("n"), rank.log_add("s").alias("m"))
    return top.select("word", "best", "n", _r("m", 4).alias("merged"))


@query(f"with {sql.SAMPLES}, v as (select id, list_transform(candidates, lambda x: coalesce(x.s, -1e9)) as v from s where len(candidates) > 0) select id, cast(list_position(v, list_max(v)) - 1 as int) as top, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) as p from v")
def softmax_top(s, d):
    v = _samples(s, d).where(F.size("candidates") > 0).select("id", F.transform("candidates", lambda x: F.coalesce(x["s"], F.lit(-1e9))).alias("v"))
    return v.withColumn("t", arrays.softmax_top(F.col("v"))).select("id", F.col("t.at").alias("top"), _r("t.p").alias("p"))


@query(f"with {sql.SAMPLES} select s.id from s where not exists (from teacher_scores t where t.id = s.id)")
def unscored_samples(s, d):
    """J4."""
    return _samples(s, d).select("id").join(_t(s, d, "teacher_scores"), "id", "left_anti")


# Measures.


def _chosen(s, d, expanded: bool = False, model: str | None = None):
    m = evaluate.sample_methods(_samples(s, d), _teachers(s, d, model) if model else None, expanded)
    return evaluate.choices(m, ["id", "set", "class"])


@query(f"with {sql.CHOSEN} select set_name, class_name, method, count(gold) as n, round(count(gold) / count(*), 6) as coverage, round(avg(case when gold is not null then cast(top = gold as int) end), 6) as accuracy from chosen group by all")
def choice_accuracy(s, d):
    a = evaluate.accuracy(_chosen(s, d).select(F.col("set").alias("set_name"), F.col("class").alias("class_name"), "gold", "top", "method"), ["set_name", "class_name"])
    return a.select("set_name", "class_name", "method", "n", _r("coverage").alias("coverage"), _r("accuracy").alias("accuracy"))


@query(f"with {sql.CHOSEN}, {sql.thresholds('0.5, 0.9, 0.99, 0.999, 0.9999, 0.99999')} select method, tau as threshold, count(*) filter (f and p >= tau) as fixes, count(*) filter (f and p >= tau and r) as \"right\", count(*) filter (f and p >= tau and not r) as wrong, round(1000 * (count(*) filter (f and p >= tau and not r and c) / greatest(count(*) filter (c), 1)), 6) as clean_per_1000 from (select *, coalesce(top <> keep_at, true) as f, coalesce(top = gold, false) as r, coalesce(class_name = 'clean', false) as c from chosen), taus group by method, tau")
def safe_sweep(s, d):
    w = evaluate.safe_sweep(_chosen(s, d), F.col("class") == "clean")
    return w.withColumn("clean_per_1000", _r("clean_per_1000"))


_OWN = "list_transform(range(1, len(candidates) + 1), lambda i: case when {x}[i] is null or isnan({x}[i]) then -1e9 else {x}[i] end)"


@query(f"""with {sql.SAMPLES}, {sql.TEACHERS}, {sql.thresholds('0.5, 0.9, 0.99, 0.999, 0.9999, 0.99999')},
ways as (select model, class, list_position(list_transform(candidates, lambda x: lower(x.t) = lower(truth)), true) - 1 as gold, list_position(list_transform(candidates, lambda x: coalesce(x.keep, false)), true) - 1 as keep_at,
unnest(['ngram', 'ngram_right', 'teacher_left', 'teacher_full']) as method, unnest([list_transform(candidates, lambda x: coalesce(x.s, -1e9)), list_transform(candidates, lambda x: coalesce(x.s, -1e9) + coalesce(x.r, 0.0)), {_OWN.format(x="ll_left")}, {_OWN.format(x="ll_full")}]) as v from s join tea using (id) where len(candidates) > 0),
o as (select model, method, coalesce(class = 'clean', false) as c, list_position(v, list_max(v)) - 1 as top, case when gold >= 0 then gold end as gold, case when keep_at >= 0 then keep_at end as keep_at, 1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) as p from ways),
k as (select *, coalesce(top <> keep_at, true) as f, coalesce(top = gold, false) as r from o)
select model, method, tau as threshold, count(*) filter (f and p >= tau) as fixes, count(*) filter (f and p >= tau and r) as "right", count(*) filter (f and p >= tau and not r) as wrong, round(1000 * (count(*) filter (f and p >= tau and not r and c) / greatest(count(*) filter (c), 1)), 6) as clean_per_1000 from k, taus group by model, method, tau""")
def teacher_sweep(s, d):
    """A25-A27 with the choices of both teachers and the letter-changing candidates."""
    swept = [evaluate.safe_sweep(_chosen(s, d, True, m), F.col("class") == "clean").withColumn("model", F.lit(m)) for m in ("teacher-base", "teacher-large")]
    return swept[0].unionByName(swept[1]).withColumn("clean_per_1000", _r("clean_per_1000"))


_CURVE = f"with {sql.CHOSEN}, {sql.thresholds('0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99')}, r as (select p, top as pred, gold, coalesce(class_name <> 'clean', false) as e from chosen where method = 'ngram_right'), m as (select tau as threshold, count(*) filter (p >= tau) as changed, count(*) filter (p >= tau and e) as detected, count(*) filter (p >= tau and e and coalesce(pred = gold, false)) as r, count(*) filter (e) as mistakes, count(*) filter (not e) as clean from r, taus group by tau)"


@query(_CURVE + ' select threshold, changed, round(detected / greatest(changed, 1), 6) as detect_precision, round(detected / greatest(mistakes, 1), 6) as detect_recall, round(r / greatest(changed, 1), 6) as right_precision, round(r / greatest(mistakes, 1), 6) as right_recall, round(1000 * ((changed - detected) / greatest(clean, 1)), 6) as false_per_1000, round(coalesce(2 * (r / nullif(changed, 0)) * (r / nullif(mistakes, 0)) / nullif(r / nullif(changed, 0) + r / nullif(mistakes, 0), 0), 0), 6) as right_f1 from m')
def pr_curve(s, d):
    c = evaluate.f1(evaluate.curve(_curve_rows(s, d)))
    return c.select("threshold", "changed", *[_r(x).alias(x) for x in c.columns if x not in ("threshold", "changed")])


def _curve_rows(s, d):
    rows = _chosen(s, d).where("method = 'ngram_right'")
    return rows.select("p", F.col("top").alias("pred"), "gold", F.coalesce(F.col("class") != "clean", F.lit(False)).alias("is_error"), "set")


@query(_CURVE + ", pts as (select threshold, r, 1000 * ((changed - detected) / greatest(clean, 1)) as f from m), b as (select unnest(['tight', 'usual', 'loose']) as setting, unnest([900.0::double, 950.0::double, 1000.0::double]) as target) select setting, target, arg_max(threshold, r - threshold / 1e6) as threshold, max(r) as \"right\" from b join pts on f <= target + 1e-9 group by setting, target")
def budget_match(s, d):
    c = evaluate.at_thresholds(_curve_rows(s, d), F.col("p"), evaluate.CURVE, {"changed": F.lit(1), "right": F.col("is_error") & F.coalesce(F.col("pred") == F.col("gold"), F.lit(False)), "detected": F.col("is_error")})
    clean = _curve_rows(s, d).agg(F.count_if(~F.col("is_error")).alias("n")).select("n").scalar()
    points = c.select("threshold", "right", (1000 * arrays.ratio(F.col("changed") - F.col("detected"), clean)).alias("false_per_1000"))
    base = s.createDataFrame([("tight", 900.0), ("usual", 950.0), ("loose", 1000.0)], "setting string, target double")
    return evaluate.budget_matched(base, points).where("threshold is not null")


@query(f"with {sql.SAMPLES} select \"set\" as set_name, class as class_name, count(*) as n, round(avg(cast(truth_in as int)), 6) as coverage, count(*) filter (\"real\") as real_words from s group by all")
def export_coverage(s, d):
    x = _samples(s, d)
    return x.groupBy(F.col("set").alias("set_name"), F.col("class").alias("class_name")).agg(F.count("*").alias("n"), _r(F.avg(F.col("truth_in").cast("int"))).alias("coverage"), F.count_if("real").alias("real_words"))


@query(f"with {sql.SAMPLES}, p as (select coalesce(\"real\", false) as is_word, list_position(list_transform(candidates, lambda x: lower(x.t)), lower(truth)) as k from s) select is_word, count(*) filter (coalesce(k, 0) = 0) as absent, count(*) filter (k = 1) as first, count(*) filter (k > 1) as lower from p group by is_word")
def diagnose(s, d):
    """A16."""
    k = F.array_position(F.transform("candidates", lambda x: F.lower(x["t"])), F.lower("truth"))
    p = _samples(s, d).select(F.coalesce("real", F.lit(False)).alias("is_word"), F.coalesce(k, F.lit(0)).alias("k"))
    return p.groupBy("is_word").agg(F.count_if(F.col("k") == 0).alias("absent"), F.count_if(F.col("k") == 1).alias("first"), F.count_if(F.col("k") > 1).alias("lower"))


_DICT = f"with {sql.CASES}, k as (select typed, gold, count(*) as n from c where source like '%train' group by all), d as (select typed, gold as fix from (select *, row_number() over (partition by typed order by n desc, gold) as r from k) where r = 1), o as (select c.*, coalesce(d.fix, '') as output from c left join d using (typed) where source not like '%train')"


def _dictionary(s, d):
    """Every typed word of the training split to its most frequent gold; dev cases with its output."""
    c = _cases(s, d)
    k = c.where("source like '%train'").groupBy("typed", "gold").agg(F.count("*").alias("n"))
    best = k.groupBy("typed").agg(F.min_by("gold", F.struct((-F.col("n")).alias("n"), "gold")).alias("fix"))
    return c.where("source not like '%train'").join(best, "typed", "left").withColumn("output", F.coalesce("fix", F.lit("")))


@query(_DICT + " select source, count(*) filter (output <> '' and output <> typed) as changed, count(*) filter (output <> '' and output <> typed and is_error = 1) as detected, count(*) filter (output <> '' and output <> typed and is_error = 1 and list_contains(string_split(golds, '|'), output)) as \"right\", count(*) filter (output <> '' and output <> typed and is_error <> 1) as \"false\", count(*) filter (is_error = 1) as mistakes, count(*) filter (is_error <> 1) as clean from o where is_error is not null group by source")
def dictionary_score(s, d):
    return evaluate.system_score(_dictionary(s, d), ["source"], golds="golds")


@query(_DICT + f", t as (select case when {sql.bare('typed')} = {sql.bare('gold')} then 'marks' when abs(length(typed) - length(gold)) <= 1 then 'one letter' else 'other' end as cls, output, gold, typed from o) select cls, count(*) as n, count(*) filter (output <> '' and output <> typed and output = gold) as \"right\", count(*) filter (output <> '' and output <> typed and output <> gold) as wrong, count(*) filter (not (output <> '' and output <> typed)) as missed, 0 as missed_real from t group by cls")
def class_tally(s, d):
    kind = edits.mistake_kind(F.col("typed"), F.col("gold"))
    rows = _dictionary(s, d).withColumn("cls", F.when(kind == "marks or tone only", "marks").when(F.abs(F.char_length("typed") - F.char_length("gold")) <= 1, "one letter").otherwise("other"))
    return evaluate.class_tally(rows, "cls", "output", "gold", "typed", F.lit(False))


@query(_DICT + ", g as (select source as grp, case when is_error = 1 then 'goal' else 'must' end as level, case when is_error = 1 then output = gold else output in ('', typed) end as ok from o) select coalesce(grp, 'TOTAL') as grp, count(*) filter (level <> 'goal' and ok) as must_passed, count(*) filter (level <> 'goal') as must, count(*) filter (level = 'goal' and ok) as goal_passed, count(*) filter (level = 'goal') as goal from g group by rollup (grp)")
def golden_rollup(s, d):
    o = _dictionary(s, d)
    error = F.coalesce(F.col("is_error") == 1, F.lit(False))
    rows = o.select(F.col("source").alias("grp"), F.when(error, "goal").otherwise("must").alias("level"), F.when(error, F.col("output") == F.col("gold")).otherwise(F.col("output").isin("") | (F.col("output") == F.col("typed"))).alias("ok"))
    return evaluate.golden_report(rows)


@query("with o as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as k, count(*) over (partition by event_type) as n from events where value is not null) select event_type, n, max(value) filter (k = floor((n - 1) * 0.5)) as p50, max(value) filter (k = floor((n - 1) * 0.95)) as p95, max(value) filter (k = floor((n - 1) * 0.99)) as p99 from o group by event_type, n")
def latency_pick(s, d):
    return evaluate.pick(_t(s, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(f"with {sql.TEACHERS}, b as (select id, {sql.top('ll_left')} as t, list_max(ll_left) as m from tea where model = 'teacher-base' and {sql.clean('ll_left')}), l as (select id, {sql.top('ll_left')} as t, list_max(ll_left) as m from tea where model = 'teacher-large' and {sql.clean('ll_left')}) select count(*) as n, round(avg(cast(b.t = l.t as int)), 6) as agree, round(avg(abs(b.m - l.m)), 6) as gap from b join l using (id)")
def teacher_agreement(s, d):
    ok = F.col("ll_left").isNotNull() & (F.size("ll_left") > 0) & ~F.exists("ll_left", lambda x: x.isNull() | F.isnan(x))
    t = lambda m: _teachers(s, d, m).where(ok).select("id", (F.array_position("ll_left", F.array_max("ll_left"))).alias(f"t{m[-4:]}"), F.array_max("ll_left").alias(f"m{m[-4:]}"))
    j = t("teacher-base").join(t("teacher-large"), "id")
    a = evaluate.agreement(F.col("tbase"), F.col("targe"), F.col("mbase"), F.col("marge"))
    return j.agg(F.count("*").alias("n"), *a).select("n", _r("agree").alias("agree"), _r("gap").alias("gap"))


# Slices and samples.


@query(f"with {sql.TAIL} select source, line_no from tail where tail > 50")
def training_rows(s, d):
    return sampling.training_slice(_numbered(s, d), held_out=50)


def _numbered(s, d):
    return _t(s, d, "word_counts").where("source is not null and line_no is not null").select("source", "line_no").distinct()


@query(f"with {sql.TAIL}, h as (select *, count(*) over (partition by source) as n from tail where tail <= 50), k as (select *, n - tail as place, greatest(1, floor(n / 20)) as stride from h) select source, line_no from k where place % stride = 0 and place / stride < 20")
def held_out_stride(s, d):
    return sampling.held_out_slice(_numbered(s, d), held_out=50, limit=20)


@query("select doc_id, source from documents where doc_id % 4 = 1")
def third_shard(s, d):
    """One of four shards, the feature itself."""
    return sampling.shard(_t(s, d, "documents").select("doc_id", "source"), F.col("doc_id"), 1, 4)


@query("with m as (select doc_id, md5(text) as m from documents where text is not null) select doc_id, cast((list_sum(list_transform(range(1, 32), lambda i: strpos('0123456789abcdef', substr(m, i, 1)) - 1)) * 6 + strpos('0123456789abcdef', substr(m, 32, 1)) - 1) % 10 as int) as tenth from m")
def md5_split(s, d):
    return _t(s, d, "documents").where("text is not null").select("doc_id", sampling.tenth(F.col("text")).alias("tenth"))


@query("with r as (select doc_id, source, lang, row_number() over (partition by lang, source order by md5('7' || doc_id), doc_id) as k from documents) select doc_id, source, lang from r where k <= 10")
def stratified_cap(s, d):
    return sampling.capped(_t(s, d, "documents").select("doc_id", "source", "lang"), ["lang", "source"], "doc_id", 10)


@query("select doc_id from documents where text is not null order by md5('7' || doc_id), doc_id limit 500")
def shuffled_take(s, d):
    return sampling.take_by_hash(_t(s, d, "documents").where("text is not null").select("doc_id"), "doc_id", 500)


@query("select distinct case_id from cases where is_error = 1 or cast('0x' || substr(md5('7' || case_id), 1, 8) as bigint) / 4294967296.0 < 0.1")
def errors_and_tenth(s, d):
    c = _t(s, d, "cases").select("case_id", F.coalesce(F.col("is_error") == 1, F.lit(False)).alias("e")).where("case_id is not null")
    return sampling.errors_and_some(c, F.col("e"), "case_id", 0.1).select("case_id").distinct()


@query(f"with {sql.CASES} select case_id, row_number() over (partition by source order by case_id) as running_id, cast(sum(coalesce(is_error, 0)) over (partition by source order by case_id) as bigint) as errors from c")
def running_ids(s, d):
    c = _cases(s, d).select("case_id", "source", F.coalesce("is_error", F.lit(0)).alias("e"))
    return sampling.running_ids(c, "source", "case_id", F.col("e")).select("case_id", "running_id", "errors")


@query()
def samples_as_json(s, d):
    """S12, F31, D14."""
    return readers.as_json(_samples(s, d).select("id", "set", "class", "typed", "shown", "truth", "candidates"))


# Journals. An event's props.k is the keys, its value to one decimal the fix; a click is a fix, an error an undo.


def _journal(s, d):
    e = _t(s, d, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(F.col("user_id").alias("user"), "event_id", "ts", F.when(F.col("event_type") == "click", "FIX").when(F.col("event_type") == "error", "UNDO").otherwise(F.upper("event_type")).alias("kind"), k.alias("keys"), F.concat(F.lit("w"), F.floor(F.col("value") / 50).cast("string")).alias("fix"))


@query(f"with {sql.JOURNAL}, p as (select keys, fix, count(*) filter (kind = 'FIX') as fixed, count(*) filter (kind = 'UNDO') as undone from j group by all), a as (select 'undone' as list, * from p where undone > 0 order by undone desc, fixed desc, keys, fix limit 20), b as (select 'kept' as list, * from p where undone = 0 order by fixed desc, keys, fix limit 20), u as (from a union all from b) select list, cast(row_number() over (partition by list order by undone desc, fixed desc, keys, fix) as int) as place, keys, fix, fixed, undone from u")
def journal_report(s, d):
    return journal.report(_journal(s, d))


@query(f"with {sql.JOURNAL}, c as (select distinct keys, fix from j where kind in ('FIX', 'UNDO')), u as (select distinct keys, fix from j where kind = 'UNDO') select case when u.keys is null then 'journal-kept' else 'journal-undone' end as grp, 'en' as mode, '' as context, c.keys as typed, case when u.keys is null then c.fix else '=' end as expected, case when u.keys is null then 'must' else 'goal' end as level, 'Normal' as app, '' as \"right\" from c left join u on u.keys = c.keys and u.fix = c.fix")
def journal_cases(s, d):
    j = _journal(s, d)
    for c in ("left", "context", "mode", "app", "right"):
        j = j.withColumn(c, F.lit(None).cast("string"))
    return journal.cases(j)


@query(f"with {sql.JOURNAL} select user, keys, count(*) as undos from j where kind = 'UNDO' group by user, keys having count(*) >= 2")
def undo_learned(s, d):
    return journal.learned(_journal(s, d))


@query(f"with {sql.JOURNAL} select count(*) filter (kind = 'FIX') as fixes, count(*) filter (kind = 'UNDO') as undos, round(100 * (count(*) filter (kind = 'UNDO')) / greatest(count(*) filter (kind = 'FIX'), 1), 6) as percent from j")
def undo_share(s, d):
    return journal.undo_share(_journal(s, d)).withColumn("percent", _r("percent"))


@query(f"""with {sql.JOURNAL}, o as (select *, coalesce(sum(cast(kind = 'SIGNUP' as int)) over (partition by user order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as s from j),
n as (select event_id, s, ts, lead(keys, 1) over w as w1, lead(s, 1) over w as s1, lead(ts, 1) over w as t1, lead(keys, 2) over w as w2, lead(s, 2) over w as s2, lead(ts, 2) over w as t2, lead(keys, 3) over w as w3, lead(s, 3) over w as s3, lead(ts, 3) over w as t3 from o window w as (partition by user order by ts, event_id))
select event_id, concat_ws(' ', case when s1 = s and epoch(t1) - epoch(ts) < 36000 then w1 end, case when s2 = s and epoch(t2) - epoch(ts) < 36000 then w2 end, case when s3 = s and epoch(t3) - epoch(ts) < 36000 then w3 end) as "right" from n""")
def right_context(s, d):
    """ST8 with a limit of ten hours, as events are hours apart; a signup ends a sentence."""
    j = journal.following(_journal(s, d), "user", ["ts", "event_id"], "ts", "keys", F.col("kind") == "SIGNUP", 3, 36000)
    return j.select("event_id", F.array_join("right", " ").alias("right"))


@query(f"with {sql.JOURNAL} select event_id, case when not (lead(kind) over w = 'SIGNUP') then lead(keys) over w end as next from j window w as (partition by user order by ts, event_id)")
def pending_next(s, d):
    return journal.pending(_journal(s, d), "user", ["ts", "event_id"], "keys", F.col("kind") == "SIGNUP").select("event_id", "next")


@query(f"with {sql.JOURNAL} select event_id, cast(sum(cast(kind = 'PURCHASE' as int)) over (partition by user order by ts, event_id) as bigint) as session from j")
def typing_sessions(s, d):
    return journal.sessions(_journal(s, d), "user", ["ts", "event_id"], F.col("kind") == "PURCHASE").select("event_id", "session")


@query(f"with {sql.JOURNAL}, a as (select *, sum(case kind when 'FIX' then 2 when 'UNDO' then -3 else 1 end) over w as t from j window w as (partition by user order by ts, event_id)), b as (select *, least(min(t) over (partition by user order by ts, event_id), 0) as low from a) select event_id, cast(t - low as bigint) as committed, low < coalesce(lag(low) over (partition by user order by ts, event_id), 0) as untracked from b")
def committed_text(s, d):
    step = F.when(F.col("kind") == "FIX", 2).when(F.col("kind") == "UNDO", -3).otherwise(1)
    return journal.untracked(_journal(s, d), "user", ["ts", "event_id"], step).select("event_id", "committed", "untracked")


@query("select time_bucket(interval '1 hour', ts) as start, event_type as kind, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(s, d):
    return windows.counts_by_window(_t(s, d, "events"), "ts", "event_type", "value").withColumn("total", _r("total", 4))


@query()
def replayed_typing(s, d):
    """ST1-ST9: the history and the typed word of every case key by key, each case a typist, corrected by the
    words of the training split; a fix of the typed word that is not its gold is taken back at once.
    The table of fixes grows with the cases, so it is joined to the words by their keys."""
    return _replayed(_cases(s, d))


def _replayed(c):
    """The replay of cases. Late fixes need words after the mistake; the cases have none, so their table is empty."""
    from pyspark.sql import Window as W

    blank = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
    c = c.withColumns({x: F.regexp_replace(x, blank, "") for x in ("typed", "gold")})
    best = c.where("source like '%train'").groupBy("typed", "gold").agg(F.count("*").alias("n")).groupBy(telex_keys("typed").alias("keys"), "gold").agg(F.sum("n").alias("n"))
    best = best.groupBy("keys").agg(F.min_by("gold", F.struct((-F.col("n")).alias("n"), "gold")).alias("fix"))
    line = F.concat(F.concat_ws(" ", F.lower(text.nfc(F.coalesce("history", F.lit("")))), "typed"), F.lit(" "))
    units = F.regexp_extract_all(line, F.lit(r"[^\s\p{Z}\p{P}]*(?:[\s\p{Z}]+|\p{P})"), F.lit(0))
    w = c.select(F.concat(F.lit("c"), "case_id").alias("user"), "typed", "gold", F.size(units).alias("of"), F.posexplode(units).alias("at", "unit"))
    w = w.withColumn("word", F.regexp_replace("unit", r"[\s\p{Z}\p{P}]+$", "")).withColumn("mark", F.regexp_replace(F.expr("substring(unit, char_length(word) + 1)"), r"[\s\p{Z}]+", " "))
    w = w.where("word != '' or mark != ' '").withColumn("keys", telex_keys("word")).join(best, "keys", "left")
    undone = (F.col("at") == F.col("of") - 1) & (F.col("word") == F.col("typed")) & (F.col("fix") != F.col("gold")) & (F.col("fix") != telex("keys")["text"])
    w = spread(w.withColumn("undone", F.coalesce(undone, F.lit(False))), "user")
    keys = F.filter(F.split("keys", ""), lambda x: x != "")
    key = lambda kind, ch, fix: F.struct(kind.alias("kind"), ch.alias("ch"), fix.alias("fix"))
    none = F.lit(None).cast("string")
    presses = F.concat(
        F.transform(keys, lambda x: key(F.lit("char"), x, none)),
        F.array(key(F.when(F.col("mark") == " ", "space").otherwise("punct"), F.col("mark"), F.col("fix"))),
        F.when(F.col("undone"), F.array(key(F.lit("undo"), F.lit(""), none))).otherwise(F.array().cast("array<struct<kind:string,ch:string,fix:string>>")),
    )
    w = w.select("user", "at", presses.alias("presses"))
    before = W.partitionBy("user").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    e = w.withColumn("before", F.coalesce(F.sum(F.size("presses")).over(before), F.lit(0))).sortWithinPartitions("user", "at")
    e = e.select("user", "before", F.posexplode("presses").alias("k", "press")).selectExpr("user", "before + k as seq", "cast(before + k as double) as ts", "press.*")
    return engine.replay(e, ordered=True)


# Arithmetic.


@query(f"with {sql.LEX}, {sql.KNOWN}, b as (select word, '<' || word || '>' as b from known), g as (select word, list_concat(list_concat(list_transform(range(1, length(b) + 1), lambda i: substr(b, i, 1)), list_transform(range(1, length(b)), lambda i: substr(b, i, 2))), list_concat(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3)), [b]))[1:40] as g from b) select word, len(g) as n, array_to_string(g, '|') as grams from g")
def char_grams(s, d):
    g = _known(s, d).withColumn("g", arrays.char_grams(F.col("word")))
    return g.select("word", F.size("g").cast("long").alias("n"), F.array_join("g", "|").alias("grams"))


@query()
def gram_buckets(s, d):
    return _known(s, d).select("word", arrays.buckets(arrays.char_grams(F.col("word"))).alias("buckets"))


@query("with v as (select vec_id, label, cast(embedding as double[]) as v from embeddings), m as (select vec_id, label, v, list_sum(v) / len(v) as m from v), s as (select *, list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / len(v) as var from m) select vec_id, round(m, 6) as mean, round(list_sum(list_transform(v, lambda x: x * x)), 5) as dot, round((v[1] - m) / sqrt(var + 1e-5), 4) as first_normed from s")
def embed_norms(s, d):
    e = _t(s, d, "embeddings")
    v = F.col("embedding")
    return e.select("vec_id", _r(arrays.mean(v)).alias("mean"), _r(arrays.dot(v, v), 5).alias("dot"), _r(arrays.layer_norm(v)[0], 4).alias("first_normed"))


@query("with e as (select label, unnest(cast(embedding as double[])) as x, unnest(range(0, len(embedding))) as i from embeddings) select label, cast(i as int) as i, round(avg(x), 5) as mean from e group by label, i")
def embed_means(s, d):
    e = _t(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", "i").agg(_r(F.avg(F.col("x").cast("double")), 5).alias("mean"))


# Learning to choose.


@query()
def learned_choice(s, d):
    """Candidates of the samples; each half by hash is decided by what was learned on the other."""
    x = _samples(s, d).where(F.size("candidates") > 0).select("id", "typed", F.lower("truth").alias("golds"), F.posexplode("candidates").alias("k", "c"))
    from pyspark.sql import Window as W

    w = W.partitionBy("id").orderBy(F.desc("c.s"), "k")
    rows = x.select(F.col("id").alias("case_id"), "typed", "golds", F.col("c.t").alias("word"), F.coalesce("c.s", F.lit(-99.0)).alias("score"), F.lit("near").alias("stage"), F.row_number().over(w).alias("place"), F.count("*").over(W.partitionBy("id")).alias("n"), F.coalesce(F.col("c.s") - F.lead("c.s").over(w), F.lit(10.0)).alias("gap"))
    rows = rows.where("typed is not null and word is not null").withColumn("typed_score", F.lit(None).cast("double"))
    f = learned.features(rows).withColumn("_half", F.pmod(F.xxhash64("case_id"), F.lit(2)))
    halves = [learned.decide(learned.fit(f.where(F.col("_half") == 1 - h)), f.where(F.col("_half") == h), tau=0.5) for h in (0, 1)]
    return halves[0].unionByName(halves[1]).select("case_id", "word", _r("p", 4).alias("p"))
