"""The queries of this subpackage, by name, and the SQL of those that SQL can state."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leakage, mixing, overlap, rankfuse, residue, stratify, terms, unify

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _words(s: SparkSession, d: str) -> DataFrame:
    return terms.marked_words(_t(s, d, "word_counts"), _t(s, d, "lexicon"))


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return _words(s, d).where("mark is not null").select("scope", "word", "mark")


def p1_ngrams(s: SparkSession, d: str) -> DataFrame:
    """Every run of one to three words of the documents, with occurrences and documents."""
    letters = F.regexp_extract_all(F.lower(unify.composed("text")), F.lit(r"\p{L}+"), F.lit(0))
    docs = _t(s, d, "documents").select("doc_id", letters.alias("words"))
    return terms.ngram_frequencies(docs, "doc_id", "words", max_n=3).select(F.concat_ws(" ", "gram").alias("gram"), "n", "rows", "records")


def _syllables(s: SparkSession, d: str) -> DataFrame:
    """(field, row_id, pos, alt, value) of all syllables and typed words."""
    v = _t(s, d, "vsec").select(F.col("vsec_id").alias("row_id"), F.posexplode("annotations").alias("pos", "a"))
    current = v.select(F.lit("vsec.current_syllable").alias("field"), "row_id", "pos", F.lit(-1).alias("alt"), F.col("a.current_syllable").alias("value"))
    other = v.select(F.lit("vsec.alternative_syllables").alias("field"), "row_id", "pos", F.posexplode("a.alternative_syllables").alias("alt", "value"))
    typed = _t(s, d, "cases").select(F.lit("cases.typed").alias("field"), F.col("case_id").alias("row_id"), F.lit(-1).alias("pos"), F.lit(-1).alias("alt"), F.col("typed").alias("value"))
    return current.unionByName(other).unionByName(typed)


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return unify.changed_values(_syllables(s, d), "value", ["field", "row_id", "pos", "alt"]).select("field", "row_id", "pos", "alt").distinct()


def p2_forms(s: SparkSession, d: str) -> DataFrame:
    """Each consistent form, lower case, with the number of ways it is written and of its values."""
    v = _syllables(s, d).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    return v.groupBy(overlap.consistent(F.col("value")).alias("form")).agg(F.count("*").alias("spellings"), F.sum("n").alias("values"))


def _fused(s: SparkSession, d: str) -> DataFrame:
    return rankfuse.fused_samples(_t(s, d, "export_samples"), _t(s, d, "teacher_scores"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return rankfuse.outvoted(_fused(s, d))


def p3_ranking(s: SparkSession, d: str) -> DataFrame:
    """Every scored candidate with its place in the one ranking of its sample."""
    e = _fused(s, d).select("id", "model", F.posexplode("ranking").alias("place", "x"))
    return e.select("id", "model", F.col("x.pos").alias("pos"), (F.col("place") + 1).alias("place"), F.col("x.median").alias("median"), F.round("x.mean", 6).alias("mean"))


def p3_overall(s: SparkSession, d: str) -> DataFrame:
    """All candidates of a model in one ranking over its four scores: groups of very many rows."""
    rows = rankfuse.scored_candidates(_t(s, d, "export_samples"), _t(s, d, "teacher_scores"))
    fused = rankfuse.fuse_rows(rows, ["model"], "item", ["s", "r", "ll_left", "ll_full"])
    return fused.select("model", "item", "median", F.round("mean", 6).alias("mean"), F.col("place").cast("long").alias("place"))


def _stratified(s: SparkSession, d: str) -> stratify.Stratified:
    return stratify.Stratified(_t(s, d, "export_samples"), "id", ["set", "class"], _t(s, d, "sample_targets"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return _stratified(s, d).report().where("short").select(F.col("set").alias("set_name"), F.col("class").alias("class_name"))


def p4_report(s: SparkSession, d: str) -> DataFrame:
    return _stratified(s, d).report().select(F.col("set").alias("set_name"), F.col("class").alias("class_name"), "share", "min_rows", "available", "seats", F.round("reached", 6).alias("reached"), "short")


def p4_sample(s: SparkSession, d: str) -> DataFrame:
    return _stratified(s, d).sample().select("id", F.col("set").alias("set_name"), F.col("class").alias("class_name"))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    p = overlap.case_overlap(_t(s, d, "cases")).record_pairs(least=4)
    return p.select(F.least("eval_key", "train_key").alias("case_id_a"), F.greatest("eval_key", "train_key").alias("case_id_b"))


def p5_report(s: SparkSession, d: str) -> DataFrame:
    return overlap.case_overlap(_t(s, d, "cases")).report()


def _leaks(s: SparkSession, d: str) -> DataFrame:
    return leakage.search(leakage.build_index(_t(s, d, "documents")), _t(s, d, "eval_items"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    """Items of fewer than eight words that a document holds whole are in p6_items, not here."""
    return _leaks(s, d).where("words >= 8").select("item_id", "doc_id")


def p6_items(s: SparkSession, d: str) -> DataFrame:
    return leakage.leaks_by_item(_leaks(s, d))


def p6_near(s: SparkSession, d: str) -> DataFrame:
    """Documents where four of the five rarest terms of an item stand close together."""
    return leakage.search_near(leakage.build_index(_t(s, d, "documents")), _t(s, d, "eval_items"))


def _mixture(s: SparkSession, d: str, tokenizer: str = mixing.TOKENIZER) -> mixing.Mixture:
    return mixing.Mixture(_t(s, d, "documents"), _t(s, d, "mix_targets"), tokenizer=tokenizer)


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return _mixture(s, d).report().where("short").select("source")


def _shares(m: mixing.Mixture) -> DataFrame:
    return m.report().select("source", "size", F.round("target", 3).alias("target"), "given", "uses", F.round("share", 6).alias("share"), "short")


def _mix(m: mixing.Mixture) -> DataFrame:
    return m.sample().select(F.col("key").alias("doc_id"), "source", "tokens", "uses")


def p7_report(s: SparkSession, d: str) -> DataFrame:
    return _shares(_mixture(s, d))


def p7_mix(s: SparkSession, d: str) -> DataFrame:
    return _mix(_mixture(s, d))


def p7_byte_report(s: SparkSession, d: str) -> DataFrame:
    """p7_report with a byte as a token: the same sampling, in sizes that SQL can state."""
    return _shares(_mixture(s, d, mixing.BYTES))


def p7_byte_mix(s: SparkSession, d: str) -> DataFrame:
    return _mix(_mixture(s, d, mixing.BYTES))


def p8_found(s: SparkSession, d: str) -> DataFrame:
    return residue.Residue(_t(s, d, "documents")).found().select(F.col("key").alias("doc_id"))


def p8_templates(s: SparkSession, d: str) -> DataFrame:
    """The distinct segments of a known kind, with the texts and sources that hold them."""
    return residue.Residue(_t(s, d, "documents")).templates().where("kind is not null").select("segment", "kind", "docs", "sources")


def p8_kept(s: SparkSession, d: str) -> DataFrame:
    docs = _t(s, d, "documents")
    return residue.Residue(docs).kept(docs).select("doc_id", "source", "text")


def queries() -> dict[str, Query]:
    own = [p1_found, _words, p1_ngrams, p2_found, p2_forms, p3_found, p3_ranking, p3_overall, p4_found, p4_report, p4_sample, p5_found, p5_report, p6_found, p6_items, p6_near, p7_found, p7_report, p7_mix, p7_byte_report, p7_byte_mix, p8_found, p8_templates, p8_kept]
    return {"p1_words" if f is _words else f.__name__: f for f in own}


_P1 = """
with c as (select source, trim(lower(nfc_normalize(word))) as word, n from word_counts where n > 0 and word is not null),
ok as (select * from c where word <> ''),
whole as (select sum(n) as total, count(distinct source) as sources from ok),
counts as (select word, cast(sum(n) as bigint) as total, count(*) as rows, count(distinct source) as records from ok group by word),
l as (select lexicon, trim(lower(nfc_normalize(word))) as word, per_billion as n from lexicon where per_billion > 0 and word is not null and word not like '#%'),
lex as (select word, cast(sum(n) as bigint) as total, count(*) as rows, count(distinct lexicon) as records from l where word <> '' group by word),
marked as (
select 'counts' as scope, word, counts.total, rows, records, case when records = 1 and counts.total < 5 then 'rare' when records = sources and counts.total * 500 > whole.total then 'common' end as mark from counts, whole
union all
select 'lexicon', word, total, rows, records, case when rows = 1 then 'rare' when records >= 7 then 'common' end from lex)
"""
_NGRAMS = """
with t as (select doc_id, regexp_extract_all(lower(nfc_normalize(text)), '\\p{L}+') as w from documents where text is not null),
e as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from t),
g as (select doc_id, n, array_to_string(w[i : i + n - 1], ' ') as gram from e, (select unnest([1, 2, 3]) as n) where i + n - 1 <= len(w))
select gram, n, count(*) as rows, count(distinct coalesce(doc_id, -1)) as records from g group by gram, n
"""
# Complete candidates: (id, model, pos, s, r, l, f) as y.
_SCORED = """
with s as (select id, any_value(candidates) as c from export_samples where id is not null and candidates is not null group by id),
t as (select id, model, any_value(ll_left) as a, any_value(ll_full) as b from teacher_scores where id is not null and model is not null group by id, model),
j as (select s.id, model, unnest(range(greatest(len(c), len(a), len(b)))) as i, c, a, b from s join t on s.id = t.id),
x as (select id, model, cast(i as int) as pos, len(c) = len(a) and len(c) = len(b) as even, c[i + 1].s as s, c[i + 1].r as r, a[i + 1] as l, b[i + 1] as f from j),
z as (select *, coalesce(s is not null and r is not null and l is not null and f is not null and not isnan(s) and not isnan(r) and not isnan(l) and not isnan(f), false) as ok from x),
bad as (select distinct id, model from z where not ok or not coalesce(even, false)),
y as (select z.* from z anti join bad using (id, model))
"""


def _ranks(group: str, item: str, rows: str) -> str:
    of = lambda c: f"rank() over (partition by {group} order by {c} desc)"
    return f"""k as (select *, {of("s")} as ks, {of("r")} as kr, {of("l")} as kl, {of("f")} as kf from {rows}),
fused as (select *, cast(list_sort([ks, kr, kl, kf])[2] as double) as median, (ks + kr + kl + kf) / 4 as mean from k),
placed as (select *, row_number() over (partition by {group} order by median, mean, {item}) as place from fused)
"""


_P3 = _SCORED + ", " + _ranks("id, model", "pos", "y")
_P3_FOUND = _P3 + """, m as (select id, model, max(s) as ms, max(r) as mr, max(l) as ml, max(f) as mf, max(s + r + l + f) as mt from placed group by id, model),
n as (select id, model, count(*) filter (s = ms) as ns, count(*) filter (r = mr) as nr, count(*) filter (l = ml) as nl, count(*) filter (f = mf) as nf from placed join m using (id, model) group by id, model)
select id, model, pos from placed join m using (id, model) join n using (id, model) where place = 1
and cast(s = ms and ns = 1 as int) + cast(r = mr and nr = 1 as int) + cast(l = ml and nl = 1 as int) + cast(f = mf and nf = 1 as int) >= 3 and s + r + l + f < mt"""
_OVERALL = _SCORED + ", o as (select *, id || '#' || pos as item from z where ok), " + _ranks("model", "item", "o")
_P4 = """
with e as (select distinct id, regexp_replace(lower(trim("set")), '[\\s_]+', '-', 'g') as set_name, regexp_replace(lower(trim(class)), '[\\s_]+', '-', 'g') as class_name from export_samples where id is not null),
t as (select "set" as set_name, class as class_name, share, min_rows from sample_targets),
r as (select id, e.set_name, e.class_name, share, min_rows, row_number() over (partition by e.set_name, e.class_name order by md5('7' || id), id) as rank from e join t on t.set_name = e.set_name and t.class_name = e.class_name),
whole as (select cast(floor(count(*) / 4) as bigint) as size from r),
o as (select *, row_number() over (order by rank > min_rows, (rank - 0.5::double) / share, set_name, class_name, rank) as place from r),
taken as (select o.*, place <= size as taken, size from o, whole),
cells as (select t.set_name, t.class_name, any_value(t.share) as share, any_value(t.min_rows) as min_rows, count(id) as available, count(*) filter (taken) as seats, any_value(whole.size) as size from t cross join whole left join taken on taken.set_name = t.set_name and taken.class_name = t.class_name group by t.set_name, t.class_name),
report as (select *, seats < greatest(share * size, min_rows) and available < greatest(share * size, min_rows) as short from cells)
"""
# Sizes in bytes; the plan of the sources, the records in Pareto order, and what is given.
_P7 = """
with d as (select doc_id, source, coalesce(octet_length(encode(text)), 0) as tokens from documents where source is not null),
per as (select source, sum(tokens) as size, count(*) as records from d group by source),
t as (select source, sum(coalesce(weight, 0)) as weight, max(coalesce(max_repeats, 1)) as max_repeats from mix_targets where source is not null group by source),
w as (select t.source, weight, max_repeats, cast(coalesce(size, 0) as bigint) as size, weight * (select sum(size) from per) as target from t left join per using (source)),
c as (select *, size * max_repeats < target as lacks, case when size * max_repeats < target then max_repeats else cast(floor(target / greatest(size, 1)) as bigint) end as copies from w),
plan as (select *, case when lacks then 0.0::double else target - copies * size end as rest from c),
u as (select d.*, copies, rest, (cast('0x' || substr(md5('7' || doc_id || '/' || source), 1, 13) as bigint) + 0.5::double) / 4503599627370496 as u, rest / size as p from d join plan using (source)),
o as (select *, (u / (1 - u)) / (p / (1 - p)) as odds from u),
s as (select *, rest > 0 and tokens > 0 as drawn, sum(tokens) over (partition by source, rest > 0 and tokens > 0 order by odds, doc_id rows unbounded preceding) as upto from o),
mix as (select doc_id, source, cast(tokens as bigint) as tokens, cast(copies + case when drawn and upto - tokens / 2 < rest then 1 else 0 end as bigint) as uses from s),
given as (select source, cast(sum(tokens * uses) as bigint) as given, max(uses) as uses from mix where uses > 0 group by source),
report as (select plan.source, size, target, coalesce(given, 0) as given, coalesce(uses, 0) as uses, coalesce(given, 0) / greatest((select sum(given) from given), 1) as share, lacks and coalesce(given, 0) < target as short from plan left join given using (source))
"""


_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ASCII = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_PARTS = {c: unicodedata.normalize("NFD", c) for c in map(chr, range(0x370, 0x530))}
#: Look-alikes, and letters that are one with a mark.
_TWINS = unify.LOOKALIKES | {c: made for c, d in _PARTS.items() if len(d) > 1 and d[0] in unify.LOOKALIKES and len(made := unicodedata.normalize("NFC", unify.LOOKALIKES[d[0]] + d[1:])) == 1}
_FROM, _TO = "".join(_TWINS), "".join(_TWINS.values())
_BLANK = "".join(f"\\x{{{i:04X}}}" for i in unify.BLANK)


def _bare(x: str) -> str:
    """Spaces, invisible characters, full-width forms and Latin twins replaced."""
    x = f"regexp_replace({x}, '[\\p{{Cf}}{_BLANK}]', '', 'g')"
    x = f"translate(regexp_replace({x}, '\\p{{Zs}}', ' ', 'g'), '{_WIDE}', '{_ASCII}')"
    return f"nfc_normalize(translate({x}, '{''.join(unify.LATIN_TWINS)}', '{''.join(unify.LATIN_TWINS.values())}'))"


def _twin(w: str) -> str:
    """A word with its look-alikes as Latin letters, unless it is wholly in another script."""
    return f"case when regexp_matches({w}, '\\p{{Latin}}') or regexp_full_match({w}, '[{_FROM}\\p{{M}}\\P{{L}}]+') then nfc_normalize(translate({w}, '{_FROM}', '{_TO}')) else {w} end"


_VALUES = """
with v as (select vsec_id, unnest(annotations) as a, unnest(range(0, len(annotations))) as pos from vsec),
o as (select vsec_id, pos, unnest(a.alternative_syllables) as value, unnest(range(0, len(a.alternative_syllables))) as alt from v),
x as (select 'vsec.current_syllable' as field, vsec_id as row_id, pos, -1 as alt, a.current_syllable as value from v union all
select 'vsec.alternative_syllables', vsec_id, pos, alt, value from o union all select 'cases.typed', case_id, -1, -1, typed from cases),
b as (select *, """ + _bare("value") + """ as bare from x where value is not null),
f as (select *, """ + _twin("bare") + """ as form from b)
"""
_LISTS = """
with c as (select case_id, arg_max({'source': source, 'history': history, 'typed': typed}, coalesce(loaded_at, timestamp '0001-01-01')) as c from cases where case_id is not null group by case_id),
t as (select case_id, regexp_replace(lower(trim(c.source)), '[\\s-]+', '_', 'g') as source, """ + _bare("concat_ws(' ', c.history, c.typed)") + """ as text from c where c.typed is not null),
w as (select case_id, source, case when source in ('vsec_dev', 'viwiki', 'synth_dev') then 0 when source in ('vsec_train', 'synth_train') then 1 end as side, list_transform(list_filter(string_split_regex(text, '[\\s\\x{0B}\\x{85}\\x{2028}\\x{2029}]+'), lambda x: x <> ''), lambda x: lower(""" + _twin("x") + """)) as w from t),
l as (select *, len(w) as n from w where side is not null and len(w) > 0),
k as (select distinct case_id, side, n, i, list_concat(w[1 : i - 1], w[i + 1 :]) as k from (select *, unnest(range(1, n + 1)) as i from l where n >= 4)),
near as (
select a.case_id as e, b.case_id as t from k a join k b on a.k = b.k and a.n = b.n and a.i = b.i where a.side = 0 and b.side = 1 union
select a.case_id, b.case_id from k a join l b on a.k = b.w where a.side = 0 and b.side = 1 and b.n >= 4 union
select a.case_id, b.case_id from l a join k b on a.w = b.k where a.side = 0 and b.side = 1 and a.n >= 4),
same as (select a.case_id as e, b.case_id as t from l a join l b on a.w = b.w where a.side = 0 and b.side = 1),
near_only as (select near.e, near.t from near anti join same using (e, t)),
best as (select e, max(case when a.n < b.n then 1.0 else (a.n - 1) / a.n end) as covered from near_only join l a on a.case_id = e join l b on b.case_id = t group by e),
per as (select source, same.e is not null as same, best.e is not null as near, case when same.e is not null then 1.0 else coalesce(covered, 0.0) end as covered from l left join (select distinct e from same) same on same.e = case_id left join best on best.e = case_id where side = 0)
"""


def _grams(table: str, key: str) -> str:
    """(key, n, i, g): runs of eight words, or all words of a text with fewer."""
    return f"""(select {key}, n, i, w[i : i + least(n, 8) - 1] as g from (select {key}, w, len(w) as n, unnest(range(1, len(w) - least(len(w), 8) + 2)) as i
from (select {key}, list_filter(flatten(list_transform(regexp_extract_all({_bare("text")}, '[\\p{{L}}\\p{{M}}\\p{{Nd}}]+'), lambda x: regexp_extract_all(lower({_twin("x")}), '[\\p{{L}}\\p{{Nd}}]+'))), lambda x: x <> '') as w from {table} where text is not null and {key} is not null) where len(w) > 0))"""


# Items of eight words or more: runs of eight at one alignment that follow one another are one longer run.
_LEAKS = f"""
with i as {_grams("eval_items", "item_id")}, d as {_grams("documents", "doc_id")},
hit as (select distinct item_id, doc_id, i.i as s, d.i - i.i as shift, i.n as n from i join d on i.g = d.g where i.n >= 8),
run as (select *, s - row_number() over (partition by item_id, doc_id, shift order by s) as r from hit),
length as (select item_id, doc_id, n, count(*) + 7 as words from run group by item_id, doc_id, shift, r, n),
best as (select item_id, doc_id, max(words) as words, max(n) as n from length group by item_id, doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """p7_found's size is in bytes there: its result doesn't depend on the tokenizer."""
    return {
        "p1_found": _P1 + "select scope, word, mark from marked where mark is not null",
        "p1_words": _P1 + "select scope, word, total, rows, records, mark from marked",
        "p1_ngrams": _NGRAMS,
        "p2_found": _VALUES + "select distinct field, row_id, cast(pos as int) as pos, cast(alt as int) as alt from f where form <> value",
        "p2_forms": _VALUES + "select lower(form) as form, count(distinct value) as spellings, count(*) as \"values\" from f group by lower(form)",
        "p3_found": _P3_FOUND,
        "p3_ranking": _P3 + "select id, model, pos, cast(place as int) as place, median, round(mean, 6) as mean from placed",
        "p3_overall": _OVERALL + "select model, item, median, round(mean, 6) as mean, place from placed",
        "p4_found": _P4 + "select set_name, class_name from report where short",
        "p4_report": _P4 + "select set_name, class_name, share, min_rows, available, seats, round(seats / greatest(size, 1), 6) as reached, short from report",
        "p4_sample": _P4 + "select id, set_name, class_name from taken where taken",
        "p5_found": _LISTS + "select least(e, t) as case_id_a, greatest(e, t) as case_id_b from (select e, t from near union select same.e, same.t from same join l on l.case_id = same.e where n >= 4)",
        "p5_report": _LISTS + "select source, count(*) as records, count(*) filter (same) as same, count(*) filter (near and not same) as near, round(avg(covered), 6) as coverage from per group by source",
        "p6_found": _LEAKS + "select item_id, doc_id from best",
        "p6_items": _LEAKS + "select item_id, count(*) as documents, cast(max(words) as int) as longest, max(cast(words = n as int)) as whole from best group by item_id",
        "p7_found": _P7 + "select source from report where short",
        "p7_byte_report": _P7 + "select source, size, round(target, 3) as target, given, uses, round(share, 6) as share, short from report",
        "p7_byte_mix": _P7 + "select doc_id, source, tokens, uses from mix where uses > 0",
    }
