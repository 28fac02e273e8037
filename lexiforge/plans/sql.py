"""Parts of the SQL statements that the queries are checked with (DuckDB's dialect)."""

from ..functions.text import _ACCENTED, _BARE, _TONED, _UNTONED
from ..operators.similar import KEYBOARD as KEYS

TOKENS = r"""list_transform(regexp_extract_all(nfc_normalize(text), '\p{L}+|[^\p{L}\s\p{Z}]'), lambda x: case when regexp_matches(x, '^\p{L}') then lower(x) else '' end)"""
TOK = f"tk as (select doc_id, source, {TOKENS} as tk from documents where text is not null), tok as (select doc_id, source, unnest(tk) as w, unnest(range(1, len(tk) + 1)) as pos from tk)"
PHRASE = TOK + ", isl as (select *, sum(cast(w = '' as int)) over (partition by doc_id order by pos) as i from tok), phr as (select doc_id, pos, w, cast(dense_rank() over (partition by doc_id order by i) - 1 as int) as phrase from isl where w <> '')"
LEX = "lx as (select lexicon, line_no, trim(lower(nfc_normalize(word))) as word, per_billion from lexicon where per_billion > 0 and word is not null and not starts_with(word, '#')), lex as (select lexicon, word, min(line_no) as line_no, arg_min(per_billion, line_no) as per_billion from lx where word <> '' group by lexicon, word)"
KNOWN = r"known as (select distinct word from lex where regexp_full_match(word, '\p{L}+'))"
LANGUAGES = r"lang as (select word, max(case when starts_with(lexicon, 'vi') then ln(per_billion) end) as vi, max(case when starts_with(lexicon, 'en') then ln(per_billion) end) as en from lex where regexp_full_match(word, '\p{L}+') group by word having vi is not null or en is not null)"
COUNTS = "wc as (select source, trim(lower(nfc_normalize(word))) as word, n from word_counts where n > 0 and word is not null and source is not null), counts as (select source, word, cast(sum(n) as bigint) as n from wc where word <> '' group by source, word)"
COMBINED = COUNTS + ", tot as (select source, sum(n) as s from counts group by source), comb as (select word, sum(n / s) / (select count(*) from tot) * 1e9 as per_billion, count(*) as sources from counts join tot using (source) group by word)"
WORDS = "words as (select distinct trim(nfc_normalize(word)) as word from word_counts where word is not null and trim(nfc_normalize(word)) <> '')"
LINES = r"ln as (select doc_id, string_split_regex(nfc_normalize(text), '[\n\r]+') as l from documents where text is not null), ll as (select doc_id, unnest(l) as text, unnest(range(0, len(l))) as line from ln), lines as (select doc_id, cast(line as int) as line, text from ll where trim(text) <> '')"
SAMPLES = "s as (select id, any_value(\"set\") as \"set\", any_value(class) as class, any_value(candidates) as candidates, any_value(truth) as truth, any_value(truth_in) as truth_in, any_value(\"real\") as \"real\" from export_samples where id is not null group by id)"
TEACHERS = "tea as (select id, model, any_value(ll_left) as ll_left, any_value(ll_full) as ll_full from teacher_scores where id is not null and model is not null group by id, model)"
CASES = r"cs as (select case_id, arg_max({'source': source, 'typed': typed, 'gold': gold, 'is_error': is_error, 'history': history}, loaded_at) as c from cases where case_id is not null group by case_id), c as (select case_id, replace(lower(trim(c.source)), '-', '_') as source, lower(nfc_normalize(c.typed)) as typed, lower(nfc_normalize(string_split(c.gold, '|')[1])) as gold, c.gold as golds, c.is_error as is_error, c.history as history from cs where c.typed is not null and c.gold is not null)"
_CORE = r"regexp_extract(nfc_normalize({x}), '^[^\p{{L}}\p{{N}}_]*((?s:.*?))[^\p{{L}}\p{{N}}_]*$', 1)"
FIXES = "vs as (select vsec_id, any_value(annotations) as a from vsec where vsec_id is not null group by vsec_id), va as (select vsec_id, unnest(a) as x, unnest(range(0, len(a))) as pos from vs), fixes as (select vsec_id, cast(pos as int) as pos, lower(" + _CORE.format(x="x.current_syllable") + ") as wrong, lower(" + _CORE.format(x="x.alternative_syllables[1]") + ') as "right" from va where not x.is_correct and len(x.alternative_syllables) = 1 and x.current_syllable is not null and x.alternative_syllables[1] is not null)'
JOURNAL = "j as (select user_id as user, event_id, ts, case event_type when 'click' then 'FIX' when 'error' then 'UNDO' else upper(event_type) end as kind, props::json->>'$.k' as keys, 'w' || cast(cast(floor(value / 50) as bigint) as varchar) as fix from events)"
TAIL = "d as (select distinct source, line_no from word_counts where source is not null and line_no is not null), tail as (select *, row_number() over (partition by source order by line_no desc) as tail from d)"
_V = "list_transform(candidates, lambda x: case when coalesce(x.x, false) then -1e9 else {} end)"
CHOSEN = (
    SAMPLES
    + ", ways as (select id, \"set\" as set_name, class as class_name, list_position(list_transform(candidates, lambda x: lower(x.t) = lower(truth) and not coalesce(x.x, false)), true) - 1 as gold, list_position(list_transform(candidates, lambda x: coalesce(x.keep, false)), true) - 1 as keep_at, unnest(['ngram', 'ngram_right']) as method, unnest(["
    + _V.format("coalesce(x.s, -1e9)")
    + ", "
    + _V.format("coalesce(x.s, -1e9) + coalesce(x.r, 0.0)")
    + "]) as v from s where len(candidates) > 0), chosen as (select id, set_name, class_name, case when gold >= 0 then gold end as gold, case when keep_at >= 0 then keep_at end as keep_at, method, list_position(v, list_max(v)) - 1 as top, 1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) as p from ways)"
)


def q(p: str) -> str:
    return f"cast(least(greatest(round(-ln({p}) * 4096), 0), 65535) as bigint)"


def bare(x: str) -> str:
    return f"translate(lower({x}), '{_ACCENTED}', '{_BARE}')"


def bag(a: str, b: str) -> str:
    return " + ".join(f"abs(length({a}) - length(replace({a}, '{chr(i)}', '')) - length({b}) + length(replace({b}, '{chr(i)}', '')))" for i in range(97, 123))


def thresholds(values: str) -> str:
    return f"taus as (select unnest([{', '.join(v.strip() + '::double' for v in values.split(','))}]) as tau)"


def top(x: str) -> str:
    return f"list_position({x}, list_max({x}))"


def clean(x: str) -> str:
    return f"{x} is not null and len({x}) > 0 and len(list_filter({x}, lambda x: x is null or isnan(x))) = 0"


FORMS = (
    "fw as (select word, lower(word) as l, regexp_extract(lower(word), '([" + _TONED + "])', 1) as t, substr(word, 1, 1) as f from words), forms as (select word, "
    + bare("word")
    + f" as bare, translate(l, '{_TONED}', '{_UNTONED}') as untoned, cast(case when t = '' then 0 else (strpos('{_TONED}', t) - 1) % 5 + 1 end as int) as tone, "
    + r"case when regexp_matches(word, '^<.*>$') then 5 when not regexp_matches(word, '\p{L}') then 4 when upper(word) = word and l <> word and length(word) > 1 then 2 when upper(f) = f and lower(f) <> f then 1 else 0 end as shape from fw)"
)
BIGRAM = (
    "g2 as (select w as prev, lead(w) over (partition by doc_id order by pos) as word from tok), p2 as (select prev, word, count(*) as n from g2 where prev <> '' and word <> '' and prev in (from known) group by prev, word), t2 as (select prev, cast(sum(n) as bigint) as total from p2 group by prev), bi as (select prev, word, n, total, "
    + q("n / total")
    + " as q from p2 join t2 using (prev) where n >= 6 and word in (from known))"
)
_D = "case when n1 + 2 * n2 = 0 then 0.75 else least(greatest(n1 / greatest(n1 + 2 * n2, 1), 0.1), 0.95) end as d"
KN = f"""{TOK}, {LEX}, {KNOWN},
gr as (select w as x, lead(w) over o as y, lead(w, 2) over o as z from tok window o as (partition by doc_id order by pos)),
c2 as (select x as b, y as w, count(*) as n from gr where x in (from known) and y in (from known) group by all),
c3 as (select x as a, y as b, z as w, count(*) as n from gr where x in (from known) and y in (from known) and z in (from known) group by all),
n2 as (select b, w, count(*) as n2 from c3 group by all),
n1 as (select w, count(*) as n1 from c2 group by all),
x3 as (select a, b, sum(n) as total, count(*) as types from c3 group by all),
x2 as (select b, sum(n2) as sum2, count(*) as types2 from n2 group by all),
dd3 as (select n1, n2, {_D} from (select count(*) filter (n = 1) as n1, count(*) filter (n = 2) as n2 from c3)),
dd2 as (select n1, n2, {_D} from (select count(*) filter (n2 = 1) as n1, count(*) filter (n2 = 2) as n2 from n2)),
uni as (select word, greatest(coalesce(n1.n1, 0), 0.5) / greatest((select sum(n1) from n1), 1) as p1, coalesce((select d from dd2) * types2 / sum2, 1.0) as g2, coalesce(sum2, 0) as sum2 from known left join n1 on n1.w = word left join x2 on x2.b = word),
pp as (select c2.b as b, c2.w as w, c2.n as n, case when ub.sum2 = 0 then uw.p1 else greatest(coalesce(n2.n2, 0) - (select d from dd2), 0) / greatest(ub.sum2, 1) + ub.g2 * uw.p1 end as p from c2 left join n2 on n2.b = c2.b and n2.w = c2.w join uni ub on ub.word = c2.b join uni uw on uw.word = c2.w),
pairs as (select b, w, n, p from pp where n >= 6),
triples as (select c3.a as a, c3.b as b, c3.w as w, c3.n as n, greatest(c3.n - (select d from dd3), 0) / x3.total + (select d from dd3) * x3.types / x3.total * pp.p as p from c3 join x3 on x3.a = c3.a and x3.b = c3.b join pp on pp.b = c3.b and pp.w = c3.w where c3.n >= 3),
gammas as (select x3.a as a, x3.b as b, (select d from dd3) * x3.types / x3.total as g3 from x3 where (x3.a, x3.b) in (select (a, b) from triples))"""
_ROWS = ", ".join("('" + n.replace("'", "''") + f"', {y0}, {y1}, {x0}, {x1})" for n, y0, y1, x0, x1 in KEYS)
KEYBOARD = f"""with k(name, y0, y1, x0, x1) as (values {_ROWS})
select a.name as key, b.name as other from k a, k b where a.name <> b.name and (
(abs(a.x1 - b.x0) < 1e-4 or abs(b.x1 - a.x0) < 1e-4) and least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.149999 or
(abs(a.y1 - b.y0) < 1e-4 or abs(b.y1 - a.y0) < 1e-4) and least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.149999)"""
