"""Column functions on words and texts. All but nfc() stay inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vowels of Vietnamese, each with its five toned forms in the order of TONES.
TONES = ["sac", "huyen", "hoi", "nga", "nang"]
TONED = {
    "a": "áàảãạ", "ă": "ắằẳẵặ", "â": "ấầẩẫậ", "e": "éèẻẽẹ", "ê": "ếềểễệ", "i": "íìỉĩị",
    "o": "óòỏõọ", "ô": "ốồổỗộ", "ơ": "ớờởỡợ", "u": "úùủũụ", "ư": "ứừửữự", "y": "ýỳỷỹỵ",
}
#: Letters with a mark, and without.
MARKED = {"ă": "a", "â": "a", "đ": "d", "ê": "e", "ô": "o", "ơ": "o", "ư": "u"}

_TONED = "".join(TONED.values())
_UNTONED = "".join(v * 5 for v in TONED)
_ACCENTED = _TONED + "".join(MARKED)
_BARE = "".join(MARKED.get(c, c) for c in _UNTONED) + "".join(MARKED.values())

#: A word of letters, or one character that ends a phrase; white space only separates.
TOKEN = r"\p{L}+|[^\p{L}\s\p{Z}]"


@F.arrow_udf(T.StringType())
def nfc(v: pa.Array) -> pa.Array:
    """NFC (F4). Null stays null."""
    return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFC", x) for x in v.to_pylist()], pa.string())


def struct_type(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def bare(col: Column) -> Column:
    """Lower case without Vietnamese marks and tones, đ as d (F1), of NFC text."""
    return F.translate(F.lower(col), _ACCENTED, _BARE)


def untoned(col: Column) -> Column:
    """Lower case without tones; hats, breves, horns and đ stay."""
    return F.translate(F.lower(col), _TONED, _UNTONED)


def tone_of(col: Column) -> Column:
    """The first tone in a word: 1 to 5 in the order of TONES, 0 without."""
    first = F.regexp_extract(F.lower(col), f"([{_TONED}])", 1)
    at = F.instr(F.lit(_TONED), first)
    return F.when(col.isNull(), None).when((first == "") | (at == 0), 0).otherwise((at - 1) % 5 + 1)


def skeleton(col: Column) -> Column:
    """(letters without any mark, tone): F2."""
    return F.struct(bare(col).alias("letters"), tone_of(col).alias("tone"))


def same_word(a: Column, b: Column) -> Column:
    """equal letters, and tones that are equal or often swapped: hoi/nga, sac/nga, huyen/hoi."""
    x, y = tone_of(a), tone_of(b)
    pair = F.array_sort(F.array(x, y))
    swap = reduce(lambda p, q: p | q, [pair == F.array(F.lit(m), F.lit(n)) for m, n in ((3, 4), (1, 4), (2, 3))])
    return (bare(a) == bare(b)) & ((x == y) | swap)


def is_upper_word(col: Column) -> Column:
    return (F.upper(col) == col) & (F.lower(col) != col)


def match_case(pattern: Column, word: Column) -> Column:
    """word in the case of pattern: ALL CAPS of two letters or more, Capitalised, or as it is."""
    first = F.substring(pattern, 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    return F.when(is_upper_word(pattern) & (F.char_length(pattern) > 1), F.upper(word)).when(capital, F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))).otherwise(word)


def with_case_of(pattern: Column, word: Column) -> Column:
    """as match_case for lower, Capitalised and UPPER patterns, null for any other mix."""
    low, up = F.lower(pattern) == pattern, is_upper_word(pattern) & (F.char_length(pattern) > 1)
    rest = F.substring(pattern, 2, 1 << 30)
    title = (F.upper(F.substring(pattern, 1, 1)) == F.substring(pattern, 1, 1)) & (F.lower(rest) == rest)
    return F.when(low, F.lower(word)).when(up, F.upper(word)).when(title, match_case(pattern, F.lower(word)))


def shape(token: Column) -> Column:
    """5 a mark of the environment (<...>), 4 no letter, 2 ALL CAPS, 1 Capitalised, 0 else."""
    first = F.substring(token, 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    return F.when(token.rlike("^<.*>$"), 5).when(~token.rlike(r"\p{L}"), 4).when(is_upper_word(token) & (F.char_length(token) > 1), 2).when(capital, 1).otherwise(0)


def is_meant(shown: Column, intended: Column) -> Column:
    """equal, or only the capital of the first letter is lost."""
    lost = (F.lower(F.substring(intended, 1, 1)) == F.substring(shown, 1, 1)) & (F.substring(intended, 2, 1 << 30) == F.substring(shown, 2, 1 << 30))
    return (shown == intended) | lost


def letter_runs(word: Column) -> Column:
    """Runs of equal letters as (letter, n)."""
    runs = F.regexp_extract_all(word, F.lit(r"((.)\2*)"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(F.substring(r, 1, 1).alias("letter"), F.char_length(r).alias("n")))


def repeats(longer: Column, word: Column, most: int | None = None) -> Column:
    """`longer` is `word` with the letters of exactly one run typed more often (up to `most` in all)."""
    a, b = letter_runs(longer), letter_runs(word)
    same = F.transform(a, lambda x: x["letter"]) == F.transform(b, lambda x: x["letter"])
    more = F.filter(F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("d"), x["n"].alias("n"))), lambda x: x["d"] != 0)
    ok = same & (F.size(more) == 1) & (F.element_at(more, 1)["d"] > 0)
    return F.coalesce(ok & (F.element_at(more, 1)["n"] <= most) if most else ok, F.lit(False))


def one_letter_out(longer: Column, word: Column) -> Column:
    """Whether leaving one letter out of `longer` gives `word`."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(longer), F.lit(1)))
    return (F.char_length(longer) == F.char_length(word) + 1) & F.exists(places, lambda i: F.concat(F.substr(longer, F.lit(1), i - 1), F.substr(longer, i + 1)) == word)


def deletions(word: Column) -> Column:
    """The word and all forms with one letter left out, each once."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(word), F.lit(1)))
    return F.array_distinct(F.concat(F.array(word), F.transform(places, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))))


def bag_distance(a: Column, b: Column) -> Column:
    """how many letters a to z two words differ in, whatever their order."""

    def count(word: Column, c: str) -> Column:
        return F.char_length(word) - F.char_length(F.replace(word, F.lit(c), F.lit("")))

    return reduce(lambda x, y: x + y, [F.abs(count(a, chr(i)) - count(b, chr(i))) for i in range(97, 123)])


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.char_length(a), F.char_length(b))
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    differs = F.filter(places, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, n))


def edit_action(shown: Column, wanted: Column) -> Column:
    """(backspaces, text) that turns what is shown into what is wanted."""
    p = common_prefix(shown, wanted)
    return F.struct((F.char_length(shown) - p).alias("backspaces"), F.substr(wanted, p + 1).alias("text"))


def core_split(token: Column) -> Column:
    """T5: what stands before, in and behind the word of a token."""
    lead = F.regexp_extract(token, r"^([^\p{L}\p{N}_]*)", 1)
    tail = F.when(lead == token, "").otherwise(F.regexp_extract(token, r"([^\p{L}\p{N}_]*)$", 1))
    core = F.substr(token, F.char_length(lead) + 1, F.char_length(token) - F.char_length(lead) - F.char_length(tail))
    return F.struct(lead.alias("lead"), core.alias("core"), tail.alias("tail"))


def typing_plan(text: Column) -> Column:
    """Smart quotes, dashes and blanks as typed ones; null where a character can't be typed."""
    t = F.translate(text, "“”‘’–— …", "\"\"''-- .")
    t = F.trim(F.regexp_replace(t, r"[\s]+", " "))
    return F.when(t.rlike(r"^[\p{IsLatin}\p{N}\x20-\x7e]*$"), t)
