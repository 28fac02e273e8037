"""One consistent form for text that looks the same (problem 2).

A batch of Arrow strings becomes one array of code points with row offsets. Table gathers fold
full-width forms, spaces and invisible characters and take letters apart; marks are put into
canonical order and composed again for all rows at once. No string is touched row by row, and rows
without any affected code point are passed through.

The result for a text: composed (NFC); full-width ASCII as ASCII; every space separator as U+0020;
no invisible (format) characters; look-alike letters of other scripts as Latin, except in words
that are wholly in another script and hold a letter without a Latin twin. Superscripts, fractions,
ligatures and half-width kana stay. Null stays null, empty stays empty; a text of any length is
processed whole.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 0x30000  # code points of the tables; those beyond are never changed

# Letters that look like a Latin one in common fonts, and the Latin letter.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V", "Ӏ": "I", "Ԍ": "G",
    # Greek
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "Օ": "O", "Ս": "U",
}
#: Letters of the Latin script itself that are drawn like another.
LATIN_TWINS = {"Ð": "Đ", "ɑ": "a", "ɡ": "g", "ɩ": "i", "Ɖ": "Đ"}
#: Characters without a glyph that are not in the category Cf, and Cf that are drawn.
BLANK = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)]
DRAWN = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD, *range(0x13430, 0x13456)}


class Tables:
    """Lookup tables over code points, made from the Unicode data of this Python."""

    def __init__(self) -> None:
        cps = range(SIZE)
        self.ccc = np.zeros(SIZE, np.uint8)
        self.lower = np.arange(SIZE, dtype=np.int32)
        self.word = np.zeros(SIZE, bool)  # letters and decimal digits
        self.space = np.array([chr(i).isspace() for i in cps])
        self.latin, self.other, self.letter = np.zeros(SIZE, bool), np.zeros(SIZE, bool), np.zeros(SIZE, bool)
        fold: dict[int, list[int]] = {}
        pairs: dict[tuple[int, int], int] = {}
        unstable = set()
        for i in cps:
            ch = chr(i)
            kind = unicodedata.category(ch)
            if kind == "Cn" or kind == "Cs":
                continue
            if kind[0] == "L" or kind == "Nd":
                self.word[i] = True
                self.letter[i] = kind[0] == "L"
            elif kind[0] == "M":
                self.ccc[i] = unicodedata.combining(ch)
                self.letter[i] = True
            if len(low := ch.lower()) == 1:
                self.lower[i] = ord(low)
            elif i == 0x130:
                self.lower[i] = ord("i")
            if kind[0] == "L":
                latin = i < 0x250 or 0x250 <= i < 0x2B0 or 0x1E00 <= i < 0x1F00 or 0xFF21 <= i <= 0xFF5A or 0x2C60 <= i < 0x2C80 or 0xA720 <= i < 0xA800
                self.latin[i], self.other[i] = latin, not latin
            d = unicodedata.decomposition(ch)
            if d and d[0] != "<":
                fold[i] = [ord(x) for x in unicodedata.normalize("NFD", ch)]
                parts = [int(x, 16) for x in d.split()]
                if unicodedata.normalize("NFC", ch) != ch:
                    unstable.add(i)
                elif len(parts) == 2:
                    pairs[parts[0], parts[1]] = i
        self.plain = dict(fold)
        folded = {i: [i - 0xFEE0] for i in range(0xFF01, 0xFF5F)}
        folded |= {i: [0x20] for i in cps if unicodedata.category(chr(i)) == "Zs" and i != 0x20}
        folded |= {i: [] for i in cps if unicodedata.category(chr(i)) == "Cf" and i not in DRAWN} | {i: [] for i in BLANK}
        folded |= {ord(a): [ord(b)] for a, b in LATIN_TWINS.items()}
        self.nfd = self._expansion(fold)
        self.full = self._expansion(fold | folded)
        self.twin = np.zeros(SIZE, np.int32)
        for a, b in LOOKALIKES.items():
            self.twin[ord(a)] = ord(b)
            self.other[ord(a)] = False
        keys = np.array([a << 21 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(list(pairs.values()), np.int32)[order]
        jamo = [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]
        self.second = np.zeros(SIZE, bool)  # starters that may compose with the starter before them
        self.second[jamo + [b for _, b in pairs if not self.ccc[b]]] = True
        touched = np.zeros(SIZE, bool)
        touched[list(unstable)] = True
        touched |= (self.ccc > 0) | self.second
        self.flag_nfc = touched.copy()
        touched[list(folded)] = True
        # A letter such as Greek omicron with tonos comes apart into a look-alike and a mark.
        touched[[i for i, x in fold.items() if self.twin[x[0]]]] = True
        self.flag = touched | (self.twin > 0)

    @staticmethod
    def _expansion(fold: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, length = np.arange(SIZE, dtype=np.int64), np.ones(SIZE, np.int64)
        pool, at = [np.arange(SIZE, dtype=np.int32)], SIZE
        for i, to in fold.items():
            start[i], length[i] = at, len(to)
            pool.append(np.array(to, np.int32))
            at += len(to)
        return start, length, np.concatenate(pool)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def to_points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, and the offset of each row among them (rows + 1); null is empty."""
    strings = strings.cast(pa.large_string()) if not pa.types.is_large_string(strings.type) else strings
    n = len(strings)
    if not n:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    if strings.null_count:
        strings = pc.fill_null(strings, "")
    _, off, data = strings.buffers()
    offsets = np.frombuffer(off, np.int64)[strings.offset : strings.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    try:
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.int32)
    except UnicodeDecodeError:  # broken bytes somewhere: each becomes U+FFFD
        texts = [bytes(raw[a - offsets[0] : b - offsets[0]]).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        return to_points(pa.array(texts, pa.large_string()))
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    return points, lead[offsets - offsets[0]]


def to_strings(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of to_points."""
    width = np.ones(len(points), np.int64)
    for limit in (0x80, 0x800, 0x10000):
        width += points >= limit
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(at[offsets].tobytes()), pa.py_buffer(data)])


def _expand(points: np.ndarray, offsets: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray]:
    start, length, pool = table
    low = np.minimum(points, SIZE - 1)
    n = np.where(points < SIZE, length[low], 1)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    within = np.arange(total) - np.repeat(ends - n, n)
    out = pool[np.repeat(start[low], n) + within]
    if len(points) and points.max() >= SIZE:
        far = np.repeat(points, n)
        out = np.where(far >= SIZE, far, out)
    return out.astype(np.int32), np.concatenate([[0], ends])[offsets]


def _lookup(t: Tables, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The composed code points of pairs, 0 where there is none."""
    key = first.astype(np.int64) << 21 | second
    at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
    return np.where(t.keys[at] == key, t.made[at], 0)


def _hangul(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    lv = (first >= 0x1100) & (first < 0x1113) & (second >= 0x1161) & (second < 0x1176)
    s = first - 0xAC00
    lvt = (s >= 0) & (s < 11172) & (s % 28 == 0) & (second > 0x11A7) & (second < 0x11C3)
    return np.where(lv, 0xAC00 + ((first - 0x1100) * 21 + (second - 0x1161)) * 28, np.where(lvt, first + second - 0x11A7, 0))


def _compose(t: Tables, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of marks, then composition, of taken-apart text."""
    n = len(points)
    if not n:
        return points, offsets
    ccc = np.where(points < SIZE, t.ccc[np.minimum(points, SIZE - 1)], 0).astype(np.int16)
    head = ccc == 0
    head[offsets[:-1][offsets[:-1] < n]] = True
    if (~head).any():
        seg = np.cumsum(head)
        if ((ccc[:-1] > ccc[1:]) & (ccc[1:] > 0) & ~head[1:]).any():
            order = np.lexsort((ccc, seg))
            points, ccc = points[order], ccc[order]
        starts = np.flatnonzero(head)
        sizes = np.diff(np.append(starts, n))
        now = points.copy()
        gone = np.zeros(n, bool)
        open_ = np.flatnonzero(sizes > 1)
        last = np.zeros(len(starts), np.int16)
        k = 1
        while len(open_):
            at = starts[open_] + k
            made = _lookup(t, now[starts[open_]], points[at])
            made = np.where(last[open_] >= ccc[at], np.where(last[open_] == 0, made, 0), made)
            ok = made > 0
            now[starts[open_[ok]]] = made[ok]
            gone[at[ok]] = True
            last[open_[~ok]] = ccc[at[~ok]]
            k += 1
            open_ = open_[sizes[open_] > k]
        points, offsets, ccc = _keep(now, offsets, ~gone, ccc)
    second = (points < SIZE) & t.second[np.minimum(points, SIZE - 1)]
    while second.any():
        row_start = np.zeros(len(points) + 1, bool)
        row_start[offsets[:-1]] = True
        at = np.flatnonzero(second[1:] & ~row_start[1:-1] & (ccc[:-1] == 0)) + 1
        if not len(at):
            break
        made = _lookup(t, points[at - 1], points[at])
        made = np.where(made, made, _hangul(points[at - 1], points[at]))
        at, made = at[made > 0], made[made > 0]
        if not len(at):
            break
        lone = np.append(True, np.diff(at) > 1)
        at, made = at[lone], made[lone]
        points = points.copy()
        points[at - 1] = made
        keep = np.ones(len(points), bool)
        keep[at] = False
        points, offsets, ccc = _keep(points, offsets, keep, ccc)
        second = (points < SIZE) & t.second[np.minimum(points, SIZE - 1)]
    return points, offsets


def _keep(points: np.ndarray, offsets: np.ndarray, keep: np.ndarray, ccc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    left = np.concatenate([[0], np.cumsum(keep)])
    return points[keep], left[offsets], ccc[keep]


def _twins(t: Tables, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Look-alikes as Latin letters, word by word; a word is a run of letters and marks."""
    low = np.minimum(points, SIZE - 1)
    twin = np.where(points < SIZE, t.twin[low], 0)
    if not twin.any():
        return points
    letter = (points < SIZE) & t.letter[low]
    edge = ~letter
    edge[1:] |= ~letter[:-1]
    edge[offsets[:-1][offsets[:-1] < len(points)]] = True
    edge[0] = True
    starts = np.flatnonzero(edge)
    # Bit 0: a Latin letter; bit 1: a letter of another script without a twin.
    kinds = (t.latin[low].astype(np.uint8) | t.other[low].astype(np.uint8) << 1) * (points < SIZE)
    of_word = np.repeat(np.bitwise_or.reduceat(kinds, starts), np.diff(np.append(starts, len(points))))
    return np.where((twin > 0) & (of_word != 2), twin, points)


def unify_points(points: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The consistent form of all rows; fold=False gives NFC alone. Third: the rows looked at."""
    t = tables()
    flag = (t.flag if fold else t.flag_nfc)[np.minimum(points, SIZE - 1)] & (points < SIZE)
    seen = np.concatenate([[0], np.cumsum(flag)])
    rows = np.flatnonzero(seen[offsets[1:]] > seen[offsets[:-1]])
    if not len(rows):
        return points, offsets, rows
    size = np.diff(offsets)
    mask = np.zeros(len(size), bool)
    mask[rows] = True
    p, o = points[np.repeat(mask, size)], np.concatenate([[0], np.cumsum(size[rows])])
    p, o = _expand(p, o, t.full if fold else t.nfd)
    if fold:
        p = _twins(t, p, o)
    p, o = _compose(t, p, o)
    if len(rows) == len(size):
        return p, o, rows
    sizes = size.copy()
    sizes[rows] = np.diff(o)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(offs[-1], np.int32)
    where = np.repeat(mask, sizes)
    out[where] = p
    out[~where] = points[np.repeat(~mask, size)]
    return out, offs, rows


def unify_array(strings: pa.Array, fold: bool = True) -> pa.Array:
    """Arrow strings in, Arrow strings out; nulls stay."""
    points, offsets = to_points(strings)
    p, o, rows = unify_points(points, offsets, fold)
    out = strings.cast(pa.large_string()) if not len(rows) else to_strings(p, o)
    if strings.null_count and len(rows):
        out = pc.if_else(strings.is_valid(), out, pa.scalar(None, pa.large_string()))
    return out.cast(pa.string())


@F.arrow_udf(T.StringType())
def unified(v: pa.Array) -> pa.Array:
    """A string column in the consistent form of this module."""
    return unify_array(v)


@F.arrow_udf(T.StringType())
def composed(v: pa.Array) -> pa.Array:
    """A string column in NFC, nothing else changed."""
    return unify_array(v, fold=False)


def has_beyond_ascii(col: Column) -> Column:
    """Whether a text can change at all: ASCII text is in the consistent form already."""
    return F.octet_length(col) != F.char_length(col)


def changed_values(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """Rows of df whose text in `col` is not in the consistent form: the keys, the text and its
    form, as `keys..., value, unified`. Null never counts. ASCII-only rows do not reach Python."""
    d = df.select(*keys, F.col(col).alias("value")).where(F.col("value").isNotNull() & has_beyond_ascii(F.col("value")))
    return d.withColumn("unified", unified("value")).where(F.col("unified") != F.col("value"))


def main() -> None:  # pragma: no cover - a look at one text from a shell
    print(unify_array(pa.array(sys.argv[1:])).to_pylist())


if __name__ == "__main__":
    main()
