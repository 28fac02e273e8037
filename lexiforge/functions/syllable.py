"""Vietnamese syllables, their spelling, and the Telex and VNI ways of typing them.

A syllable is an initial, a nucleus and a coda of letters, and a tone. The set of well-spelled
syllables is finite, so validity and the canonical tone place are one dictionary, made from the
tables below; the automaton of the input method looks letters up in it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import MARKED, TONED, struct_type

# The spelling of Vietnamese syllables.
INITIALS = "ngh ng nh gh gi kh ph th tr ch qu b c d đ g h k l m n p r s t v x".split()
CODAS = "c ch m n ng nh p t".split()
#: Nuclei that may have a coda, must have one, or can't.
MAY = "a e ê i o ô ơ u ư oa oe uê uy".split()
MUST = "ă â iê oă oo uâ uô ươ yê uyê".split()
NEVER = "y ai ao au ay âu ây eo êu ia iu oi ôi ơi ua ui uơ ưa ưi ưu oai oay oeo uây uôi uya uyu ươi ươu iêu yêu".split()
BEFORE_CH_NH = "a ê i y oa uê uy".split()
VOWELS = set("aăâeêioôơuưy")
TONE_KEYS = "sfrxj"  # by number of tone
LETTER_KEYS = {"â": "aa", "ă": "aw", "ê": "ee", "ô": "oo", "ơ": "ow", "ư": "uw", "đ": "dd"}
VNI_KEYS = {"â": "a6", "ă": "a8", "ê": "e6", "ô": "o6", "ơ": "o7", "ư": "u7", "đ": "d9"}

TONE_OF = {form: (base, k) for base, forms in TONED.items() for k, form in enumerate(forms, 1)}


def split_tone(ch: str) -> tuple[str, int]:
    return TONE_OF.get(ch, (ch, 0))


def cut(letters: str) -> tuple[str, str, str]:
    """Initial, nucleus and the rest of untoned lower-case letters."""
    initial = next((i for i in INITIALS if letters.startswith(i) and (i not in ("gi", "qu") or letters[2:3] in VOWELS and letters[2:3])), "")
    rest = letters[len(initial) :]
    n = next((k for k, c in enumerate(rest) if c not in VOWELS), len(rest))
    return initial, rest[:n], rest[n:]


def _fits(initial: str, nucleus: str) -> bool:
    front = nucleus[0] in "eêiy"
    if initial in ("k", "gh", "ngh"):
        ok = front
    elif initial in ("c", "ng"):
        ok = not front
    elif initial == "g":
        ok = nucleus[0] not in "eêy"
    else:
        ok = True
    return ok and not (nucleus[0] == "y" and len(nucleus) > 1 and initial not in ("", "qu"))


def is_syllable(letters: str, tone: int, prefix: bool = False) -> bool:
    """a complete syllable, or with prefix=True the beginning of one."""
    if prefix and (letters == "qu" or not any(c in VOWELS for c in letters)):
        return tone == 0 and any(i.startswith(letters) for i in INITIALS)
    initial, nucleus, coda = cut(letters)
    if not nucleus or not _fits(initial, nucleus):
        return False
    known = nucleus in MAY or nucleus in MUST or nucleus in NEVER
    if not known and not (prefix and any(n.startswith(nucleus) for n in (*MAY, *MUST, *NEVER))):
        return False
    if not coda:
        return prefix or nucleus not in MUST
    if nucleus in NEVER:
        return False
    if coda not in CODAS and not (prefix and any(c.startswith(coda) for c in CODAS)):
        return False
    if coda in ("ch", "nh") and nucleus not in BEFORE_CH_NH or coda == "c" and nucleus in ("i", "ê"):
        return False
    return coda not in ("c", "ch", "p", "t") or tone in (1, 5) or (prefix and tone == 0)


def tone_place(letters: str) -> int:
    """the letter that carries the tone, in the traditional style (hòa, thủy)."""
    initial, nucleus, coda = cut(letters)
    marked = [k for k, c in enumerate(nucleus) if c in "ăâêôơư"]
    if marked:
        at = marked[-1]
    elif len(nucleus) == 1:
        at = 0
    elif coda:
        at = len(nucleus) - 1
    else:
        at = 1 if len(nucleus) == 3 else 0
    return len(initial) + at


def toned(letters: str, tone: int) -> str:
    at = tone_place(letters)
    if not tone or letters[at] not in TONED:
        return letters
    return letters[:at] + TONED[letters[at]][tone - 1] + letters[at + 1 :]


@lru_cache(200_000)
def canonical(word: str) -> str | None:
    """F8: lower case with the tone on its traditional letter; None if no syllable."""
    parts = [split_tone(c) for c in word.lower()]
    tones = [t for _, t in parts if t]
    letters = "".join(b for b, _ in parts)
    if len(tones) > 1 or not is_syllable(letters, tones[0] if tones else 0):
        return None
    return toned(letters, tones[0] if tones else 0)


class _Typing:
    """The letters of a word while Telex keys come in: F9."""

    def __init__(self) -> None:
        self.base: list[str] = []  # letters without marks
        self.mark: list[str] = []  # "", hat, breve, horn or stroke
        self.upper: list[bool] = []
        self.tone = 0
        self.literal: str | None = None  # how the word ends once a repeated key has cancelled a mark

    SHAPE = {("a", "breve"): "ă", ("a", "hat"): "â", ("e", "hat"): "ê", ("o", "hat"): "ô", ("o", "horn"): "ơ", ("u", "horn"): "ư", ("d", "stroke"): "đ"}

    def letters(self) -> str:
        return "".join(self.SHAPE.get(x, x[0]) for x in zip(self.base, self.mark))

    def nucleus(self) -> range:
        initial, nucleus, _ = cut(self.letters())
        return range(len(initial), len(initial) + len(nucleus))

    def add(self, key: str, base: str | None = None, mark: str = "") -> None:
        self.base.append(base or key.lower())
        self.mark.append(mark)
        self.upper.append(key.isupper())

    def effect(self, key: str) -> str:
        """'done', 'none' (the key is a letter) or 'undo' (it cancelled a mark)."""
        k = key.lower()
        spots = self.nucleus()
        if k in TONE_KEYS:
            if not spots:
                return "none"
            tone = TONE_KEYS.index(k) + 1
            if self.tone == tone:
                self.tone = 0
                return "undo"
            self.tone = tone
            return "done"
        if k == "z":
            had, self.tone = self.tone, 0
            return "done" if had else "none"
        if k in "aeo":
            at = next((i for i in reversed(spots) if self.base[i] == k), None)
            if at is None:
                return "none"
            undo = self.mark[at] == "hat"
            self.mark[at] = "" if undo else "hat"
            return "undo" if undo else "done"
        if k == "d":
            if self.base[:1] != ["d"]:
                return "none"
            undo = self.mark[0] == "stroke"
            self.mark[0] = "" if undo else "stroke"
            return "undo" if undo else "done"
        if k == "w":
            return self.hook(key, spots)
        return "none"

    def hook(self, key: str, spots: range) -> str:
        if not spots:
            self.add(key, "u", "horn")
            return "done"
        free = [i for i in spots if not self.mark[i]]
        bases = {i: self.base[i] for i in free}
        pair = lambda a, b: next((i for i in free if bases[i] == a and bases.get(i + 1) == b), None)
        if (i := pair("u", "o")) is not None:
            self.mark[i] = self.mark[i + 1] = "horn"
        elif (i := pair("o", "a")) is not None:
            self.mark[i + 1] = "breve"
        elif (i := next((i for i in free if bases[i] in "uo"), None)) is not None:
            self.mark[i] = "horn"
        elif (i := next((i for i in free if bases[i] == "a"), None)) is not None:
            self.mark[i] = "breve"
        elif any(self.mark[i] in ("horn", "breve") for i in spots):
            for i in spots:
                if self.mark[i] in ("horn", "breve"):
                    self.mark[i] = ""
            return "undo"
        else:
            return "none"
        return "done"


@lru_cache(200_000)
def compose(keys: str) -> tuple[str, str]:
    """the text that Telex keys of one word show, and its kind: vietnamese, partial or literal."""
    s = _Typing()
    for n, key in enumerate(keys):
        what = s.effect(key) if key.isascii() and key.isalpha() else "none"
        if what == "none":
            s.add(key)
        elif what == "undo":
            # A key that repeats the one before stands for one letter; else all keys are shown.
            again = n > 0 and keys[n - 1].lower() == key.lower()
            return (keys[:n] + keys[n + 1 :] if again else keys), "literal"
    letters = s.letters()
    if is_syllable(letters, s.tone):
        kind = "vietnamese"
    elif is_syllable(letters, s.tone, prefix=True):
        kind = "partial"
    else:
        return keys, "literal"
    text = toned(letters, s.tone) if s.tone else letters
    return "".join(c.upper() if up else c for c, up in zip(text, s.upper)), kind


def to_keys(word: str, letter_keys: dict[str, str] = LETTER_KEYS, tone_keys: str = TONE_KEYS) -> str:
    """the keys that type a word, the tone last."""
    out, tone = [], ""
    for ch in word:
        base, t = split_tone(ch.lower())
        tone = tone_keys[t - 1] if t else tone
        keys = letter_keys.get(base, base)
        out.append((keys[0].upper() if ch.isupper() else keys[0]) + keys[1:])
    return "".join(out) + tone


def vni_to_telex(keys: str) -> str:
    """Telex keys with the effect of VNI keys; a digit with nothing to act on stays."""
    out: list[str] = []
    for c in keys:
        low = [x.lower() for x in out]
        if c in "12345" and any(x in "aeiouy" for x in low):
            out.append(TONE_KEYS[int(c) - 1])
        elif c == "6" and any(x in "aeo" for x in low):
            at = max(i for i, x in enumerate(low) if x in "aeo")
            out.insert(at + 1, out[at])
        elif c == "7" and any(x in "ou" for x in low) or c == "8" and "a" in low:
            out.append("w")
        elif c == "9" and low[:1] == ["d"] and low[1:2] != ["d"]:
            out.insert(1, out[0])
        else:
            out.append(c)
    return "".join(out)


def compose_vni(keys: str) -> tuple[str, str]:
    text, kind = compose(vni_to_telex(keys))
    return (keys, kind) if kind == "literal" else (text, kind)


def all_syllables() -> dict[str, str]:
    """Every well-spelled toneless or toned syllable in canonical form, with its letters."""
    out = {}
    for initial in ["", *INITIALS]:
        for nucleus in (*MAY, *MUST, *NEVER):
            for coda in ["", *CODAS]:
                letters = initial + nucleus + coda
                for tone in range(6):
                    if cut(letters) == (initial, nucleus, coda) and is_syllable(letters, tone):
                        out[toned(letters, tone)] = letters
    return out


def _distinct(v: pa.Array, f, kind) -> pa.Array:
    """f over the distinct values of a batch."""
    d = v.dictionary_encode()
    done = pa.array([None if x is None else f(x) for x in d.dictionary.to_pylist()], kind)
    return done.take(d.indices)


@F.arrow_udf(T.StringType())
def canonical_syllable(v: pa.Array) -> pa.Array:
    return _distinct(v, lambda x: canonical(unicodedata.normalize("NFC", x)), pa.string())


@F.arrow_udf(struct_type(text=T.StringType(), kind=T.StringType()))
def telex(v: pa.Array) -> pa.Array:
    return _distinct(v, lambda x: dict(zip(("text", "kind"), compose(x))), pa.struct([("text", pa.string()), ("kind", pa.string())]))


@F.arrow_udf(struct_type(text=T.StringType(), kind=T.StringType()))
def vni(v: pa.Array) -> pa.Array:
    return _distinct(v, lambda x: dict(zip(("text", "kind"), compose_vni(x))), pa.struct([("text", pa.string()), ("kind", pa.string())]))


@F.arrow_udf(T.StringType())
def telex_keys(v: pa.Array) -> pa.Array:
    return _distinct(v, lambda x: to_keys(unicodedata.normalize("NFC", x)), pa.string())


@F.arrow_udf(T.StringType())
def vni_keys(v: pa.Array) -> pa.Array:
    return _distinct(v, lambda x: to_keys(unicodedata.normalize("NFC", x), VNI_KEYS, "12345"), pa.string())


__all__ = ["MARKED", "all_syllables", "canonical", "canonical_syllable", "compose", "compose_vni", "is_syllable", "telex", "telex_keys", "to_keys", "vni", "vni_keys", "vni_to_telex"]
