"""A simulated typist: keys of a word, and the slips of a hand on them.

As in `corrupt`, a kind of slip lists its outcomes and one is drawn. Every draw comes from a hash of the
row's key."""

from __future__ import annotations

import random
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .corrupt import rng_of
from .edits import key_rows

#: Of 100 slips, so many exchange, hit beside, leave out, double, or add a key.
SHARES = {"swap": 35, "beside": 25, "omit": 20, "double": 13, "extra": 7}
#: The profiles of a typist, by kind of slip; the second is fitted to a journal.
PROFILES = {
    "default": {"beside": 25.0, "omit": 15.0, "double": 8.0, "extra": 12.0, "swap": 15.0, "tone wrong": 8.0, "tone missing": 8.0, "mark half": 7.0, "caps": 2.0, "slide": 3.0, "multi": 3.0, "held": 4.0},
    "calibrated": {"beside": 15.6, "omit": 14.1, "double": 7.3, "extra": 16.3, "swap": 13.1, "tone wrong": 8.0, "tone missing": 4.6, "mark half": 9.7, "caps": 2.0, "slide": 3.0, "multi": 6.0, "held": 4.0},
}
#: Shares of slips on the keys of tones and marks, and of words with two slips.
TELEX_SHARE, TWO_SHARE = 0.3, 0.2
TONE_KEYS = "sfrxj"


def _spliced(keys: str, at: int, put: str, width: int = 0) -> str:
    return keys[:at] + put + keys[at + width :]


def _near(keys: str) -> list[tuple[int, str]]:
    return [(i, k) for i, c in enumerate(keys) for k in key_rows(c.lower())]


def _ends_in_tone(keys: str) -> bool:
    return len(keys) > 1 and keys[-1] in TONE_KEYS


#: What each kind of slip can make of keys.
OUTCOMES: dict[str, Callable[[str], list[str]]] = {
    "swap": lambda k: [_spliced(k, i, k[i + 1] + k[i], 2) for i in range(len(k) - 1)],
    "beside": lambda k: [_spliced(k, i, x, 1) for i, x in _near(k)],
    "omit": lambda k: [_spliced(k, i, "", 1) for i in range(len(k)) if len(k) > 2],
    "double": lambda k: [_spliced(k, i, c) for i, c in enumerate(k)],
    "extra": lambda k: [_spliced(k, i, x) for i, x in _near(k)],
    "multi": lambda k: [_spliced(k, i, x + y) for i, x in _near(k) for y in key_rows(k[i].lower()) if x != y],
    "slide": lambda k: [_spliced(k, i + 1, x + y) for i, x in _near(k) for y in key_rows(x)],
    "held": lambda k: [_spliced(k, i, c * n, 1) for i, c in enumerate(k) for n in (3, 4, 5)],
    "caps": lambda k: [k[:2].upper() + k[2:]],
    "tone wrong": lambda k: [k[:-1] + t for t in TONE_KEYS if _ends_in_tone(k) and t != k[-1]],
    "tone missing": lambda k: [k[:-1]] if _ends_in_tone(k) else [],
    "mark half": lambda k: [_spliced(k, i, "", 1) for i in range(1, len(k)) if k[i] == "w" or k[i] == k[i - 1] and k[i] in "aeod"],
}
TELEX_KINDS = ("tone wrong", "tone missing", "mark half")


def slip(keys: str, kind: str, rng: random.Random) -> str:
    """The keys with one slip of a kind; unchanged where it can't apply."""
    return rng.choice(OUTCOMES[kind](keys) or [keys])


def typo(keys: str, vietnamese: bool, two: bool, rng: random.Random, shares: dict[str, float] = SHARES) -> str | None:
    """keys of three or more with one slip, or two; None if a few tries change nothing. With shares of the
    hand alone, a slip of a Vietnamese word falls on its tone or mark keys by TELEX_SHARE."""
    for _ in range(8):
        out = keys
        for _ in range(1 + two):
            telex = vietnamese and not shares.keys() & set(TELEX_KINDS) and rng.random() < TELEX_SHARE
            kind = rng.choice(TELEX_KINDS) if telex else rng.choices(list(shares), list(shares.values()))[0]
            out = slip(out, kind, rng)
        if out != keys and len(out) >= 3:
            return out
    return None


def run_lengths(words: int, rng: random.Random, more: float = 0.55, longest: int = 12, most: int = 3) -> list[tuple[int, int]]:
    """Up to `most` runs (start, length) of words typed without blanks; they never touch."""
    out: list[tuple[int, int]] = []
    at = 0
    while at < words - 1 and len(out) < most:
        n = 2
        while n < longest and rng.random() < more:
            n += 1
        start = at + rng.randrange(max(1, words - at))
        if start + n > words:
            break
        out.append((start, n))
        at = start + n + 1
    return out


def typed_by(profile: str = "default"):
    """The UDF of a profile's slips on Telex keys; null where nothing could be done."""

    @F.arrow_udf(T.StringType())
    def run(keys: pa.Array, key: pa.Array) -> pa.Array:
        out = []
        for k, row in zip(keys.to_pylist(), key.to_pylist()):
            rng = rng_of("typo", row)
            out.append(typo(k, True, rng.random() < TWO_SHARE, rng, PROFILES[profile]) if k and len(k) >= 3 else None)
        return pa.array(out, pa.string())

    return run


typed_with_slip = typed_by()
