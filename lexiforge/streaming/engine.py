"""The state of one typist and what each key does to it (ST1-ST9, ST12).

`Typing.press` takes one event and returns rows; all state is plain values in one dict, so it fits
any keyed state store. `replay` runs it over a table, `stream` over a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.syllable import compose as _compose
from ..functions.syllable import to_keys

IGNORE_AFTER, RIGHT_WORDS, WAIT_SECONDS, WAITING, HISTORY = 2, 3, 60, 8, 4
EVENTS = "user string, seq long, ts double, kind string, ch string"
OUTPUT = "user string, seq long, row string, kind string, keys string, fix string, backspaces int, text string, left string, right string"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]

#: Few beginnings of words make up most of the keys.
compose = lru_cache(1 << 16)(_compose)


class TableCorrector:
    """Corrections by table: keys to a fix, and (keys, next word) to a later fix."""

    def __init__(self, now: dict[str, str], later: dict[str, str] | None = None) -> None:
        self.now, self.later = now, later or {}

    def correct(self, keys: str, history: list[str]) -> str | None:
        return self.now.get(keys.lower())

    def revise(self, keys: str, history: list[str], after: str) -> str | None:
        return self.later.get(f"{keys.lower()} {after.lower()}")


class GivenCorrector(TableCorrector):
    """Corrections that come with the events: of a table of any size, joined to them."""

    def __init__(self) -> None:
        super().__init__({})
        self.given: str | None = None

    def correct(self, keys: str, history: list[str]) -> str | None:
        return self.given


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, above[j] + 1, above[j - 1] + (x != y)))
    return row[-1]


def change(shown: str, wanted: str) -> tuple[int, str]:
    """backspaces and text."""
    n = next((i for i, (a, b) in enumerate(zip(shown, wanted)) if a != b), min(len(shown), len(wanted)))
    return len(shown) - n, wanted[n:]


class Typing:
    def __init__(self, corrector: TableCorrector, user: str, state: dict | None = None, vietnamese: bool = True) -> None:
        self.c, self.user, self.vietnamese = corrector, user, vietnamese
        self.s = state or {"undos": {}, "waiting": [], "typed": 0}
        for k, v in self._fresh().items():
            self.s.setdefault(k, v)
        self.out: list[dict] = []
        self.seq = 0

    @staticmethod
    def _fresh() -> dict:
        return {"keys": "", "shown": "", "before": None, "history": [], "unseen": False, "typed": 0, "last": None, "just_undone": None, "resumed": None, "pending": None, "all": False}

    def forget(self) -> None:
        """A reset: nothing is known of the text on screen; learned words stay."""
        self.s |= self._fresh()

    def row(self, row: str, kind: str = "", keys: str = "", fix: str = "", backspaces: int = 0, text: str = "", left: str = "", right: str = "", seq: int | None = None) -> None:
        self.out.append(dict(zip(COLUMNS, (self.user, self.seq if seq is None else seq, row, kind, keys, fix, backspaces, text, left, right))))

    # Journal lines wait for the words that follow.
    def note(self, kind: str, keys: str, fix: str, left: list[str], ts: float, right: list[str] | None = None) -> None:
        self.s["waiting"].append({"kind": kind, "keys": keys, "fix": fix, "left": " ".join(left), "right": right or [], "ts": ts, "seq": self.seq})
        while len(self.s["waiting"]) > WAITING:
            self.write(self.s["waiting"].pop(0))

    def write(self, line: dict) -> None:
        self.row("journal", line["kind"], line["keys"], line["fix"], left=line["left"], right=" ".join(line["right"]), seq=line["seq"])

    def flush(self, test=lambda line: True) -> None:
        keep = []
        for line in self.s["waiting"]:
            if test(line):
                self.write(line)
            else:
                keep.append(line)
        self.s["waiting"] = keep

    def expire(self, now: float) -> None:
        self.flush(lambda line: now - line["ts"] >= WAIT_SECONDS)

    def press(self, seq: int, ts: float, kind: str, ch: str) -> list[dict]:
        self.seq, self.out, s = seq, [], self.s
        self.expire(ts)
        selected, s["all"] = s["all"], False
        if kind == "char":
            s["last"] = None
            s["keys"] += ch
            shown = compose(s["keys"])[0] if self.vietnamese else s["keys"]
            if shown != s["shown"] + ch:
                b, text = change(s["shown"], shown)
                self.row("action", "replace", backspaces=b, text=text)
            s["shown"] = shown
        elif kind in ("space", "punct"):
            self.boundary(" " if kind == "space" else ch, ts)
        elif kind == "backspace":
            if selected:
                self.forget()
            else:
                self.backspace()
        elif kind == "undo":
            self.undo(ts)
        else:  # reset, select_all, and whatever else moves the caret out of sight
            self.flush()
            self.forget()
            s["all"] = kind == "select_all"
        return self.out

    def boundary(self, mark: str, ts: float) -> None:
        s, punct = self.s, mark != " "
        keys, shown, history = s["keys"], s["shown"], s["history"]
        pending, resumed, undone, unseen = s["pending"], s["resumed"], s["just_undone"], s["unseen"]
        s |= {"keys": "", "shown": "", "pending": None, "resumed": None, "just_undone": None, "unseen": False, "last": None}
        s["typed"] += len(shown) + 1
        fix, decision = None, "none"
        if not keys:
            decision = "empty"
        elif unseen:
            decision = "untracked"
        elif undone == keys:
            decision = "just undone"
        elif s["undos"].get(keys.lower(), 0) >= IGNORE_AFTER:
            decision = "ignored"
        else:
            fix = self.c.correct(keys, history)
            fix = fix if fix and fix != shown else None
            decision = "corrected" if fix else "none"
        final = fix or shown
        known = bool(keys) and not unseen
        if known:
            for line in s["waiting"]:
                line["right"].append(final)
            self.flush(lambda line: len(line["right"]) >= RIGHT_WORDS)
        if resumed and shown and resumed != shown and _distance(resumed, shown) <= 3:
            self.note("EDIT", resumed, shown, history, ts)
        late = None
        if pending and known and s["undos"].get(pending["keys"].lower(), 0) < IGNORE_AFTER:
            late = self.c.revise(pending["keys"], pending["history"], final)
            late = late if late and late != pending["shown"] else None
        if late:
            old, new = f"{pending['shown']} {shown}", f"{late} {final}"
            self.note("LATE", pending["keys"], late, pending["history"], ts, [final])
            last = {"keys": pending["keys"], "fix": late, "old": old, "new": new, "mark": mark, "cut": False, "late": True, "resume": [keys, shown], "history": pending["history"]}
        elif fix:
            old, new = shown, fix
            self.note("FIX", keys, fix, history, ts)
            last = {"keys": keys, "fix": fix, "old": old, "new": new, "mark": mark, "cut": False, "late": False, "resume": [keys, shown], "history": history}
        else:
            last = None
        if last:
            b, text = change(old, new)
            self.row("action", "replace", backspaces=b, text=text + ("" if punct else " "))
            s["typed"] += len(new) - len(old)
            s["last"] = last
        s["before"] = self.showing(final.rsplit(" ", 1)[-1]) if known else None
        if known and not punct:
            words = [*(last["history"] if late else history), *([late] if late else []), *final.split(" ")]
            s["history"] = words[-HISTORY:]
            if decision == "none" and not late:
                s["pending"] = {"keys": keys, "shown": shown, "history": history}
        else:
            s["history"] = []
        self.row("decision", decision, keys, final)
        if mark in ".!?":
            self.flush()

    def showing(self, text: str) -> list[str]:
        """Keys that show a text, and the text."""
        keys = to_keys(text)
        return [keys if self.vietnamese and compose(keys)[0] == text else text, text]

    def undo(self, ts: float) -> None:
        s, last = self.s, self.s["last"]
        s["pending"] = None
        if not last:  # the program's own undo
            self.flush()
            self.forget()
            return
        low = last["keys"].lower()
        s["undos"][low] = s["undos"].get(low, 0) + 1
        if s["undos"][low] == IGNORE_AFTER:
            self.row("learned", keys=low)
        tail = "" if last["cut"] else last["mark"]
        b, text = change(last["new"] + tail, last["old"] + tail)
        self.row("action", "replace", backspaces=b, text=text)
        self.note("UNDO-LATE" if last["late"] else "UNDO", last["keys"], last["fix"], last["history"], ts)
        s |= {"last": None, "just_undone": last["keys"], "history": last["history"], "typed": max(0, s["typed"] + len(last["old"]) - len(last["new"]))}
        if last["cut"]:
            s["keys"], s["shown"] = last["resume"]
            s["before"] = None
        else:
            s["before"] = last["resume"]
            s["history"] = [*last["history"], *last["old"].split(" ")][-HISTORY:] if last["mark"] == " " else []

    def backspace(self) -> None:
        s = self.s
        if s["last"] and not s["last"]["cut"]:
            s["last"]["cut"] = True
        else:
            s["last"] = None
        if s["shown"]:
            left = s["shown"][:-1]
            s["keys"], s["shown"] = self.showing(left) if left else ["", ""]
            return
        s |= {"history": [], "pending": None, "keys": "", "shown": ""}
        if s["before"]:
            s["keys"], s["shown"] = s["before"]
            s["typed"] = max(0, s["typed"] - len(s["shown"]) - 1)
            s["resumed"], s["before"] = s["shown"], None
        elif s["typed"] <= 1:
            s["unseen"] = s["typed"] == 0
            s["typed"] = 0
        else:
            s["typed"] -= 1
            s["unseen"] = True


def replay(events: DataFrame, corrector: TableCorrector | None = None, vietnamese: bool = True, ordered: bool = False) -> DataFrame:
    """A table of events (EVENTS) to rows (OUTPUT). Users are spread by hash and each user's events pass
    in order through one state; no user's events are held in memory together. Without a corrector,
    each boundary's fix is in the column `fix`. ordered: each user's events are in one partition, in order."""
    given = corrector is None
    names = [c.split()[0] for c in EVENTS.split(", ")] + ["fix"] * given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Typing | None = None
        c = GivenCorrector() if given else corrector
        for b in batches:
            rows: list[dict] = []
            for user, seq, ts, kind, ch, *fix in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)):
                if t is None or t.user != user:
                    if t:
                        rows += _end(t)
                    t = Typing(c, user, vietnamese=vietnamese)
                if given:
                    c.given = fix[0]
                rows += t.press(seq, ts, kind, ch or "")
            yield _batch(rows)
        if t:
            yield _batch(_end(t))

    d = events.where("user is not null and seq is not null and kind is not null").selectExpr("user", "seq", "coalesce(ts, 0) as ts", "kind", "ch", *["fix"] * given)
    if not ordered:
        d = d.repartition("user").sortWithinPartitions("user", "ts", "seq")
    return d.mapInArrow(run, OUTPUT)


def _end(t: Typing) -> list[dict]:
    t.out = []
    t.flush()
    return t.out


_ARROW = pa.schema([("user", pa.string()), ("seq", pa.int64()), *((c, pa.int32() if c == "backspaces" else pa.string()) for c in COLUMNS[2:])])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def stream(events: DataFrame, corrector: TableCorrector, vietnamese: bool = True) -> DataFrame:
    """As replay, over a stream: one JSON state per user; waiting journal lines are written when no key
    has come for WAIT_SECONDS."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = Typing(corrector, key[0], json.loads(state.get[0]) if state.exists else None, vietnamese)
        rows: list[dict] = []
        if state.hasTimedOut:
            rows += _end(t)
        else:
            pdf = pd.concat(list(pdfs)).sort_values(["ts", "seq"])
            for e in pdf.itertuples(index=False):
                rows += t.press(int(e.seq), float(e.ts), e.kind, e.ch or "")
        state.update((json.dumps(t.s),))
        if t.s["waiting"]:
            state.setTimeoutDuration(WAIT_SECONDS * 1000)
        yield pd.DataFrame(rows, columns=COLUMNS)

    return events.groupBy("user").applyInPandasWithState(run, OUTPUT, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def screens(rows: DataFrame) -> DataFrame:
    """(user, seq, backspaces, text) of the actions of replay or stream."""
    return rows.where("row = 'action'").select("user", "seq", "backspaces", "text")


def two_lanes(sentences: list[list[str]], corrector: TableCorrector, keys: list[list[str]]) -> list[dict]:
    """ST11, J15: each sentence of intended words, typed as the given keys with and without a
    corrector: per word what it should be, what was shown without and with, and the outcome."""
    rows = []
    for n, (words, typed) in enumerate(zip(sentences, keys)):
        shown: list[list[str]] = []
        for lane in (TableCorrector({}), corrector):
            t, screen = Typing(lane, "sim"), []
            for w, k in enumerate(typed):
                for ch in k:
                    t.press(0, 0.0, "char", ch)
                out = t.press(0, 0.0, "space", " ")
                final = next(r["fix"] for r in out if r["row"] == "decision")
                screen.append(final)
                late = [r for r in t.s["waiting"] if r["kind"] == "LATE" and r["right"] == [final]]
                if late and w:
                    screen[w - 1] = late[-1]["fix"]
            shown.append(screen)
        for at, (intended, base, final) in enumerate(zip(words, *shown)):
            outcome = ("kept" if final == intended else "broken") if base == intended else "fixed" if final == intended else "missed" if final == base else "wrong"
            rows.append({"sentence": n, "at": at, "intended": intended, "baseline": base, "shown": final, "outcome": outcome})
    return rows
