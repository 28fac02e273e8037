"""Passages of test items in a large corpus, by a positional inverted index (problem 6).

`build_index` turns the corpus into blocks of documents. A block numbers the words of its documents
through, with a gap after each document, and stores for each term the positions where it stands:
one row (block, term, n, postings). The rows are written as a table to the shared folder, so one
index serves any number of searches and a lost executor costs nothing already built.

`search` cuts the items into runs of `least` words (a shorter item is one run) and files each run
under its rarest term in the corpus. One scan of the index takes the posting lists of the items'
terms. A block looks only at runs whose rarest term it holds, drops those that miss another term,
and intersects the lists of the rest, shifted by the term's place in the item, from the rarest on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small, write_table
from .words import hashes_of, slices

#: Items searched for in one pass over the index, some 50 MB of plan; more are searched in further passes.
ITEMS_PER_PASS = 100_000
#: Terms of a pass that are broadcast, as one long each; more are joined by a shuffle.
BROADCAST_TERMS = 4_000_000
#: The term of a block's first row, which holds its documents and where they begin.
HEAD = 0
INDEX = "block long, term long, n int, postings binary"


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, first = hashes_of(texts)
    return np.where(words == HEAD, 1, words), first


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    names = ["block", "term", "n", "postings"]
    for batch in batches:
        for part in slices(batch, "text"):
            words, first = _terms(part.column(1))
            sizes = np.diff(first)
            place = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)  # a gap after each document
            order = np.argsort(words, kind="stable")
            terms, at = np.unique(words[order], return_index=True)  # HEAD is no word's hash: see _terms
            ends = np.append(at[1:], len(words)) if len(terms) else np.zeros(0, np.int64)
            block = (task << 32) + number
            number += 1
            ids = np.asarray(part.column(0), np.int64)
            docs = np.concatenate([ids, (first[:-1] + np.arange(len(sizes))).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([HEAD], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([docs.tobytes()], pa.binary())], names)
            if len(terms):
                counts = np.diff(np.concatenate([[0], ends])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), block)), pa.array(terms), pa.array(counts), _packed(place[order].astype(np.int32), ends)], names)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of all documents, written to the shared folder and read back.

    Documents without an id or a text have no postings; equal ids are kept apart as documents and
    reported under their id. Texts are indexed whole."""
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null and text != ''")
    return write_table(d.mapInArrow(_invert, INDEX), "postings")


def _held(table: pa.Table, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """A block's documents, where they begin, and its posting lists by the number of the term in `wanted`."""
    lists, ids, begins = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
    terms = np.asarray(table.column("term"))
    for term, at, raw in zip(terms.tolist(), np.searchsorted(wanted, terms).tolist(), table.column("postings").to_pylist()):
        if term == HEAD:
            docs = np.frombuffer(raw, np.int64)
            ids, begins = docs[: len(docs) // 2], docs[len(docs) // 2 :]
        else:
            lists[at] = np.frombuffer(raw, np.int32)
    return ids, begins, lists


class _Plan:
    """The runs of a pass's items whose words the corpus holds, by rarest term."""

    def __init__(self, items: list[tuple[int, np.ndarray]], n_of: dict[int, int], least: int) -> None:
        self.wanted = np.array(sorted(n_of), np.int64)
        count = np.array([n_of[int(t)] for t in self.wanted], np.int64)
        self.ids, self.words, numbers, starts, terms, places = [], [], [], [], [], []
        for item, words in items:
            at = np.searchsorted(self.wanted, words)
            at[at == len(self.wanted)] = 0
            known = (self.wanted[at] == words) if len(self.wanted) else np.zeros(len(words), bool)
            size = min(least, len(words))
            if not size:
                continue
            span = np.arange(len(words) - size + 1)[:, None] + np.arange(size)
            whole = known[span].all(axis=1)
            if not whole.any():
                continue
            span = span[whole]
            by_count = np.take_along_axis(span, np.argsort(count[at[span]], axis=1, kind="stable"), axis=1)
            # A short run is filled up with its rarest word, which changes nothing.
            filled = np.concatenate([by_count, np.repeat(by_count[:, :1], least - size, axis=1)], axis=1)
            numbers.append(np.full(len(span), len(self.ids), np.int32))
            starts.append(span[:, 0].astype(np.int32))
            places.append(filled.astype(np.int32))
            terms.append(at[filled].astype(np.int32))
            self.ids.append(item)
            self.words.append(len(words))
        self.least = least
        if not self.ids:
            return
        terms = np.concatenate(terms)
        order = np.argsort(terms[:, 0], kind="stable")
        self.terms, self.places = terms[order], np.concatenate(places)[order]
        self.numbers, self.starts = np.concatenate(numbers)[order], np.concatenate(starts)[order]
        self.first = np.searchsorted(self.terms[:, 0], np.arange(len(self.wanted) + 1))
        self.ids, self.words = np.array(self.ids, np.int64), np.array(self.words, np.int32)
        self.wanted_used = np.unique(self.wanted[np.unique(self.terms)])


def _hold(sorted_list: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, values)
    at[at == len(sorted_list)] = len(sorted_list) - 1
    return sorted_list[at] == values


FOUND = "item_id long, doc_id long, words int, item_words int"


def _finder(plan: _Plan):
    def find(table: pa.Table) -> pa.Table:
        ids, begins, lists = _held(table, plan.wanted)
        present = np.zeros(len(plan.wanted), bool)
        present[list(lists)] = True
        here = np.flatnonzero(present)
        low, high = plan.first[here], plan.first[here + 1]
        runs = np.repeat(low, high - low) + np.arange(int((high - low).sum())) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        runs = runs[present[plan.terms[runs]].all(axis=1)]
        hits, at = [], []
        for run in runs.tolist():
            terms, places = plan.terms[run].tolist(), plan.places[run].tolist()
            shift = lists[terms[0]] - places[0]
            for term, place in zip(terms[1:], places[1:]):
                shift = shift[_hold(lists[term], shift + place)]
                if not len(shift):
                    break
            else:
                hits.append(np.full(len(shift), run))
                at.append(shift)
        run = np.concatenate([np.zeros(0, np.int64), *hits]).astype(np.int64)
        shift = np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int64)
        number, start = plan.numbers[run].astype(np.int64), plan.starts[run].astype(np.int64)
        order = np.lexsort((start, shift, number))
        number, start, shift = number[order], start[order], shift[order]
        # Runs that follow one another at one alignment are one longer run.
        new = np.ones(len(number), bool)
        new[1:] = (number[1:] != number[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(number))) + np.minimum(plan.words[number[first]], plan.least) - 1
        doc = ids[np.searchsorted(begins, shift[first] + start[first], "right") - 1] if len(first) else np.zeros(0, np.int64)
        out = pa.table({"item_id": pa.array(plan.ids[number[first]]), "doc_id": pa.array(doc), "words": pa.array(length.astype(np.int32)), "item_words": pa.array(plan.words[number[first]])})
        best = out.group_by(["item_id", "doc_id"]).aggregate([("words", "max"), ("item_words", "max")])
        return best.rename_columns(["item_id", "doc_id", "words", "item_words"]).select(["item_id", "doc_id", "words", "item_words"])

    return find


def _near_finder(plan: list[tuple[int, list[int]]], wanted: np.ndarray, need: int, span: int):
    """plan: item id and its rarest terms, of which `need` must stand within `span` words, in any order."""
    numbered = [(item, np.searchsorted(wanted, terms).tolist()) for item, terms in plan]
    by_anchor: dict[int, list[int]] = {}
    for k, (_, terms) in enumerate(numbered):
        for t in terms[: len(terms) - need + 1]:  # one of these is among any `need` of them
            by_anchor.setdefault(t, []).append(k)

    def find(table: pa.Table) -> pa.Table:
        ids, begins, lists = _held(table, wanted)
        ends = np.append(begins[1:], 1 << 40)
        found = set()
        for anchor, numbers in ((t, by_anchor[t]) for t in lists if t in by_anchor):
            for k in numbers:
                item, terms = numbered[k]
                held = [lists[t] for t in terms if t in lists]
                if len(held) < need:
                    continue
                for x in lists[anchor].tolist():
                    doc = int(np.searchsorted(begins, x, "right")) - 1
                    if (item, int(ids[doc])) in found:
                        continue
                    low, high = max(int(begins[doc]), x - span + 1), min(int(ends[doc]), x + span)
                    near = [h[np.searchsorted(h, low) : np.searchsorted(h, high)] for h in held]
                    if sum(len(h) > 0 for h in near) < need:
                        continue
                    spots = np.concatenate(near)
                    kind = np.concatenate([np.full(len(h), k) for k, h in enumerate(near)])
                    order = np.argsort(spots, kind="stable")
                    spots, kind = spots[order], kind[order]
                    left, count, there = 0, [0] * len(held), 0
                    for right in range(len(spots)):
                        there += not count[kind[right]]
                        count[kind[right]] += 1
                        while spots[right] - spots[left] >= span:
                            count[kind[left]] -= 1
                            there -= not count[kind[left]]
                            left += 1
                        if there >= need:
                            found.add((item, int(ids[doc])))
                            break
        keys = sorted(found)
        return pa.table({"item_id": pa.array([k[0] for k in keys], pa.int64()), "doc_id": pa.array([k[1] for k in keys], pa.int64())})

    return find


def _passes(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items as word hashes, at most ITEMS_PER_PASS at once."""
    d = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    slots = max(1, -(-d.count() // ITEMS_PER_PASS))
    for slot in range(slots):
        part = d.where(F.pmod(F.xxhash64("id", "text"), F.lit(slots)) == slot).toArrow().combine_chunks()
        if part.num_rows:
            words, first = _terms(part.column("text").chunk(0) if part.column("text").num_chunks else part.column("text"))
            yield [(int(i), words[a:b]) for i, a, b in zip(part.column("id").to_pylist(), first[:-1], first[1:])]


def _lists(index: DataFrame, terms: np.ndarray) -> DataFrame:
    """The rows of the index for these terms."""
    wanted = index.sparkSession.createDataFrame(pa.table({"term": pa.array(terms, pa.int64())}))
    return index.join(small(wanted, BROADCAST_TERMS), "term", "left_semi")


def _found(index: DataFrame, terms: np.ndarray, finder, schema: str) -> DataFrame:
    """One scan: the lists of the terms and each block's documents."""
    return _lists(index, np.append(terms, HEAD)).select("block", "term", "postings").groupBy("block").applyInArrow(finder, schema)


def _frequency(index: DataFrame, items: list[tuple[int, np.ndarray]]) -> dict[int, int]:
    """How often the corpus holds each of the items' words; those it lacks are left out."""
    terms = np.unique(np.concatenate([np.zeros(0, np.int64), *[w for _, w in items]]))
    return {r.term: r.n for r in _lists(index, terms).groupBy("term").agg(F.sum("n").alias("n")).collect()}


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", least: int = 8) -> DataFrame:
    """(item_id, doc_id, words, item_words): the items of which a document holds at least `least`
    successive words, with the longest such run; an item of fewer words must be held whole. Items
    without a word have no row. The frequencies collected are those of the items' own terms. Rows
    are one per pair of ids."""
    out = None
    for part in _passes(items, item_id, text):
        plan = _Plan(part, _frequency(index, part), least)
        if len(plan.ids):
            found = _found(index, plan.wanted_used, _finder(plan), FOUND)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return items.sparkSession.createDataFrame([], FOUND)
    return out.groupBy("item_id", "doc_id").agg(F.max("words").alias("words"), F.max("item_words").alias("item_words"))


def search_near(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", terms: int = 5, need: int = 4, span: int = 40) -> DataFrame:
    """(item_id, doc_id): documents where `need` of the item's `terms` rarest distinct terms stand
    within `span` words, in any order. Terms that the corpus lacks are passed over; items with
    fewer than `need` others have no row."""
    out, schema = None, "item_id long, doc_id long"
    for part in _passes(items, item_id, text):
        n_of = _frequency(index, part)
        plan = [(i, sorted({int(w) for w in words if int(w) in n_of}, key=lambda w: (n_of[w], w))[:terms]) for i, words in part]
        plan = [(i, w) for i, w in plan if len(w) >= need]
        if plan:
            wanted = np.unique(np.concatenate([w for _, w in plan])).astype(np.int64)
            found = _found(index, wanted, _near_finder(plan, wanted, need, span), schema)
            out = found if out is None else out.unionByName(found)
    return items.sparkSession.createDataFrame([], schema) if out is None else out.distinct()


def leaks_by_item(found: DataFrame) -> DataFrame:
    """Per item: the documents it leaked into, and whether any holds it whole."""
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"), F.max((F.col("words") == F.col("item_words")).cast("int")).alias("whole"))
