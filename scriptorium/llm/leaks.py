"""Evaluation texts leaking into training text (problem 8).

A document leaks an item if it holds ``window`` consecutive words of the item's text with at most ``errors`` words
inserted, deleted or replaced. Words are those of the text's form (see ``form``), case folded.

Method: pigeonhole edit matching. The items' words are cut into pieces of
q = (window + 1) // (errors + 2) words each, so that any window of an item holds errors + 1 whole pieces, of which
an occurrence with at most ``errors`` errors leaves one untouched. An Aho-Corasick automaton over all different pieces
finds their exact hits in one pass over a document. A hit is grown to both sides as far as the words agree, and on across ``errors``
differences; one that cannot reach a window is dropped. Around every other hit the item's windows are verified
against the document's words with Myers' bit-parallel distance.

The items are worked through in chunks of ``max_item_chars`` characters, each broadcast on its own and met in a pass over the documents: one
pass for any held-out set below that size. The driver holds one chunk at a time, a worker builds an automaton once.

Defined cases: null and wordless texts and items leak nothing; items shorter than the window cannot leak; an item id
that comes with several texts leaks if one of them does; repeated rows give one row.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import ship_package, spread
from .form import to_form
from .records import words_of

WINDOW = 12


class Pieces:
    """The items' words and the automaton over their pieces."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int, errors: int) -> None:
        import ahocorasick

        self.window, self.errors = window, errors
        self.q = (window + 1) // (errors + 2)
        if self.q < 1:
            raise ValueError("the window is too short for so many errors")
        self.items = items
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, words) in enumerate(items):
            if len(words) < window:
                continue
            for i in range(0, len(words) - self.q + 1, self.q):
                where[" " + " ".join(words[i : i + self.q]) + " "].append((k, i))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, words: list[str]) -> dict[int, tuple[int, int, int]]:
        """For each item that leaks: fewest errors in a window, and the widest run (words) found exactly, and hits."""
        found: dict[int, tuple[int, int, int]] = {}
        if len(words) < self.window - self.errors or not len(self.automaton):
            return found
        line = " " + " ".join(words) + " "
        start_of: dict[int, int] | None = None
        # per diagonal, where in the item the last run ends that needs no further look, and that counts as one hit
        done: dict[tuple[int, int], int] = {}
        counted: dict[tuple[int, int], int] = {}
        for end, (size, places) in self.automaton.iter(line):
            if start_of is None:
                start_of, at = {}, 0
                for n, w in enumerate(words):
                    start_of[at] = n
                    at += len(w) + 1
            d = start_of[end - size + 1]
            for k, i in places:
                item, own = self.items[k]
                if i < done.get((k, d - i), 0):
                    continue  # another piece of the same run
                lo, hi = 0, self.q
                while d - lo > 0 and i - lo > 0 and words[d - lo - 1] == own[i - lo - 1]:
                    lo += 1
                while d + hi < len(words) and i + hi < len(own) and words[d + hi] == own[i + hi]:
                    hi += 1
                run = lo + hi
                if run >= self.window or not self.errors:
                    done[k, d - i] = i + hi  # a shorter run's pieces stand in different windows: each is verified
                if run < self.window and not self._reaches(words, own, d, i, lo, hi):
                    continue
                best = self._verify(words, d, own, i)
                if best > self.errors:
                    continue
                old = found.get(item, (best, run, 0))
                found[item] = (min(old[0], best), max(old[1], run), old[2] + (i >= counted.get((k, d - i), 0)))
                if run > 2 * self.q:
                    counted[k, d - i] = i + hi
        return found

    def _reaches(self, words: list[str], own: list[str], d: int, i: int, lo: int, hi: int) -> bool:
        """Whether the run of hi words from (d, i) and lo before it can be part of a window within the errors."""
        lack, e = self.window - lo - hi, self.errors
        if e == 1 and lack > 1:  # most hits end here: no word agrees behind the one difference, on either side
            w, o = words[max(0, d - lo - 2) : d - lo], own[max(0, i - lo - 2) : i - lo]
            v, x = words[d + hi : d + hi + 2], own[i + hi : i + hi + 2]
            if len(w) == len(o) == len(v) == len(x) == 2 and w[0] not in o and w[1] != o[0] and v[1] not in x and v[0] != x[1]:
                return False
        for k in range(e + 1):
            ahead = _reach(words, d - lo - 1, own, i - lo - 1, -1, k, lack)
            if ahead >= lack or ahead + _reach(words, d + hi, own, i + hi, 1, e - k, lack) >= lack:
                return True
        return False

    def _verify(self, words: list[str], d: int, own: list[str], i: int) -> int:
        """Fewest errors with which a window of the item around its piece stands around the hit."""
        best = self.errors + 1
        for s in range(max(0, i + self.q - self.window), min(i, len(own) - self.window) + 1):
            ahead = i - s
            text = words[max(0, d - ahead - self.errors) : d - ahead + self.window + self.errors]
            best = min(best, infix_distance(own[s : s + self.window], text))
            if not best:
                break
        return best


def _reach(words: list[str], d: int, own: list[str], i: int, step: int, errors: int, most: int) -> int:
    """How many words of the item, ``most`` at most, follow each other from place i in one direction, with so many errors, from place d on."""
    n = 0
    while n < most and 0 <= i < len(own) and 0 <= d < len(words) and words[d] == own[i]:
        i, d, n = i + step, d + step, n + 1
    if n >= most or not errors:
        return n
    best = n + _reach(words, d + step, own, i, step, errors - 1, most - n)
    if 0 <= i < len(own):
        for at in (d + step, d):  # replaced, left out
            best = max(best, n + 1 + _reach(words, at, own, i + step, step, errors - 1, most - n - 1))
    return best


def infix_distance(pattern: list[str], text: list[str]) -> int:
    """Fewest edits between the pattern and any stretch of the text (Myers)."""
    places: dict[str, int] = {}
    for i, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << i
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = mask, 0, m
    best = m
    for w in text:
        eq = places.get(w, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        hp = down | ~(diag | up) & mask
        hn = up & diag
        score += bool(hp & high) - bool(hn & high)
        best = min(best, score)
        hp = hp << 1 & mask
        up = (hn << 1 | ~(diag | hp)) & mask
        down = hp & diag
    return best


_PIECES: dict[str, Pieces] = {}


def _pieces(key: str, items: list, window: int, errors: int) -> Pieces:
    if key not in _PIECES:
        _PIECES.clear()  # a worker keeps one automaton
        _PIECES[key] = Pieces(items, window, errors)
    return _PIECES[key]


def leaked_items(documents: DataFrame, items: DataFrame, *, errors: int = 0, window: int = WINDOW, text: str = "text", id_column: str = "doc_id", item_text: str = "text", item_id: str = "item_id", max_item_chars: int = 8_000_000) -> DataFrame:
    """``doc_id, item_id, errors, longest_run, hits`` for every document and item that leaked into it."""
    spark = documents.sparkSession
    ship_package(spark)
    kind, item_kind = dict(documents.dtypes)[id_column], dict(items.dtypes)[item_id]
    arrow_item = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
    known = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null").distinct()
    rows = spread(documents.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{id_column}`").isNotNull()).select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))

    def scan(chunk: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(chunk)
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = _pieces(key, sent.value, window, errors)
            for b in batches:
                take, out = [], [[], [], [], []]
                for n, t in enumerate(b.column(1).to_pylist()):
                    for item, got in pieces.find(words_of(to_form(t)[0])).items():
                        take.append(n)
                        for o, v in zip(out, (item, *got), strict=True):
                            o.append(v)
                kinds = [arrow_item, pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], names=["doc_id", "item_id", "errors", "longest_run", "hits"])

        return rows.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, errors int, longest_run int, hits int")

    parts: list[DataFrame] = []
    chunk: list = []
    size = 0
    for r in known.orderBy("id", "text").toLocalIterator():
        chunk.append((r["id"], words_of(to_form(r["text"])[0])))
        size += len(r["text"])
        if size > max_item_chars:
            parts.append(scan(chunk))
            chunk, size = [], 0
    if chunk or not parts:
        parts.append(scan(chunk))
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("doc_id", "item_id").agg(F.min("errors").alias("errors"), F.max("longest_run").alias("longest_run"), F.sum("hits").alias("hits"))
