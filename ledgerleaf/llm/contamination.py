"""Benchmark decontamination: pigeonhole edit matching.

Texts and items are lower-cased, punctuation (the Unicode categories P) goes and runs of white space become one space.
An item of nothing but punctuation is compared with the text that still has it. An item of n characters may occur in a
document with at most ``rate * n`` edits. Cut into one piece more than its error budget, an item that occurs has a
piece that occurs exactly, so an automaton over all pieces finds every candidate place. Of m neighbouring pieces with
fewer than m edits one half has fewer edits than pieces too; so from a piece that was found the halves above it are
tried in turn, each with its own share of the budget, and most chance hits end at the first, short one. Myers'
bit-parallel algorithm decides each, and at the top gives the distance of the item to the best stretch around it.

Whole texts are scanned. The benchmark's distinct texts are taken in blocks of about ``block_bytes``, chosen by hash,
each scanned against all documents in a stage of its own, so what a task holds is bounded whatever the benchmark's
size; matches get the ids of all items with that text by a join. Dropping documents writes what is left between blocks.

Defined results: a null or empty text contains nothing; an empty or null item occurs nowhere; equal items each
match, an item without an id too, as a null item_id; a repeated document matches each time it occurs; of several places of an item in a document the nearest
counts, then the first. An empty table gives no rows; extra columns are ignored unless asked for.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.llm.shared import written

RATE, BLOCK_BYTES = 0.1, 2 << 20
_IS_MARK = np.array([unicodedata.category(chr(i))[0] == "P" for i in range(sys.maxunicode + 1)])
_ASCII_MARKS = bytes(np.flatnonzero(_IS_MARK[:128]).tolist())


def spaced(text: str) -> str:
    return " ".join(text.lower().split())


def normalise(text: str) -> str:
    low = text.lower()
    if low.isascii():
        low = low.encode().translate(None, _ASCII_MARKS).decode()
    else:
        codes = np.frombuffer(low.encode("utf-32-le"), np.uint32)
        low = codes[~_IS_MARK[codes]].tobytes().decode("utf-32-le")
    return " ".join(low.split())


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length."""
    cuts = [i * len(text) // (budget + 1) for i in range(budget + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def places_of(item: str) -> dict[str, int]:
    """A bit for every place of a character."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(item: str, positions: dict[str, int], window: str, most: int, any_end: bool = False) -> tuple[int, int] | None:
    """(distance, end) of the item's nearest stretch of ``window``, the first of equals; None if over ``most``.

    ``positions``: as of ``places_of``. ``any_end``: the first stretch within ``most`` will do.
    """
    n = len(item)
    top, full = 1 << (n - 1), (1 << n) - 1
    plus, minus, score = full, 0, n
    best, end = most + 1, -1
    for at, c in enumerate(window, 1):
        eq = positions.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score < best:
            best, end = score, at
            if any_end:
                break
    return (best, end) if end >= 0 else None


def branch(number: int, n: int) -> list[tuple[int, int]]:
    """The groups of pieces, halved from all ``n`` on, that hold the piece ``number``: the pair first, all of them last."""
    lo, hi = 0, n
    out = []
    while hi - lo > 1:
        out.append((lo, hi))
        middle = (lo + hi) // 2
        lo, hi = (lo, middle) if number < middle else (middle, hi)
    return out[::-1]


def neighbour(item: str, number: int, budget: int) -> tuple[str, int, str, int] | None:
    """Of a piece that is one of a pair the halves of the other: the nearer, its place from the piece's start, the
    farther, its place. The other has one edit at most, so the nearer is unchanged, or the farther, moved by one at most.
    """
    way = branch(number, budget + 1)
    if not way or way[0][1] - way[0][0] > 2 or len(way) == 1:
        return None
    cut = lambda i: i * len(item) // (budget + 1)
    here, other = cut(number), sum(way[0]) - 1 - number
    a, b = cut(other), cut(other + 1)
    half = (a + b) // 2
    first, second = (item[a:half], a - here), (item[half:b], half - here)
    return (*first, *second) if other > number else (*second, *first)


class Matcher:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[str, str]], rate: float) -> None:
        self.items = []
        self.marks: list[tuple[str, str, int, dict[str, int]]] = []
        at: dict[str, list[tuple]] = {}
        for ident, raw in items:
            text = normalise(raw or "")
            bare = not text
            if bare and not (text := spaced(raw or "")):
                continue
            budget = int(rate * len(text))
            positions = places_of(text)
            if bare:
                self.marks.append((ident, text, budget, positions))
                continue
            for number, (offset, piece) in enumerate(pieces(text, budget)):
                at.setdefault(piece, []).append((len(self.items), number, offset, neighbour(text, number, budget)))
            self.items.append((ident, text, budget, positions))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()
        self.empty = not at
        self.kept: dict[str, dict[str, int]] = {}

    def _halves_occur(self, item: str, budget: int, number: int, text: str, at: int) -> bool:
        """Whether all groups of pieces that hold the piece ``number``, found at ``at``, but the whole item, may occur there."""
        n = budget + 1
        cut = lambda i: i * len(item) // n
        for lo, hi in branch(number, n)[:-1]:
            a, b, most = cut(lo), cut(hi), hi - lo - 1
            part = item[a:b]
            if (positions := self.kept.get(part)) is None:
                if len(self.kept) > 20_000:
                    self.kept.clear()
                positions = self.kept[part] = places_of(part)
            start = at - (cut(number) - a)
            if best_match(part, positions, text[max(0, start - most) : start + b - a + most], most, any_end=True) is None:
                return False
        return True

    def find(self, raw: str | None) -> list[tuple[str, int, int]]:
        """(item's mark, distance, end in the normalised text) of every item that occurs."""
        if not raw:
            return []
        out = []
        if self.marks:
            plain = spaced(raw)
            out = [(ident, *hit) for ident, item, budget, positions in self.marks if (hit := best_match(item, positions, plain, budget))]
        if self.empty:
            return out
        text = normalise(raw)
        best: dict[int, tuple[int, int]] = {}
        tried: dict[int, tuple[int, int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            begin = last + 1 - size
            for k, number, offset, beside in places:
                if beside:
                    near, near_at, far, far_at = beside
                    x, y = begin + near_at, begin + far_at
                    if not (x >= 0 and text.startswith(near, x)) and text.find(far, max(0, y - 1), max(0, y + len(far) + 1)) < 0:
                        continue
                if k in best and not best[k][0]:
                    continue
                _, item, budget, positions = self.items[k]
                start = begin - offset
                if start >= 0 and text.startswith(item, start):
                    best[k] = min((0, start + len(item)), best.get(k, (0, 1 << 60)))
                    continue
                lo, hi = max(0, start - budget), start + len(item) + budget
                if tried.get(k) == (lo, hi) or not self._halves_occur(item, budget, number, text, begin):
                    continue
                tried[k] = lo, hi
                if found := best_match(item, positions, text[lo:hi], budget):
                    best[k] = min((found[0], lo + found[1]), best.get(k, (1 << 60, 0)))
        return out + [(self.items[k][0], d, e) for k, (d, e) in sorted(best.items())]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's distinct texts with their SHA-256, in parts of about ``block_bytes``, one at a time on the driver."""
    texts = benchmark.select("text").where(F.col("text").isNotNull()).distinct()
    n = -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) or 1
    for i in range(n):
        if rows := texts.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).select(F.sha2("text", 256).alias("mark"), "text").collect():
            yield [(r.mark, r.text) for r in rows]


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every (doc_id, item_id) whose item occurs in the document, with the edit distance and where it ends."""
    schema = "doc_id long, mark string, distance int, end int"
    spark = docs.sparkSession

    def scan(items: list[tuple[str, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for hit in matcher.find(t.as_py())]
                if rows:
                    types = [pa.int64(), pa.string(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "mark", "distance", "end"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    parts = [scan(items) for items in _blocks(benchmark, block_bytes)]
    found = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
    ids = benchmark.where(F.col("text").isNotNull()).select(F.sha2("text", 256).alias("mark"), "item_id")
    return found.join(ids, "mark").select("doc_id", "item_id", "distance", "end")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item of the benchmark occurs."""
    at = docs.columns.index("text")
    for k, items in enumerate(_blocks(benchmark, block_bytes)):
        if k:
            docs = written(docs)  # one automaton a task at a time
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs
