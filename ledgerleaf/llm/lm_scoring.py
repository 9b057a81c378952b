"""LM scoring: an interpolated modified Kneser-Ney trigram model, counted in Spark, kept as sorted hash arrays that
workers map into memory.

Tokens are lower-cased (A-Z) words between white space and one end per text; before a text stand two starts.

    P(w | u v) = max(c(u v w) - D(c), 0) / c(u v) + g(u v) * P(w | v)     g(u v) = (D1 n1 + D2 n2 + D3 n3)(u v) / c(u v)
    P(w | v)   = max(a(v w) - E(a), 0) / a(v)     + g(v) * P(w)           g(v)   = (E1 n1 + E2 n2 + E3 n3)(v) / a(v)
    P(w)       = max(b(w) - F(b), 0) / B          + (F1 m1 + F2 m2 + F3 m3) / B / (V + 1)

c counts trigrams and their contexts, a(v w) the distinct words before v w and a(v) their sum, b(w) the distinct words
before w and B their sum; nk are the followers counted k times (3: or more), mk the words with b = k; each level's
discounts follow from its counts of counts. An unseen context gives the level below.

1. Words are counted per task, then per word, and written as sorted shards; a word's place is its number.
2. Trigrams are counted per task, as numbers, and dealt by their middle word to shards, packed as sorted differences: so
   a shard holds all that follows its contexts u v and all that precedes its pairs v w. A middle word with more
   trigrams than a shard should hold is spread over several by the first word; its pairs are then partial and meet
   in a second, small step.
3. A task writes the shard's trigrams, contexts and pairs as sorted hashes (46 bits: 14 choose a bucket, 32 stand in
   it) with one byte a count (rare larger ones beside), and tells what it adds to the numbers of each word; these are
   added up per shard of words.
4. Texts are scored in batches: distinct words, pairs, contexts and trigrams of a batch are looked up in the mapped files.

The files lie in the shared folder. Where that is no local path, a worker copies a file into a nameless temporary file
and maps that. File names are new for each model and writing ends with a rename, so a task that runs again writes the
same file; a lost executor loses nothing that it had written. All counts cover all training rows.

Defined results: a null or empty text is one end token; a null doc_id is scored and never learnt from; without
training rows every token has probability 1 (V = 0). Repeated rows are learnt each time and each get their row. An
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.shared import give_back, lower_ascii, mix, text_chunks, word_hashes, written
from ledgerleaf.sources.scratch import new_folder

END = np.uint64(0xA0761D6478BD642F)
#: Trigrams and words that a shard should hold; tokens that a task holds before it merges them, and hands them on.
TRIGRAMS_A_SHARD, WORDS_A_SHARD = 1_000_000, 1_000_000
HELD_IN_TASK = 750_000
LARGE, BUCKETS = 255, 14
#: Maps that a worker keeps; Linux allows 65530 a process.
MAPS = 32_768
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def save_array(uri: str, values: np.ndarray) -> None:
    where, path = _place(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(own := f"{path}.{uuid.uuid4().hex}") as out:
        out.write(np.ascontiguousarray(values).data)
    where.move(own, path)


def map_array(uri: str, kind: type) -> np.ndarray:
    where, path = _place(uri)
    if isinstance(where, fs.LocalFileSystem):
        with open(path, "rb") as own:
            return _mapped(own.fileno(), kind)
    with tempfile.TemporaryFile() as own, where.open_input_stream(path) as source:
        while part := source.read(1 << 24):
            own.write(part)
        own.flush()
        return _mapped(own.fileno(), kind)


def _mapped(file: int, kind: type) -> np.ndarray:
    """The mapped file as an array; the map keeps no descriptor, so maps are not bounded by the limit of open files."""
    if not os.fstat(file).st_size:
        return np.zeros(0, kind)
    return np.frombuffer(mmap.mmap(file, 0, access=mmap.ACCESS_READ, trackfd=False), kind)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bounds): every text's word hashes and its end."""
    words, bounds = word_hashes(lower_ascii(data), offsets)
    rows = len(bounds) - 1
    out_bounds = bounds + np.arange(rows + 1)
    out = np.full(len(words) + rows, END)
    inside = np.ones(len(out), bool)
    inside[out_bounds[1:] - 1] = False
    out[inside] = words
    return out, out_bounds


def before(numbers: np.ndarray, bounds: np.ndarray, start: int, back: int) -> np.ndarray:
    """What stands ``back`` places before each token of its text; ``start`` where nothing does."""
    out = np.concatenate([np.full(back, start, numbers.dtype), numbers])[: len(numbers)]
    for k in range(back):
        at = bounds[:-1] + k
        out[at[at < bounds[1:]]] = start
    return out


def key_of(*numbers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two or three word numbers."""
    out = np.full(len(numbers[0]), np.uint64(len(numbers)))
    for x in numbers:
        out = mix(out * _ODD + x.astype(np.uint64))
    return out


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, firsts): how to sort by ``key`` and where each distinct one begins then."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, each column summed by key."""
    order, first = _grouped(keys)
    return keys[order[first]], *(np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns)


def _tally(values: np.ndarray) -> list[int]:
    return [int((values == k).sum()) for k in (1, 2, 3, 4)]


def _kinds(values: np.ndarray) -> list[np.ndarray]:
    return [(values == k).astype(np.int64) for k in (1, 2)] + [(values > 2).astype(np.int64)]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    ratio = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a else k * 0.5
    return ratio(1, n1, n2), ratio(2, n2, n3), ratio(3, n3, n4)


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, the lowest of all first: what is zero compresses to nothing."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def save_table(uri: str, key: np.ndarray, counts: np.ndarray | None = None) -> None:
    """Sorted distinct keys: where each bucket begins, what of the key stands in it, and their counts."""
    save_array(f"{uri}.starts", np.searchsorted(key >> np.uint64(64 - BUCKETS), np.arange((1 << BUCKETS) + 1, dtype=np.uint64)).astype(np.uint32))
    save_array(f"{uri}.low", (key >> np.uint64(32 - BUCKETS)).astype(np.uint32))
    if counts is not None:
        large = np.flatnonzero(counts >= LARGE)
        for end, values in (("count", np.minimum(counts, LARGE).astype(np.uint8)), ("large_at", large.astype(np.int64)), ("large", counts[large].astype(np.int64))):
            save_array(f"{uri}.{end}", values)


def find(starts: np.ndarray, low: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of keys in a table: halving within the buckets, side by side."""
    if not len(low):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    bucket, want = (key >> np.uint64(64 - BUCKETS)).astype(np.int64), (key >> np.uint64(32 - BUCKETS)).astype(np.uint32)
    lo, end = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
    hi, last = end, len(low) - 1
    for _ in range(int((end - lo).max(initial=0)).bit_length()):
        middle = (lo + hi) >> 1
        less = low[np.minimum(middle, last)] < want
        open_ = lo < hi
        lo, hi = np.where(open_ & less, middle + 1, lo), np.where(open_ & ~less, middle, hi)
    at = np.minimum(lo, last)
    return at, (lo < end) & (low[at] == want)


TABLE = (("starts", np.uint32), ("low", np.uint32))
COUNTED = (*TABLE, ("count", np.uint8), ("large_at", np.int64), ("large", np.int64))
WORDS = (("hash", np.uint64), ("count", np.int64))
NUMBERS = (("b", np.uint32), ("total", np.int64), ("n1", np.uint32), ("n2", np.uint32), ("n3", np.uint32))


@dataclass
class Model:
    """Where the files are and the model's constants; small whatever the corpus."""

    folder: str
    total: int = 0
    vocabulary: int = 0
    #: Number of the first word of each shard of words, and the number of all.
    firsts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    shards: int = 1
    #: Middle words that are spread, sorted, and over how many shards; shards of their pairs.
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    hot_shards: int = 1
    d: tuple[float, ...] = (0.0,) * 4
    e: tuple[float, ...] = (0.0,) * 4
    f: tuple[float, ...] = (0.0,) * 4
    all_b: int = 1
    unknown: float = 1.0
    mapped: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "mapped": {}}

    @property
    def start(self) -> int:
        """The number that stands for the start: none of a word."""
        return self.vocabulary

    def files(self, name: str, parts: tuple[tuple[str, type], ...]) -> tuple[np.ndarray, ...]:
        if name not in self.mapped:
            if sum(map(len, self.mapped.values())) >= MAPS:
                self.mapped.clear()
            self.mapped[name] = tuple(map_array(f"{self.folder}/{name}.{end}", kind) for end, kind in parts)
        return self.mapped[name]

    def is_hot(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether, place in ``hot``) of middle words."""
        if not len(self.hot):
            return np.zeros(len(v), bool), np.zeros(len(v), np.int64)
        at = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
        return self.hot[at] == v, at

    def shard_of(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        salt = np.zeros(len(u), np.uint64)
        is_hot, at = self.is_hot(v)
        salt[is_hot] = mix(u[is_hot].astype(np.uint64) + _ODD) % self.spread[at[is_hot]] + np.uint64(1)
        return (mix(v.astype(np.uint64) * _ODD + mix(salt)) % np.uint64(self.shards)).astype(np.int32)

    def part_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(len(self.firsts) - 1) >> np.uint64(32)).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of sorted distinct words; an unseen one has the number -1."""
        out, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        part = self.part_of(hashes)
        for p in np.unique(part).tolist():
            here = np.flatnonzero(part == p)
            known, c = self.files(f"word-{p}", WORDS)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[here]), len(known) - 1)
                hit = known[at] == hashes[here]
                out[here[hit]], count[here[hit]] = at[hit] + self.firsts[p], c[at[hit]]
        return out, count

    def of_words(self, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """b, a and n1, n2, n3 of sorted word numbers; of one that is none: zeros."""
        out = [np.zeros(len(number), np.int64) for _ in NUMBERS]
        part = np.searchsorted(self.firsts, number, side="right") - 1
        for p in np.unique(part[(number >= 0) & (number <= self.start)]).tolist():
            name, shift = (f"stat-{p}", self.firsts[p]) if p < len(self.firsts) - 1 else ("stat-start", self.start)
            here = np.flatnonzero((part == p) & (number >= 0))
            for own, values in zip(out, self.files(name, NUMBERS), strict=True):
                own[here] = values[number[here] - shift]
        return tuple(out)

    def _by_shard(self, shard: np.ndarray) -> Iterator[np.ndarray]:
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        yield from np.split(order, cuts[1:]) if len(order) else ()

    def counts(self, name: str, key: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Counts of distinct keys in the tables of a name."""
        out = np.zeros(len(key), np.int64)
        for here in self._by_shard(shard):
            starts, low, count, large_at, large = self.files(f"{name}-{int(shard[here[0]])}", COUNTED)
            at, hit = find(starts, low, key[here])
            values = count[at].astype(np.int64) if len(low) else out[here]
            over = np.flatnonzero((values == LARGE) & hit)
            if len(over):
                values[over] = large[np.searchsorted(large_at, at[over])]
            out[here[hit]] = values[hit]
        return out

    def contexts(self, key: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(c, weight of the level below times c) of distinct contexts; zeros if unseen."""
        out = np.zeros((len(key), 2))
        for here in self._by_shard(shard):
            p = int(shard[here[0]])
            starts, low, code = self.files(f"context-{p}", (*TABLE, ("code", np.uint32)))
            (rows,) = self.files(f"context-{p}-rows", (("rows", np.int64),))
            at, hit = find(starts, low, key[here])
            if len(low):
                c, n1, n2, n3 = rows.reshape(-1, 4)[code[at[hit]]].T
                out[here[hit]] = np.stack([c, self.d[1] * n1 + self.d[2] * n2 + self.d[3] * n3], axis=1)
        return out[:, 0], out[:, 1]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of every text of a chunk."""
        hashes, bounds = tokens(data, offsets)
        words, at = np.unique(hashes, return_inverse=True)
        number, count = self.numbers(words)
        w, count = number[at], count[at]
        v, u = before(w, bounds, self.start, 1), before(w, bounds, self.start, 2)
        names, where = np.unique(np.append(number, self.start), return_inverse=True)
        b, total, *n = self.of_words(names)
        of_w, of_v = where[at], before(where[at], bounds, int(where[-1]), 1)
        p = np.where(b > 0, b - np.take(self.f, np.minimum(b, 3)), 0.0)[of_w] / self.all_b + self.unknown
        rest = sum(x * k for x, k in zip(self.e[1:], n, strict=True))

        def looked_up(known: np.ndarray, key: np.ndarray, ask) -> tuple[np.ndarray, ...]:
            """``ask`` of the distinct keys whose words are all known; zeros for the others."""
            chosen = np.flatnonzero(known)
            keys, one, back = np.unique(key[chosen], return_index=True, return_inverse=True)
            found = ask(keys, chosen[one])
            out = np.zeros((len(found), len(key)))
            out[:, chosen] = np.stack(found)[:, back]
            return tuple(out)

        is_hot, _ = self.is_hot(v)
        shard, pair = self.shard_of(u, v), key_of(v, w)

        def pairs(keys: np.ndarray, one: np.ndarray) -> tuple[np.ndarray]:
            out, plain, hot = np.zeros(len(keys), np.int64), np.flatnonzero(~is_hot[one]), np.flatnonzero(is_hot[one])
            out[plain] = self.counts("pair", keys[plain], self.shard_of(u[one[plain]], v[one[plain]]))
            out[hot] = self.counts("hot", keys[hot], hot_part(keys[hot], self.hot_shards))
            return (out,)

        (a,) = looked_up((v >= 0) & (w >= 0), pair, pairs)
        seen = total[of_v]
        less = np.take(self.e, np.minimum(a, 3).astype(int))
        p = np.where(seen > 0, ((a - less) + rest[of_v] * p) / np.maximum(seen, 1), p)
        c, back = looked_up((u >= 0) & (v >= 0), key_of(u, v), lambda keys, one: self.contexts(keys, shard[one]))
        (t,) = looked_up((u >= 0) & (v >= 0) & (w >= 0), key_of(u, v, w), lambda keys, one: (self.counts("three", keys, shard[one]),))
        less = np.take(self.d, np.minimum(t, 3).astype(int))
        p = np.where(c > 0, ((t - less) + back * p) / np.maximum(c, 1), p)
        base = np.log10((count + 1) / (self.total + self.vocabulary + 1))
        per_text = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every text has a token
        return np.diff(bounds), per_text((count > 0).astype(np.int64)), per_text(base), per_text(np.log10(p))


def hot_part(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _count_words(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if held:
                keys, counts = _summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held[:] = [(keys, counts)]
                if len(keys) >= least:
                    held.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "c"])

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                w, _ = tokens(data, offsets)
                held.append(_summed(w, np.ones(len(w), np.int64)))
                if sum(len(k) for k, _ in held) > HELD_IN_TASK:
                    yield from flush(HELD_IN_TASK // 2)
        yield from flush(0)
        give_back()

    return docs.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _write_words(words: DataFrame, folder: str, count: int) -> np.ndarray:
    """Write (word, c) as sorted shards by the hash's range; the number of each shard's first word, and of all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            part = ((key >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
            for p in np.unique(part).tolist():
                held.setdefault(p, []).append((key[part == p], batch.column(1).to_numpy()[part == p]))
        for p in list(held):
            key, c = (np.concatenate(x) for x in zip(*held.pop(p), strict=True))
            order = np.argsort(key)
            for end, values in (("hash", key[order]), ("count", c[order])):
                save_array(f"{folder}/word-{p}.{end}", values)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(order)], pa.int64())], ["part", "n"])

    part = F.shiftrightunsigned(F.shiftrightunsigned(F.col("word"), 32) * count, 32).cast("int")
    sizes = np.zeros(count, np.int64)
    for r in words.select("word", "c").repartitionById(count, part).mapInArrow(run, "part int, n long").collect():  # a row a shard
        sizes[r.part] = r.n
    for p in np.flatnonzero(sizes == 0).tolist():
        save_array(f"{folder}/word-{p}.hash", np.zeros(0, np.uint64))
        save_array(f"{folder}/word-{p}.count", np.zeros(0, np.int64))
    return np.concatenate([[0], np.cumsum(sizes)])


def _deal(docs: DataFrame, model: Model) -> DataFrame:
    """(shard, v, v_runs, u, u_runs, w, c): packed arrays of a task's distinct trigrams, by shard, v, u and w."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def packs(v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> Iterator[tuple]:
        shard = shared.value.shard_of(u, v)
        order = np.lexsort((w, u, v, shard))
        v, u, w, c, shard = v[order], u[order], w[order], c[order], shard[order]
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
            x, y = v[a:b], u[a:b]
            new_v = np.concatenate([[True], x[1:] != x[:-1]])
            first = np.flatnonzero(new_v | np.concatenate([[True], y[1:] != y[:-1]]))
            top = np.flatnonzero(new_v[first])
            # u ascends below each v: differences, but the first of each v as it is.
            steps = np.diff(y[first], prepend=0)
            steps[top] = y[first][top]
            yield int(shard[a]), _packed(np.diff(x[first][top], prepend=0)), _packed(np.diff(top, append=len(first))), _packed(steps), _packed(np.diff(first, append=b - a)), _packed(w[a:b]), _packed(c[a:b])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> None:
            v, u, w, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order, first = _grouped(key_of(u, v, w))
            one = order[first]
            held[:] = [(v[one], u[one], w[one], np.add.reduceat(c[order], first))]

        def flush() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*packs(*held.pop()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(x, pa.binary()) for x in columns[1:])], ["shard", "v", "v_runs", "u", "u_runs", "w", "c"])

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                hashes, bounds = tokens(data, offsets)
                words, at = np.unique(hashes, return_inverse=True)
                w = model.numbers(words)[0].astype(np.uint32)[at]
                held.append((before(w, bounds, model.start, 1), before(w, bounds, model.start, 2), w, np.ones(len(w), np.uint32)))
                if sum(len(x[0]) for x in held) > 2 * HELD_IN_TASK:
                    merged()
                    if len(held[0][0]) > HELD_IN_TASK:
                        yield from flush()
        if held:
            merged()
            yield from flush()
        give_back()

    return docs.select("text").mapInArrow(run, "shard int, v binary, v_runs binary, u binary, u_runs binary, w binary, c binary")


#: What tasks tell: numbers of words as middle words, as last words, partial pairs of spread words, and counts of counts.
FIRST, LAST, HOT, THREES, PAIRS = range(5)
TOLD = "kind int, part int, ids binary, n0 binary, n1 binary, n2 binary, n3 binary, t array<long>"
_TOLD_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.int64())]


def _told(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in TOLD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TOLD_TYPES, strict=True)], names)


def _pair_rows(model: Model, v: np.ndarray, w: np.ndarray, a: np.ndarray) -> list[tuple]:
    """What complete pairs add to the numbers of their words, by shard of words."""
    rows: list[tuple] = [(PAIRS, 0, None, None, None, None, None, _tally(a))]
    for kind, (ids, *numbers) in ((FIRST, _summed(v, a, *_kinds(a))), (LAST, _summed(w, np.ones(len(w), np.int64)))):
        part = np.searchsorted(model.firsts, ids, side="right") - 1
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(ids)], strict=True):
            values = [_packed(x[lo:hi]) for x in numbers]
            rows.append((kind, int(part[lo]), _packed(np.diff(ids[lo:hi], prepend=0)), *values, *[None] * (4 - len(values)), None))
    return rows


def _write_shards(packed: DataFrame, model: Model) -> DataFrame:
    """Merge and write the shards of trigrams; rows of ``TOLD``."""
    shared = packed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                shard, *columns = (c[i].as_py() for c in batch.columns)
                v, v_runs, u, u_runs, w, c = map(_unpacked, columns)
                top = np.concatenate([[0], np.cumsum(v_runs)[:-1]]).astype(np.int64)
                whole = np.cumsum(u.astype(np.int64))
                u = whole - np.repeat(whole[top] - u[top], v_runs)
                v = np.repeat(np.cumsum(v), v_runs)
                held.setdefault(shard, []).append((np.repeat(v, u_runs).astype(np.int64), np.repeat(u, u_runs), w.astype(np.int64), c.astype(np.int64)))
        for shard in list(held):
            v, u, w, c = (np.concatenate(x) for x in zip(*held.pop(shard), strict=True))
            key = key_of(u, v, w)
            order, first = _grouped(key)
            one = order[first]
            v, u, w, c = v[one], u[one], w[one], np.add.reduceat(c[order], first)
            save_table(f"{model.folder}/three-{shard}", key[one], c)
            rows: list[tuple] = [(THREES, 0, None, None, None, None, None, _tally(c))]

            key = key_of(u, v)
            order, first = _grouped(key)
            stats = np.stack([np.add.reduceat(x[order], first) for x in (c, *_kinds(c))], axis=1)
            _, at, code = np.unique(key_of(*stats.T[:3]) + mix(stats[:, 3].astype(np.uint64)), return_index=True, return_inverse=True)
            save_table(f"{model.folder}/context-{shard}", key[order[first]])
            save_array(f"{model.folder}/context-{shard}.code", code.astype(np.uint32))
            save_array(f"{model.folder}/context-{shard}-rows.rows", stats[at].astype(np.int64))

            key = key_of(v, w)
            order, first = _grouped(key)
            one, a = order[first], np.diff(first, append=len(key))  # distinct trigrams: one for each word before
            hot, _ = model.is_hot(v[one])
            save_table(f"{model.folder}/pair-{shard}", key[one][~hot], a[~hot])
            rows += _pair_rows(model, v[one][~hot], w[one][~hot], a[~hot])
            if hot.any():
                rows.append((HOT, 0, _packed(v[one][hot]), _packed(a[hot]), _packed(w[one][hot]), None, None, None))
            yield _told(rows)
        give_back()

    return packed.repartitionById(model.shards, F.col("shard")).mapInArrow(run, TOLD)


def _hot_pairs(told: DataFrame) -> DataFrame:
    """(v, w, a) of the pairs of spread middle words, added up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(_unpacked(batch.column(k)[i].as_py()).astype(np.int64)) for k in range(3)], ["v", "a", "w"])

    rows = told.where(F.col("kind") == HOT).select("ids", "n0", "n1").mapInArrow(run, "v long, a long, w long")
    return rows.groupBy("v", "w").agg(F.sum("a").alias("a"))


def _write_hot(pairs: DataFrame, model: Model) -> DataFrame:
    """Write the complete pairs of spread middle words by the range of their hash; rows of ``TOLD``."""
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = key_of(*(batch.column(k).to_numpy().astype(np.uint64) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hot_part(key, shared.value.hot_shards))], ["v", "w", "a", "part"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            for p in np.unique(columns[3]).tolist():
                held.setdefault(p, []).append(tuple(c[columns[3] == p] for c in columns[:3]))
        for p in list(held):
            v, w, a = (np.concatenate(x) for x in zip(*held.pop(p), strict=True))
            key = key_of(v, w)
            order = np.argsort(key)
            save_table(f"{shared.value.folder}/hot-{p}", key[order], a[order])
            yield _told(_pair_rows(shared.value, v, w, a))

    return pairs.select("v", "w", "a").mapInArrow(placed, "v long, w long, a long, part long").repartitionById(model.hot_shards, F.col("part").cast("int")).mapInArrow(run, TOLD)


def _write_numbers(told: DataFrame, model: Model) -> list[int]:
    """Add up the numbers of each shard of words and write them; sum of b and the words with b = 1, 2, 3, 4 and over 2."""
    shared = told.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                kind, p, ids, *packed = (c[i].as_py() for c in batch.columns[:7])
                size = int(model.firsts[p + 1] - model.firsts[p]) if p < len(model.firsts) - 1 else 1
                own = held.setdefault(p, [np.zeros(size, np.int64) for _ in NUMBERS])
                at = np.cumsum(_unpacked(ids).astype(np.int64)) - (model.firsts[p] if p < len(model.firsts) - 1 else model.start)
                for k, x in enumerate(packed if kind == FIRST else packed[:1], 1 if kind == FIRST else 0):
                    own[k][at] += _unpacked(x)
        for p, own in held.items():
            for (end, kind), values in zip(NUMBERS, own, strict=True):
                save_array(f"{model.folder}/stat-{p if p < len(model.firsts) - 1 else 'start'}.{end}", values.astype(kind))
            b = own[0]
            yield pa.RecordBatch.from_arrays([pa.array([int(b.sum())]), pa.array([[*_tally(b), int((b > 2).sum())]], pa.list_(pa.int64()))], ["b", "t"])

    parts = len(model.firsts)
    rows = told.where(F.col("kind").isin(FIRST, LAST)).repartitionById(parts, F.col("part"))
    found = rows.mapInArrow(run, "b long, t array<long>").agg(F.coalesce(F.sum("b"), F.lit(0)), *(F.coalesce(F.sum(F.col("t")[k]), F.lit(0)) for k in range(5))).first()
    return list(found)


def train(docs: DataFrame) -> Model:
    """Learn from all rows of ``docs`` (text)."""
    spark = docs.sparkSession
    folder = new_folder(spark, "lm")
    words = written(_count_words(docs), f"{folder}/counted")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("v")).first()
    model = Model(folder, sums.total, sums.v)
    if not sums.total:
        return model
    model.firsts = _write_words(words, folder, max(1, math.ceil(sums.v / WORDS_A_SHARD)))
    model.shards = max(1, math.ceil(sums.total / TRIGRAMS_A_SHARD))
    # At most as many as shards: middle words with more trigrams than one should hold. The end is none, and the start
    # has but one context, whose followers are merged in the tasks first.
    busy = words.where((F.col("c") > TRIGRAMS_A_SHARD) & (F.col("word") != int(END.view(np.int64)))).collect()
    hashes = np.array([r.word for r in busy], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    hot = dict(zip(model.numbers(hashes[order])[0].tolist(), [busy[k].c for k in order.tolist()], strict=True))
    model.hot = np.array(sorted(hot), np.int64)
    model.spread = np.array([min(model.shards, math.ceil(4 * hot[k] / TRIGRAMS_A_SHARD)) for k in sorted(hot)], np.uint64)
    told = written(_write_shards(_deal(docs, model), model), f"{folder}/told")
    if len(model.hot):
        pairs = written(_hot_pairs(told), f"{folder}/hot-pairs")
        model.hot_shards = max(1, math.ceil(pairs.count() / TRIGRAMS_A_SHARD))
        told = told.unionAll(written(_write_hot(pairs, model), f"{folder}/told-hot"))
    tallies = {r.kind: r.t for r in told.where(F.col("t").isNotNull()).groupBy("kind").agg(F.array(*(F.sum(F.col("t")[k]) for k in range(4))).alias("t")).collect()}
    model.d, model.e = ((0.0, *_discounts(tallies[k])) for k in (THREES, PAIRS))
    model.all_b, *m, more = _write_numbers(told, model)
    model.f = (0.0, *_discounts(m))
    model.unknown = (model.f[1] * m[0] + model.f[2] * m[1] + model.f[3] * more) / model.all_b / (model.vocabulary + 1)
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10) and perplexity of every whole text of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1), 2 << 20):
                if shared.value.total:
                    n, known, base, score = shared.value.score(data, offsets)
                else:
                    n = np.diff(tokens(data, offsets)[1])
                    known, base, score = np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), *map(pa.array, (n, known, base, score, 10.0 ** (-score / n)))], ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")
