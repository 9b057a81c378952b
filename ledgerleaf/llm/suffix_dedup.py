"""Substring dedup: prefix-partitioned suffix trees.

Every word of a document that has ``width`` words from there on begins a suffix, of which the first ``width`` words
matter. A suffix is named by two fingerprints, of its first ``PREFIX_WORDS`` words and of all ``width``, so a tree of
suffixes has nodes at these two depths. Suffixes are dealt into groups that fit a task by prefixes of variable length:
a first pass counts them by the short prefix (in a fixed number of bins), neighbouring light bins share a group, and a
bin too large for one is split by the long prefix. Each group's subtree is built by sorting; an internal node as deep as
``width`` is a repeat, and its suffixes are marked. Runs of marked suffixes give a document's maximal repeated spans.

Documents are dealt into blocks of about ``BLOCK_BYTES``; a block sends each group its distinct suffixes, sorted, and
the group answers with a bit for each, so words never travel, a passage of any number of copies is one suffix a block,
and what a task holds is a block or a group. Both fingerprints, 96 bits, have to agree; two different windows with the
same first words are taken for equal with a probability of 2**-64.

Defined results: a null or empty text has no words and keeps the empty text; a text shorter than ``width`` words loses
none; repeated rows are each other's copies, so their windows repeat; windows never cross documents. A null doc_id is
kept. An empty table gives no rows; further columns are kept only when asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.llm.shared import _ODD, bounded_batches, give_back, mix, text_chunks, word_hashes

#: Words of the short prefix, and the bins that it is counted in.
PREFIX_WORDS, BINS = 12, 1 << 14
#: Suffixes of a group, and bytes of text of a block, about.
GROUP_SIZE, BLOCK_BYTES = 1 << 20, 4 << 20
_SHORT = np.dtype(np.uint32)
_LONG = np.dtype(np.uint64)


def suffix_codes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, short, long): for every suffix of ``width`` words or more its place among all words and its fingerprints."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.int64), np.zeros(0, _SHORT), np.zeros(0, _LONG)
    at = np.repeat(bounds[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    n = len(words) - width + 1
    code = np.zeros(n, np.uint64)
    for k in range(width):
        code = mix(code * _ODD + words[k : k + n])
        if k + 1 == min(PREFIX_WORDS, width):
            short = (code >> np.uint64(32)).astype(_SHORT)
    return at, short[at], code[at]


def distinct_suffixes(texts: pa.Array, width: int) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of a block: (parts, short, long, times, number).

    ``parts``: (first row, end row, word bounds, places, suffix numbers) of each chunk of rows; ``short`` and ``long``
    are the distinct suffixes' fingerprints, sorted, ``times`` how often each occurs, ``number`` all suffixes' places in them.
    """
    parts, shorts, longs, seen = [], [np.zeros(0, _SHORT)], [np.zeros(0, _LONG)], 0
    for lo, hi, data, offsets in text_chunks(texts):
        words, bounds = word_hashes(data, offsets)
        at, short, code = suffix_codes(words, bounds, width)
        parts.append((lo, hi, bounds, at, np.arange(seen, seen + len(at))))
        shorts.append(short)
        longs.append(code)
        seen += len(at)
    short, code = np.concatenate(shorts), np.concatenate(longs)
    order = np.lexsort((code, short))
    short, code = short[order], code[order]
    new = np.append(True, (short[1:] != short[:-1]) | (code[1:] != code[:-1])) if len(code) else np.zeros(0, bool)
    number = np.empty(len(code), np.int64)
    number[order] = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    return parts, short[new], code[new], np.diff(begins, append=len(code)), number


class Dealer:
    """Which group a suffix belongs to, from the counts of its short prefix's bin."""

    def __init__(self, counts: np.ndarray, group_size: int) -> None:
        self.parts = np.maximum(-(-counts // group_size), 1)
        light = np.where(self.parts == 1, counts, group_size)
        self.first = np.zeros(len(counts), np.int64)
        group, held = 0, 0
        for b, (parts, n) in enumerate(zip(self.parts.tolist(), light.tolist(), strict=True)):
            if held and (parts > 1 or held + n > group_size):
                group, held = group + 1, 0
            self.first[b] = group
            if parts > 1:
                group += parts
            else:
                held += n
        self.groups = group + 1

    def __call__(self, short: np.ndarray, code: np.ndarray) -> np.ndarray:
        b = bins_of(short)
        return self.first[b] + ((code >> np.uint64(8)) % self.parts[b].astype(np.uint64)).astype(np.int64)


def bins_of(short: np.ndarray) -> np.ndarray:
    return (short >> np.uint32(32 - BINS.bit_length() + 1)).astype(np.int64)


def deep_nodes(short: np.ndarray, code: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which suffixes of a group hang below an internal node as deep as the window: the subtree, by sorting.

    ``many``: suffixes that repeat within their own block.
    """
    order = np.lexsort((code, short))
    s, c, m = short[order], code[order], many[order]
    # Depth of the node where neighbouring leaves part: 0, the short prefix, or the whole window.
    shared = np.where(s[1:] != s[:-1], 0, np.where(c[1:] != c[:-1], 1, 2))
    begins = np.flatnonzero(np.append(True, shared < 2))
    sizes = np.diff(begins, append=len(c))
    deep = (sizes > 1) | np.logical_or.reduceat(m, begins)
    out = np.empty(len(c), bool)
    out[order] = np.repeat(deep, sizes)
    return out


def packed(short: np.ndarray, code: np.ndarray, many: np.ndarray) -> bytes:
    """Sorted suffixes as bytes, the short fingerprints by byte planes, as the upper ones hardly change."""
    return short.view(np.uint8).reshape(-1, 4).T.tobytes() + code.tobytes() + np.packbits(many).tobytes()


def unpacked(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    short = np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T.copy().view(_SHORT).reshape(-1)
    many = np.unpackbits(np.frombuffer(raw, np.uint8, offset=12 * n), count=n).astype(bool)
    return short, np.frombuffer(raw[4 * n : 12 * n], _LONG), many


def covered_spans(places: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal stretches of words under the windows that begin at ``places`` (ascending)."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > width)
    return list(zip(places[np.append(0, cut + 1)].tolist(), (places[np.append(cut, len(places) - 1)] + width).tolist(), strict=True))


def _count_bins(docs: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """How many suffixes each bin has, in batches' distinct ones, and the bytes of all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                words, bounds = word_hashes(data, offsets)
                _, short, code = suffix_codes(words, bounds, width)
                short = short[np.unique(code, return_index=True)[1]]
                counts += np.bincount(bins_of(short), minlength=BINS)
                size += len(data)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1), pa.int64()), pa.array(np.append(counts[full], size), pa.int64())], ["bin", "n"])

    found = docs.select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # at most BINS + 1 rows
    counts = np.zeros(BINS, np.int64)
    for r in found:
        if r.bin >= 0:
            counts[r.bin] = r.n
    return counts, sum(r.n for r in found if r.bin < 0)


def drop_repeated_spans(docs: DataFrame, width: int = 35, group_size: int = GROUP_SIZE, block_bytes: int = BLOCK_BYTES, keep: Sequence[str] = ()) -> DataFrame:
    """Remove from each text the words under windows of ``width`` words that occur elsewhere too.

    Returns doc_id, the columns ``keep``, n_words, n_removed, spans (array of start and end word of the maximal repeated
    stretches) and kept_text, the other words joined by a space.
    """
    bounded_batches(docs.sparkSession)
    counts, size = _count_bins(docs, width)
    deal = Dealer(counts, group_size)
    blocks = max(1, -(-size // block_bytes))
    # The part of the input is in the key so that equal rows of a hot document spread.
    block = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(blocks)).cast("int")
    dealt = docs.select("doc_id", *(F.col(c) for c in keep), F.coalesce("text", F.lit("")).alias("_text"), block.alias("_block")).repartition(max(1, min(blocks, 1 << 15)), "_block")
    given = [f for f in dealt.schema.fields if f.name in ("doc_id", *keep)]

    def send(key: tuple, rows: pa.Table) -> pa.Table:
        _, short, code, times, _ = distinct_suffixes(rows.column("_text").combine_chunks(), width)
        group = deal(short, code)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
        members = np.split(order, cuts[1:]) if len(cuts) else []
        packets = [packed(short[m], code[m], times[m] > 1) for m in members]
        out = [pa.array(group[order][cuts], pa.int32()), pa.array(np.full(len(cuts), key[0].as_py()), pa.int32()), pa.array([len(m) for m in members], pa.int32()), pa.array(packets, pa.binary())]
        give_back()
        return pa.table(out, ["group", "block", "n", "packet"])

    def answer(key: tuple, packets: pa.Table) -> pa.Table:
        sizes = packets.column("n").to_pylist()
        got = [unpacked(p.as_buffer().to_pybytes(), n) for p, n in zip(packets.column("packet"), sizes, strict=True)]
        deep = deep_nodes(*(np.concatenate(x) for x in zip(*got, strict=True)))
        ends = np.cumsum(sizes)
        marks = [np.packbits(deep[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        del got
        give_back()
        return pa.table([packets.column("block"), packets.column("group"), pa.array(marks, pa.binary())], ["block", "group", "marks"])

    def take(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        texts = rows.column("_text").combine_chunks()
        parts, short, code, _, number = distinct_suffixes(texts, width)
        group = deal(short, code)
        order = np.argsort(group, kind="stable")
        deep = np.zeros(len(code), bool)
        marks = dict(zip(answers.column("group").to_pylist(), answers.column("marks"), strict=True))
        for members in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else ():
            deep[members] = np.unpackbits(np.frombuffer(marks[int(group[members[0]])].as_buffer(), np.uint8), count=len(members)).astype(bool)
        n_words, spans = [], []
        for lo, hi, bounds, at, numbers in parts:
            places = at[deep[number[numbers]]]
            edges = np.searchsorted(places, bounds)
            n_words += np.diff(bounds).tolist()
            spans += [covered_spans(places[edges[i] : edges[i + 1]] - bounds[i], width) for i in range(hi - lo)]
        kept, removed = [], []
        for text, out in zip(texts, spans, strict=True):
            words, last, rest = text.as_buffer().to_pybytes().split(), 0, []
            for a, b in out:
                rest += words[last:a]
                last = b
            kept.append(b" ".join(rest + words[last:] if out else words))
            removed.append(sum(b - a for a, b in out))
        listed = [[{"start": a, "end": b} for a, b in out] for out in spans]
        made = [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(listed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string())]
        names = [f.name for f in given]
        give_back()
        return pa.table([*(rows.column(c) for c in names), *made], [*names, "n_words", "n_removed", "spans", "kept_text"])

    packets = dealt.groupBy("_block").applyInArrow(send, "group int, block int, n int, packet binary")
    answers = packets.groupBy("group").applyInArrow(answer, "block int, group int, marks binary")
    made = T._parse_datatype_string("n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string").fields
    return dealt.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(take, T.StructType([*given, *made]))
