"""N-gram Jaccard join: which documents share enough word shingles, and the groups they form.

A document's set is its distinct shingles, as 64-bit hashes. Two sets a and b link when |a n b| / |a u b| reaches the
threshold t, so they differ in at most (1 - t) / (1 + t) * (|a| + |b|) shingles. Sets are the nodes of the join, named
by a 64-bit hash of all their shingles: copies are one node from the start, whatever their ids.

1. Marks. One pass gives each row its set's name, size and parity bitmap; each set keeps its smallest doc_id.
2. Size-banded tiles. Sizes fall into bands. For pairs whose larger set is in a band, hashing cuts every set into
   more tiles than the pair can differ in, so a linked pair has a tile with the same content; a set emits the hash of
   each of its tiles for its own band, and for the next one if a partner could be there. Empty tiles say nothing: a
   band has spare tiles for them, and a set with more empty tiles than spares emits its first hashes besides
   (prefix filtering), which is exact for any two such sets; bands of small sets, which would need more spares than
   tiles, have prefixes alone. Frequent shingles, as of a footer that very many documents have, are in no tile and come
   last in prefixes: without them a pair differs in no more shingles than with them, and the order is the same for all
   sets, so both stay exact, and a common passage brings no documents together. Which are frequent is told by a bitmap
   of ``BINS`` bins, from counts of all sets; it only decides what is compared, never what links.
3. Stars. Sets with one tile hash are linked to the smallest of them only, first inside the scanning task, then in
   the shard of the hash, which so gets an entry per task and hash, not one per document. Entries travel packed, as
   sorted differences; the number of shards grows with the number of shingles, and a task merges its shards one by
   one, so what it holds does not grow with the corpus.
4. Signatures. Candidate pairs are compared by size and by parity bitmaps: bits that differ are a lower bound of the
   differing shingles, hence an upper bound of the overlap. Of what passes the texts are dealt by the pair's second
   set, whose shingles a task holds while those of its partners stream past; sorted arrays are intersected exactly.
   A set with very many partners has them dealt in groups of bounded size.
5. Groups. Verified links form connected components (alternating star contraction over written edges). First each
   set is held against the leader that it shares most tiles with. Then tiles that hold several components are
   compared by signatures, in blocks of bounded size, one task a pair of blocks: first only as many of the pairs that
   these allow are intersected as would connect a block, then, across what components are left, all of them. No link
   is lost, and within a component no further link can change the result.

Defined results: a null or empty text has no shingles and links with nothing; fewer words than a shingle make one
shingle of the whole sequence. Equal texts are linked. Rows that share a doc_id but not a set are different
documents, each with its own links. A row without an id gets its number of shingles, no component, and links with
nothing. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.llm.shared import bounded_batches, cut_lineage, give_back, lower_ascii, mix, text_chunks, windows, word_hashes, written

BAND_RATIO = 1.5
SIGNATURE_BITS = 512
BLOCK_ROWS = 512
#: Tile entries that a task packs at once and that a shard should hold; partners of a set that are dealt together.
HELD_ENTRIES, SHARD_ENTRIES, PARTNERS = 500_000, 500_000, 4096
#: Rows up to which a narrow table is broadcast, counted first.
BROADCAST_ROWS = 2_000_000
#: Bins in which shingles are counted, shingles after which a task hands its counts on, and from where on it does for a
#: bin; sets with a bin's shingles from which on these are frequent, or so many times the mean of all bins.
BINS, COUNTED_AT_ONCE, COUNTED_FROM, FREQUENT, TIMES_MEAN = 1 << 22, 10_000_000, 32, 1000, 16
_FEW = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text of a chunk, and their bounds."""
    words, bounds = word_hashes(lower_ascii(data), offsets)
    grams, at = windows(words, bounds, width)
    keep = np.ones(len(grams), bool)
    for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
        if b - a > 1:
            part = grams[a:b]
            part.sort()
            keep[a + 1 : b] = part[1:] != part[:-1]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return grams[keep], kept[at]


class Bands:
    """Size bands and the tiles of each, for one threshold."""

    def __init__(self, threshold: Fraction, frequent: np.ndarray | None = None) -> None:
        self.t = threshold
        self.frequent = frequent
        self.kept: dict[int, tuple[int, int]] = {}

    def band(self, size: int) -> int:
        return int(math.log(size) / math.log(BAND_RATIO) + 1e-9)

    def most_differing(self, total: int) -> int:
        return int((1 - self.t) * total / (1 + self.t))

    def tiles(self, band: int) -> tuple[int, int]:
        """(tiles, spares) for pairs whose larger set is in ``band``; no tiles where they would be mostly spares."""
        if band not in self.kept:
            high = math.ceil(BAND_RATIO ** (band + 1))
            low = max(1, int(BAND_RATIO**band * self.t))
            most = self.most_differing(2 * high)
            spares = 0
            for _ in range(20):
                n = most + 1 + spares
                empty = n * math.exp(-low / n) if most else 0
                spares = math.ceil(empty + 3 * math.sqrt(empty)) if most else 0
            self.kept[band] = (most + 1 + spares, spares) if spares <= most + 1 else (0, 0)
        return self.kept[band]

    def bands_of(self, size: int) -> tuple[int, ...]:
        own = self.band(size)
        reach = self.band(max(size, math.floor(size / self.t)))
        return tuple(range(own, reach + 1))

    def keys(self, grams: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """Tile hashes of one sorted set; ``mixed`` are the set's hashes mixed anew, whose sums stand for tiles."""
        size = len(grams)
        often = is_frequent(grams, self.frequent)
        rare, mixed = grams[~often], mixed[~often]
        first_grams = np.concatenate([rare, grams[often]])[: size - math.ceil(self.t * size) + 1]
        out = []
        for band in self.bands_of(size):
            n, spares = self.tiles(band)
            salt = np.uint64((band * 2 + 1) * int(_FEW) % (1 << 64))
            full = 0
            if n and len(rare):
                tile = ((rare >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)  # ascending with the hash
                first = np.flatnonzero(np.diff(tile, prepend=-1))
                full = len(first)
                sums = np.add.reduceat(mixed, first)
                out.append(mix(sums + tile[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt))
            if not n or n - full > spares:
                out.append(mix(first_grams ^ (salt ^ _FEW)))
        return np.concatenate(out)


def bins_of(grams: np.ndarray) -> np.ndarray:
    return ((grams >> np.uint64(8)) & np.uint64(BINS - 1)).astype(np.int64)


def is_frequent(grams: np.ndarray, frequent: np.ndarray | None) -> np.ndarray:
    """Whether shingles are in the bins of a bitmap (packed)."""
    if frequent is None:
        return np.zeros(len(grams), bool)
    at = bins_of(grams)
    return (frequent[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def signature(grams: np.ndarray) -> np.ndarray:
    """Parity bitmap: each bit is the parity of the shingles hashed to it."""
    place = (grams & np.uint64(SIGNATURE_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=SIGNATURE_BITS) & 1).astype(np.uint8)).view(np.int64)


def wide_signature(grams: np.ndarray) -> bytes:
    """A parity bitmap of two bits a shingle or more: a power of two, so that half of it folds onto the other."""
    bits = 1 << max(SIGNATURE_BITS.bit_length() - 1, (2 * len(grams) - 1).bit_length())
    return np.packbits((np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def differing_bits(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded to the length of the other."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


SIGNATURE = [f"s{i}" for i in range(SIGNATURE_BITS // 64)]


def set_names(mixed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The name of each set, from its shingles' hashes mixed anew; 0 for an empty one."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
    sizes = np.diff(bounds).astype(np.uint64)
    return np.where(sizes > 0, mix(sums[bounds[1:]] - sums[bounds[:-1]] + sizes), np.uint64(0)).view(np.int64)


def _marks(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, node, signature columns, bits) of every row; the node of an empty set is null, and so are the wide
    bitmaps of sets for which the signature does."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                grams, bounds = shingle_sets(data, offsets, width)
                sizes = np.diff(bounds)
                nodes = pa.array(set_names(mix(grams ^ _FEW), bounds), mask=sizes == 0)
                bits = np.array([signature(grams[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)])
                wide = pa.array([wide_signature(grams[a:b]) if b - a > SIGNATURE_BITS // 2 else None for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(sizes.astype(np.int64)), nodes, *(pa.array(np.ascontiguousarray(c)) for c in bits.T), wide], ["doc_id", "n", "node", *SIGNATURE, "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n long, node long, {', '.join(f'{s} long' for s in SIGNATURE)}, bits binary")


def frequent_shingles(docs: DataFrame, width: int, least: int = FREQUENT, counted_from: int = COUNTED_FROM) -> np.ndarray | None:
    """A bitmap of the bins that very many sets have shingles in; None if there are none.

    Of each task's sets the distinct ones are counted; bins that a task has seen few in don't count.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, seen = np.zeros(BINS, np.int32), 0, set()

        def told() -> pa.RecordBatch:
            full = np.flatnonzero(counts >= counted_from)
            return pa.RecordBatch.from_arrays([pa.array(np.append(full, -1), pa.int64()), pa.array(np.append(counts[full], held), pa.int64())], ["bin", "n"])

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                grams, bounds = shingle_sets(data, offsets, width)
                names = set_names(mix(grams ^ _FEW), bounds).tolist()
                new = np.zeros(len(names), bool)
                for i, name in enumerate(names):
                    if name not in seen:
                        seen.add(name)
                        new[i] = True
                grams = grams[np.repeat(new, np.diff(bounds))]
                at, n = np.unique(bins_of(grams), return_counts=True)
                counts[at] += n.astype(np.int32)
                held += len(grams)
                if held > COUNTED_AT_ONCE:
                    yield told()
                    counts[:], held = 0, 0
                    seen.clear()
        yield told()
        give_back()

    sums = docs.select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    total = sums.where("bin < 0").agg(F.sum("n")).first()[0] or 0
    often = [r.bin for r in sums.where((F.col("bin") >= 0) & (F.col("n") >= max(least, TIMES_MEAN * total // BINS))).select("bin").collect()]  # at most BINS
    if not often:
        return None
    bits = np.zeros(BINS, np.uint8)
    bits[often] = 1
    return np.packbits(bits)


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest of all first: of small numbers most is zeros, which shuffle files compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(wide, -1).T).view(kind).ravel()


PACK = ["shard", "keys", "nodes", "who", "lead"]


def _tile_packs(docs: DataFrame, width: int, bands: Bands, shards: int) -> DataFrame:
    """Packed rows for each shard: tile hashes (sorted, as differences) and the set that each leads here; with
    ``lead``, the stars found inside the task, whose sets and leaders are places in ``nodes``."""

    def packs(keys: np.ndarray, nodes: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(keys, kind="stable")
        keys, nodes = keys[order], nodes[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        least = np.minimum.reduceat(nodes, first)
        each = np.repeat(least, np.diff(first, append=len(keys)))
        if (star := nodes != each).any():
            names, who = np.unique(np.concatenate([nodes[star], each[star]]), return_inverse=True)
            who, lead = np.split(who.astype(np.uint32), 2)
            yield int(keys[0] % np.uint64(shards)), _planes(np.diff(keys[star], prepend=np.uint64(0))), names.tobytes(), _planes(who), _planes(lead)
        keys = keys[first]
        part = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)  # ascending with the hash
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
            names, who = np.unique(least[a:b], return_inverse=True)
            yield int(part[a]), _planes(np.diff(keys[a:b], prepend=np.uint64(0))), names.tobytes(), _planes(who.astype(np.uint32)), None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if keys:
                columns = zip(*packs(np.concatenate(keys), np.concatenate(nodes)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] + [pa.binary()] * 4, strict=True)], PACK)
            for x in (keys, nodes, seen):
                x.clear()

        held = 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                grams, bounds = shingle_sets(data, offsets, width)
                mixed = mix(grams ^ _FEW)
                for name, a, b in zip(set_names(mixed, bounds).tolist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                    if a == b or name in seen:
                        continue
                    seen.add(name)
                    keys.append(bands.keys(grams[a:b], mixed[a:b]))
                    nodes.append(np.full(len(keys[-1]), name, np.int64))
                    held += len(keys[-1])
                if held > HELD_ENTRIES:
                    yield from flush()
                    held = 0
        yield from flush()
        give_back()

    return docs.select("text").mapInArrow(run, "shard int, keys binary, nodes binary, who binary, lead binary")


def _stars(packs: DataFrame) -> DataFrame:
    """(key, node, lead): each set of a tile hash and the smallest of them, shard by shard from their packed rows."""

    def rows(key: np.ndarray, node: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(lead)], ["key", "node", "lead"])

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if held:
            key, node = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key, kind="stable")
            key, node = key[order], node[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lead = np.repeat(np.minimum.reduceat(node, first), np.diff(first, append=len(key)))
            star = node != lead
            yield rows(key[star], node[star], lead[star])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None
        for batch in batches:
            for i in range(batch.num_rows):
                shard, packed, names, who, lead = (c[i].as_py() for c in batch.columns)
                if shard != last:
                    yield from merged(held)
                    last = shard
                key, name = np.cumsum(_from_planes(packed, np.uint64)), np.frombuffer(names, np.int64)
                node = name[_from_planes(who, np.uint32)]
                if lead is not None:
                    yield rows(key, node, name[_from_planes(lead, np.uint32)])
                else:
                    held.append((key, node))
        yield from merged(held)
        give_back()

    parts = _parts(packs)
    dealt = packs.repartitionById(parts, F.pmod(F.col("shard"), F.lit(parts))).sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "key long, node long, lead long")


def small_or_joined(df: DataFrame) -> DataFrame:
    """A cut-off ``df`` of narrow rows, to be broadcast if these are few and joined by a shuffle if not."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def semi_join(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` with (left_semi) or without (left_anti) their doc_id in ``ids``; few ids are broadcast, which
    spares the texts a shuffle."""
    return docs.join(small_or_joined(cut_lineage(ids.select("doc_id").distinct())), "doc_id", how)


def _possible(threshold: Fraction) -> Column:
    """Whether sizes and signatures of a and b allow a link: the overlap bounded from above by differing bits."""
    differ = reduce(add, (F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in SIGNATURE))
    overlap = F.least(F.col("a_n"), F.col("b_n"), F.floor((F.col("a_n") + F.col("b_n") - differ) / 2))
    return overlap * threshold.denominator >= (F.col("a_n") + F.col("b_n") - overlap) * threshold.numerator


def _met(pairs: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """(lead, partner, columns) for pairs (a, b): each b's own row, without a partner, and after it those of its a's.

    ``values`` has the columns of each node. A b with very many partners meets them in groups of bounded size.
    """
    groups = cut_lineage(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("groups")))
    partners = pairs.join(small_or_joined(groups), "b").select(F.col("a").alias("node"), F.col("b").alias("lead"), F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("group"), F.col("a").alias("partner"))
    leads = groups.select(F.col("b").alias("node"), F.col("b").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(None).cast("long").alias("partner"))
    roles = small_or_joined(cut_lineage(partners.unionByName(leads)))
    dealt = values.join(roles, "node").repartition(_parts(pairs), "lead", "group").sortWithinPartitions("lead", "group", F.col("partner").asc_nulls_first())
    return dealt.select("lead", "partner", *columns)


def _bounded(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) of large sets that sizes and wide bitmaps allow."""
    p, q = threshold.numerator, threshold.denominator

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bits = 0, b""
        for batch in batches:
            good = []
            for lead, partner, own, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if partner is None:
                    n, bits = own, more
                    continue
                overlap = min(n, own, (n + own - differing_bits(bits, more)) // 2)
                if q * overlap >= p * (n + own - overlap):
                    good.append((partner, lead))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*good, strict=True)], ["a", "b"])

    return _met(pairs, sets.select("node", "n", "bits"), ["n", "bits"]).mapInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) of sets that link: bounded by sizes and bitmaps first, then intersected."""
    p, q = threshold.numerator, threshold.denominator

    def side(x: str) -> DataFrame:
        return sets.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", *SIGNATURE)))

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                grams, bounds = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([pa.array(set_names(mix(grams ^ _FEW), bounds)), batch.column(1).slice(lo, hi - lo)], ["node", "text"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(2)):
                grams, bounds = shingle_sets(data, offsets, width)
                good = []
                for i, (lead, partner) in enumerate(zip(batch.column(0)[lo:hi].to_pylist(), batch.column(1)[lo:hi].to_pylist(), strict=True)):
                    own = grams[bounds[i] : bounds[i + 1]]
                    if partner is None:
                        held = own.copy()
                        continue
                    both = np.concatenate([held, own])
                    both.sort(kind="stable")  # merges the two sorted arrays
                    shared = int((both[1:] == both[:-1]).sum())
                    if q * shared >= p * (len(both) - shared):
                        good.append((partner, lead))
                if good:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*good, strict=True)], ["a", "b"])
        give_back()

    pairs = cut_lineage(pairs.select("a", "b"))
    # Only the signatures of sets that have a pair shuffle.
    paired = small_or_joined(cut_lineage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    sets = sets.join(paired, "node", "left_semi")
    maybe = pairs.join(side("a"), "a").join(side("b"), "b").where(_possible(threshold))
    # A signature says little of sets that fill it; wide bitmaps are far smaller than the texts yet.
    maybe = _compact(maybe.select("a", "b", (F.least("a_n", "b_n") > SIGNATURE_BITS // 2).alias("large")))
    maybe = cut_lineage(maybe.where("not large").select("a", "b").unionAll(_bounded(maybe.where("large").select("a", "b"), sets, threshold)))
    # One text a set: of the row with its smallest doc_id.
    nodes = maybe.select(F.col("a").alias("node")).union(maybe.select("b")).distinct()
    wanted = nodes.join(sets.select("node", "doc_id"), "node").select("doc_id")
    texts = semi_join(docs.select("doc_id", "text"), wanted, "left_semi").mapInArrow(named, "node long, text string")
    return _met(maybe, texts, ["text"]).mapInArrow(compare, "a long, b long").distinct()


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _compact(df: DataFrame, rows_a_part: int = 100_000) -> DataFrame:
    """Checkpoint, read as no more partitions than the rows need: small tables shuffle as few files."""
    df = cut_lineage(df)
    return df.coalesce(-(-df.count() // rows_a_part) or 1)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b) and the smallest node that it reaches.

    Alternates large and small stars over checkpointed edges until they no longer change; minima combine before the
    shuffle and the joins back are split where skewed, so a node with very many neighbours is no bottleneck.
    """
    edges = _compact(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def tally(df: DataFrame) -> tuple:
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = tally(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = _compact(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = tally(edges)
        if after == before:
            break
        before = after
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _forest(pairs: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Places of the pairs (rows of two component ids), nearest first, that join what earlier ones have not."""
    ids, at = np.unique(pairs, return_inverse=True)
    top, kept, left = list(range(len(ids))), [], len(ids) - 1
    ends = at.reshape(pairs.shape)
    for k in np.argsort(differ, kind="stable").tolist():
        x, y = ends[k].tolist()
        while top[x] != x:
            top[x] = x = top[top[x]]
        while top[y] != y:
            top[y] = y = top[top[y]]
        if x != y:
            top[y] = x
            kept.append(k)
            left -= 1
            if not left:
                break
    return np.array(kept, np.int64)


def _across(stars: DataFrame, components: DataFrame, sets: DataFrame, threshold: Fraction, spanning: bool) -> DataFrame:
    """(key, a, b): pairs of different components that a tile holds together and that may link, in blocks of bounded size.

    ``spanning``: of each block only as many as would connect the same components, nearest first; else all.
    """
    # Every set of a tile but its smallest is the member of a star, and that one leads the last of these.
    member = stars.select("key", "node").union(stars.groupBy("key").agg(F.min("lead").alias("node")))
    member = member.join(small_or_joined(components), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    same = {"rows": F.count(F.lit(1)), "least": F.min("node"), "most": F.max("node"), "hashed": F.bit_xor(F.xxhash64("node"))}
    mixed = member.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), *(c.alias(n) for n, c in same.items())).where("x <> y")
    # Near copies share very many tiles: of those with the same sets one is enough.
    mixed = cut_lineage(mixed.groupBy(*same).agg(F.min("key").alias("key")).select("key", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")))
    rows = member.join(small_or_joined(mixed), "key")
    rows = rows.join(sets.select("node", "n", *SIGNATURE), "node")
    # A block of a tile meets itself and every other block; most tiles have one block and make no copies.
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second"), "block", "node", "component", "n", *SIGNATURE)
    place = ["key", "first", "second"]
    p, q = threshold.numerator, threshold.denominator

    def compare(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of one block pair of one tile that sizes and bitmaps allow."""
        first, second, block, node, component, n = columns[1:7]
        bits = np.stack(columns[7:], axis=1).view(np.uint64)
        one, two = np.flatnonzero(block == first[0]), np.flatnonzero(block == second[0])
        found = []
        for lo in range(0, len(one), 64):
            i = one[lo : lo + 64]
            differ = np.bitwise_count(bits[i, None, :] ^ bits[None, two, :]).sum(2, dtype=np.int64)
            total = n[i, None] + n[None, two]
            overlap = np.minimum(np.minimum(n[i, None], n[None, two]), (total - differ) // 2)
            good = (component[i, None] != component[None, two]) & (q * overlap >= p * (total - overlap))
            if first[0] == second[0]:
                good &= node[i, None] < node[None, two]
            x, y = np.nonzero(good)
            found.append((i[x], two[y], differ[x, y]))
        a, b, differ = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        if spanning and len(a):
            kept = _forest(np.stack([component[a], component[b]], axis=1), differ)
            a, b = a[kept], b[kept]
        return np.full(len(a), columns[0][0]), np.maximum(node[a], node[b]), np.minimum(node[a], node[b])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [c.to_numpy() for c in batch.columns]
            held = new if held is None else [np.concatenate(c) for c in zip(held, new, strict=True)]
            moves = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])) + 1
            yield from told(held, np.concatenate([[0], moves]))
            held = [c[moves[-1] if len(moves) else 0 :] for c in held]
        if held is not None and len(held[0]):
            yield from told(held, np.array([0, len(held[0])]))
        give_back()

    def told(held: list[np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = [compare([c[lo:hi] for c in held]) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["key", "a", "b"])

    return rows.repartition(_parts(rows), *place).sortWithinPartitions(*place).mapInArrow(run, "key long, a long, b long")


def _contracted(components: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links (a, b): these join whole components, so only component ids are contracted."""
    side = lambda x: components.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component"))
    joining = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
    higher = cut_lineage(connected_components(joining)).select(F.col("node").alias("component"), F.col("component").alias("top"))
    lone = higher.join(components.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("top").alias("component"))
    return components.join(higher, "component", "left").select("node", F.coalesce("top", "component").alias("component")).union(lone)


def _grouped(docs: DataFrame, width: int, threshold: Fraction, **frequent: int) -> DataFrame:
    """(doc_id, n, node, group, component_id) of every row of ``docs``; group names the set's component."""
    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    marks = written(_marks(texts, width))
    named = texts.where(F.col("doc_id").isNotNull())
    known = marks.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    sets = written(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), *(F.min(s).alias(s) for s in (*SIGNATURE, "bits"))))
    shards = max(2 * _parts(docs), math.ceil((marks.agg(F.sum("n")).first()[0] or 0) / SHARD_ENTRIES))
    bands = Bands(threshold, frequent_shingles(named, width, **frequent))
    stars = written(_stars(_tile_packs(named, width, bands, shards)))
    pairs = cut_lineage(stars.groupBy(F.col("node").alias("a"), F.col("lead").alias("b")).agg(F.count(F.lit(1)).alias("tiles")))

    # Most links are found from each set to the leader that it shares most tiles with.
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("tiles", -F.col("b"))).alias("b"))
    components = cut_lineage(connected_components(_verified(best, sets, named, width, threshold)))
    # Then, across components, pairs that would connect what may link; last, in tiles where one of these does not
    # link, all pairs that still may.
    for spanning in (True, False):
        maybe = _compact(_across(stars, components, sets, threshold, spanning))
        found = cut_lineage(_verified(maybe.select("a", "b").distinct(), sets, named, width, threshold))
        components = cut_lineage(_contracted(components, found))
        stars = stars.join(maybe.join(found, ["a", "b"], "left_anti").select("key").distinct(), "key", "left_semi")
    of_set = sets.select("node", "doc_id").join(components, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("group"))
    least = of_set.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    of_set = of_set.drop("doc_id").join(least, "group")
    lone = marks.where(F.col("doc_id").isNull() | F.col("node").isNull()).select("doc_id", "n", "node", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id"))
    return known.select("doc_id", "n", "node").join(of_set, "node").select(*lone.columns).unionAll(lone)


def jaccard_groups(docs: DataFrame, width: int, threshold: Fraction, **frequent: int) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of ``docs``.

    ``frequent``: what ``frequent_shingles`` takes, if not its own.
    """
    return _grouped(docs, width, threshold, **frequent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each_group(docs: DataFrame, width: int = 5, threshold: Fraction = Fraction(8, 10)) -> DataFrame:
    """The rows of ``docs``, all columns, that are the smallest doc_id of their group; rows without an id stay.

    Of a doc_id with several rows each text is judged by its own group; rows with the same id and set are one document.
    """
    rows = cut_lineage(_grouped(docs, width, threshold).where(F.col("doc_id").isNotNull()))
    repeated = cut_lineage(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("doc_id"))
    gone = rows.where("component_id <> doc_id").select("doc_id").union(repeated)
    kept = semi_join(docs, gone, "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return kept
    several = semi_join(docs, repeated, "left_semi").select(*docs.columns)
    own = "__set"
    names, at = [*docs.columns, own], docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(at)):
                grams, bounds = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(set_names(mix(grams ^ _FEW), bounds))], names)

    several = several.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())]))
    stays = rows.where("component_id = doc_id").join(repeated, "doc_id", "left_semi").groupBy("doc_id", "group").agg(F.coalesce(F.min("node"), F.lit(0)).alias(own)).select("doc_id", own)
    return kept.unionAll(several.join(stays, ["doc_id", own], "left_semi").dropDuplicates(["doc_id", own]).select(*docs.columns))
