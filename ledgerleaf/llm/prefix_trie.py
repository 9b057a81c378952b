"""Conversation prefix trie, built as z-fast tries.

A conversation is a string of turns; a node is a distinct sequence of first turns. A string's prefixes are named by
two 61-bit sums of hashes of (depth, role, text), so a prefix's name costs one addition a turn. A z-fast trie keeps
compacted nodes only: each covers the depths behind its parent's extent up to its own, and is found in a hash table
under its handle, the prefix of the depth in there that the highest power of two divides. A string's exit node is found
by fat binary search, a look-up a halving; strings are inserted in batches, splitting an edge where they leave it; at
the end sums go up and the edges are expanded into nodes.

Strings are dealt by ranges of their prefixes, so that each task's tries are neighbours of few others, and equal
conversations, however many, are split by their ids; a node that several tasks have is joined by an aggregate over
tries' nodes. A conversation is cut into segments of ``segment_turns``, each a string of the trie below the node where
it begins, and turns are numbered in two levels, by ranges, so no task gathers a conversation. A task's tries are
emitted and begun anew from ``most_held`` turns on.

Sums over a subtree need no walk: a conversation owns the nodes whose smallest member it is, which are the last ones of
its path, so the nodes shared with smaller ones are a prefix of it. Inserted with its bytes, that prefix adds to each
node on its way what the node and those below save. Leaves are the ends of owned paths without children.

Defined results: turns are in the order of (turn, role, text), nulls first; a null role or text is empty; equal rows are
turns of their own. Rows without conv_id belong to no conversation. An empty table gives no rows (not even the root);
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.shared import written

SEGMENT, HELD = 256, 400_000
BITS = 61
_MASK = np.uint64((1 << BITS) - 1)
_ITEMS = "array<struct<depth:long,s1:long,s2:long,size:long>>"
_STRING = "segment long, o1 long, o2 long, osize long, items array<struct<depth:long,s1:long,s2:long,size:long>>, passing long, ending long, amount long, conv_id long"
_NODE = "h1 long, h2 long, depth long, p1 long, p2 long, size long, above long, passing long, ending long, amount long, conv_id long"


def fattest(lo: int, hi: int) -> int:
    """Of the numbers behind ``lo`` up to ``hi`` the one that the highest power of two divides."""
    return hi & -1 << ((lo ^ hi).bit_length() - 1)


class Node:
    __slots__ = ("parent", "extent", "names", "sizes", "children", "passing", "ending", "amount", "conv_id")

    def __init__(self, parent: Node | None, extent: int, names: list, sizes: list) -> None:
        self.parent, self.extent, self.names, self.sizes = parent, extent, names, sizes
        self.children: dict = {}
        self.passing = self.ending = self.amount = 0
        self.conv_id: int | None = None


class ZFastTrie:
    """Compacted nodes of the strings below one node.

    A string is the names of its prefixes, the empty one first, and the bytes of the turns up to each.
    """

    def __init__(self, names: list, sizes: list) -> None:
        self.root = Node(None, 0, names[:1], sizes[:1])
        self.handles: dict = {}

    def exit_node(self, names: list) -> tuple[Node, int]:
        """(node, depth) where a string leaves the trie: the node whose edge it leaves, and how far it goes along."""
        node, n = self.root, len(names) - 1
        lo, hi = 0, n
        while lo < hi:
            f = fattest(lo, hi)
            found = self.handles.get(names[f])
            if found is None:
                hi = f - 1
            elif found.extent <= n and found.names[found.extent] == names[found.extent]:
                node, lo = found, found.extent
            else:
                return found, self._shared(found, names, f)
        if node.extent < n and (below := node.children.get(names[node.extent + 1])):
            return below, self._shared(below, names, node.extent + 1)
        return node, node.extent

    @staticmethod
    def _shared(node: Node, names: list, lo: int) -> int:
        """How many turns the string and the node share, at least ``lo``."""
        hi = min(node.extent, len(names) - 1)
        while lo < hi:
            middle = (lo + hi + 1) // 2
            if node.names[middle] == names[middle]:
                lo = middle
            else:
                hi = middle - 1
        return lo

    def _hang(self, node: Node, parent: Node) -> None:
        node.parent = parent
        parent.children[node.names[parent.extent + 1]] = node
        self.handles[node.names[fattest(parent.extent, node.extent)]] = node

    def insert(self, names: list, sizes: list) -> Node:
        """The node that ends where the string does, made if need be."""
        node, depth = self.exit_node(names)
        if depth < node.extent:  # cut the edge: an upper node ends here, the lower one gets another handle
            upper = Node(None, depth, node.names, node.sizes)
            parent = node.parent
            del self.handles[node.names[fattest(parent.extent, node.extent)]]
            self._hang(upper, parent)
            self._hang(node, upper)
            node = upper
        if depth < len(names) - 1:
            leaf = Node(None, len(names) - 1, names, sizes)
            self._hang(leaf, node)
            node = leaf
        return node

    def nodes(self) -> list[Node]:
        """All compacted nodes, parents first."""
        out = [self.root]
        for node in out:
            out += node.children.values()
        return out


def _expanded(tries: dict[tuple, ZFastTrie], segment_turns: int) -> Iterator[pa.RecordBatch]:
    """Sums of all strings through each node, for every node of every edge."""
    columns: list[list] = [[] for _ in range(11)]
    for (segment, *_), trie in tries.items():
        nodes = trie.nodes()
        for x in reversed(nodes[1:]):
            up = x.parent
            up.passing += x.passing
            up.ending += x.ending
            up.amount += x.amount
            up.conv_id = x.conv_id if up.conv_id is None else min(up.conv_id, x.conv_id)
        for x in nodes:
            if x.parent is None:
                if segment:
                    continue  # the segment above has this node
                rows = [(*x.names[0], 0, None, None, 0, 0)]
            else:
                sizes, names = x.sizes, x.names
                rows = [(*names[d], segment * segment_turns + d, *names[d - 1], sizes[d] - sizes[d - 1], sizes[d - 1]) for d in range(x.parent.extent + 1, x.extent + 1)]
            for column, values in zip(columns, zip(*rows, strict=True), strict=False):
                column.extend(values)
            for column, value in zip(columns[7:], (x.passing, x.ending, x.amount, x.conv_id), strict=True):
                column.extend([value] * len(rows))
    if columns[0]:
        names = [c.split()[0] for c in _NODE.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _strings(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(segment, names, sizes, weights) of every row."""
    segment, o1, o2, osize = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
    items = batch.column(4)
    flat, offsets = items.flatten(), np.append(0, np.cumsum(items.value_lengths().to_numpy(zero_copy_only=False)))
    names = []
    for field, start in (("s1", o1), ("s2", o2)):
        total = np.append(np.uint64(0), np.cumsum(flat.field(field).to_numpy(zero_copy_only=False).astype(np.uint64)))
        names.append(total)
    sums = np.append(0, np.cumsum(flat.field("size").to_numpy(zero_copy_only=False)))
    weights = zip(*(batch.column(k).to_pylist() for k in range(5, 9)), strict=True)
    for i, w in enumerate(weights):
        lo, hi = offsets[i], offsets[i + 1]
        first, second = (((t[lo : hi + 1] - t[lo] + np.uint64(o[i])) & _MASK).tolist() for t, o in zip(names, (o1, o2), strict=True))
        yield int(segment[i]), list(zip(first, second, strict=True)), (sums[lo : hi + 1] - sums[lo] + osize[i]).tolist(), w


def trie_nodes(strings: DataFrame, segment_turns: int = SEGMENT, most_held: int = HELD) -> DataFrame:
    """All nodes of the trie of ``strings``, with the weights of the strings through each: sums, and the least conv_id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[tuple, ZFastTrie] = {}
        held = 0
        for batch in batches:
            for segment, names, sizes, (passing, ending, amount, conv_id) in _strings(batch):
                key = (segment, *names[0])
                if (trie := tries.get(key)) is None:
                    trie = tries[key] = ZFastTrie(names, sizes)
                node = trie.insert(names, sizes)
                node.passing += passing
                node.ending += ending
                node.amount += amount
                node.conv_id = conv_id if node.conv_id is None else min(node.conv_id, conv_id)
                held += len(names)
            if held > most_held:
                yield from _expanded(tries, segment_turns)
                tries, held = {}, 0
        yield from _expanded(tries, segment_turns)

    first = [F.get(F.col("items"), F.lit(k)).getField("s1").alias(f"_r{k}") for k in range(3)]
    parts = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["segment", "o1", "o2", "_r0", "_r1", "_r2", "conv_id"]
    columns = [c.split()[0] for c in _STRING.split(", ")]
    dealt = strings.select(*columns, *first).repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*columns)
    found = dealt.mapInArrow(run, _NODE)
    same = [F.max(c).alias(c) for c in ("depth", "p1", "p2", "size", "above")]
    return found.groupBy("h1", "h2").agg(*same, *(F.sum(c).alias(c) for c in ("passing", "ending", "amount")), F.min("conv_id").alias("conv_id"))


def _summed(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(19,0)"))


def _name(total: Column) -> Column:
    return F.pmod(total, F.lit(1 << BITS).cast("decimal(38,0)")).cast("long")


def rebuilt_strings(turns: DataFrame, heads_below: int, family: int, segment_turns: int = SEGMENT) -> DataFrame:
    """Every rebuilt conversation, in segments of hashed turns with what stands before each.

    A conversation begins with the first h turns of the first of its ``family`` neighbouring ids, then has its own behind
    its h-th; h is its CRC-32 modulo ``heads_below``.
    Returns conv_id, segment, o1, o2, osize, items, and e1, e2, esize and length of the whole conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = said.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marks = [F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)]
    # Written once: the places in it are the order of the turns.
    ranged = written(ranged.select("conv_id", *marks, F.octet_length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("at")))
    stretch = F.shiftright("at", 33)
    counts = ranged.groupBy("conv_id", stretch.alias("stretch")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = counts.select("conv_id", "stretch", "first_at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    base = F.col("conv_id") - F.col("conv_id") % family
    h = (F.crc32(F.col("conv_id").cast("string")) % heads_below).alias("h")

    firsts = counts.where((F.col("conv_id") % family == 0) & (F.col("earlier") < heads_below)).select(F.col("conv_id").alias("base"), F.col("stretch").alias("base_stretch"), "first_at", "earlier")
    heads = ranged.join(firsts, (F.col("conv_id") == F.col("base")) & (stretch == F.col("base_stretch")))
    heads = heads.withColumn("depth", F.col("at") - F.col("first_at") + F.col("earlier") + 1).where(F.col("depth") < heads_below)
    heads = heads.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("depth", "t1", "t2", "size"))).alias("heads"))  # fewer than heads_below
    convs = counts.where("earlier = 0").select("conv_id", base.alias("of"), h).join(heads, F.col("of") == F.col("base"), "left")
    given = F.slice("heads", 1, F.col("h").cast("int"))
    convs = convs.select("conv_id", "h", F.coalesce(F.when(F.col("h") > 0, given), F.array().cast("array<struct<depth:long,t1:long,t2:long,size:long>>")).alias("heads"))

    places = counts.join(convs.select("conv_id", "h", F.size("heads").alias("m")), "conv_id")
    places = places.select(F.col("conv_id").alias("of"), F.col("stretch").alias("of_stretch"), (F.col("earlier") + 1 - F.col("first_at") - F.col("h")).alias("shift"), "m")
    own = ranged.join(places, (F.col("conv_id") == F.col("of")) & (stretch == F.col("of_stretch"))).where(F.col("at") + F.col("shift") > 0)
    own = own.select("conv_id", (F.col("at") + F.col("shift") + F.col("m")).alias("depth"), "t1", "t2", "size")
    taken = convs.select("conv_id", F.explode_outer("heads").alias("x")).select("conv_id", "x.depth", "x.t1", "x.t2", "x.size")  # one row of nulls where none
    hashed = [F.when(F.col("depth").isNotNull(), F.shiftrightunsigned(F.xxhash64("depth", f"t{k}"), 64 - BITS)).alias(f"s{k}") for k in (1, 2)]
    turns_of = own.unionAll(taken).select("conv_id", "depth", *hashed, "size")

    segment = F.coalesce(F.floor((F.col("depth") - 1) / segment_turns).cast("long"), F.lit(0)).alias("segment")
    item = F.when(F.col("depth").isNotNull(), F.struct("depth", "s1", "s2", "size"))
    strings = turns_of.groupBy("conv_id", segment).agg(F.sort_array(F.collect_list(item)).cast(_ITEMS).alias("items"), *(F.coalesce(_summed(c), F.lit(0)).alias(f"sum_{c}") for c in ("s1", "s2", "size")))
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # a row a segment
    whole = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reach = lambda c, w: F.coalesce(F.sum(f"sum_{c}").over(w), F.lit(0))
    starts = [_name(reach("s1", before)).alias("o1"), _name(reach("s2", before)).alias("o2"), reach("size", before).cast("long").alias("osize")]
    ends = [_name(reach("s1", whole)).alias("e1"), _name(reach("s2", whole)).alias("e2"), reach("size", whole).cast("long").alias("esize")]
    return strings.select("conv_id", "segment", "items", *starts, *ends, F.sum(F.size("items")).over(whole).alias("length"))


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids as digits, those of a node in a row; ids come ascending by node."""
    for batch in batches:
        e1, e2, ids = (batch.column(k).to_numpy() for k in range(3))
        if not len(ids):
            continue
        begins = np.flatnonzero(np.append(True, (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])))
        digits = [",".join(map(str, x.tolist())).encode() for x in np.split(ids, begins[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(e1[begins]), pa.array(e2[begins]), pa.array(ids[begins]), pa.array(digits, pa.binary())], ["e1", "e2", "first", "digits"])


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest a node, fed list by list."""
    key, digest = None, None
    for batch in batches:
        out = []
        for e1, e2, digits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if (e1, e2) != key:
                if digest:
                    out.append((*key, digest.hexdigest()))
                key, digest = (e1, e2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(digits.as_buffer())
        if out:
            yield _ends_batch(out)
    if digest:
        yield _ends_batch([(*key, digest.hexdigest())])


def _ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["e1", "e2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids (e1, e2, conv_id) of each node, joined by commas, without gathering a node's ids."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["e1", "e2", "conv_id"]
    lists = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_listed, "e1 long, e2 long, first long, digits binary")
    return lists.repartition(parts, "e1", "e2").sortWithinPartitions("e1", "e2", "first").mapInArrow(_digested, "e1 long, e2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, heads_below: int = 9, family: int = 5, segment_turns: int = SEGMENT, most_held: int = HELD) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of
    text that members share in the node's subtree) and ends_sha256 (of the ids that end in the node).
    """
    strings = written(rebuilt_strings(turns, heads_below, family, segment_turns))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    whole = strings.select("segment", "o1", "o2", "osize", "items", one.alias("passing"), none.alias("ending"), none.alias("amount"), "conv_id")
    nodes = written(trie_nodes(whole, segment_turns, most_held).drop("ending", "amount"))
    children = nodes.where(F.col("p1").isNotNull()).groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left").drop("c1", "c2")
    nodes = written(nodes.withColumn("n_children", F.coalesce("n_children", none)))

    # Of each conversation that owns nodes: where the first is, the bytes above it, and whether the last is a leaf.
    owned = nodes.groupBy(F.col("conv_id").alias("owner")).agg(F.min("depth").alias("top"), F.min_by("above", "depth").alias("shared"), F.min_by("n_children", -F.col("depth")).alias("below"))
    placed = strings.join(owned, F.col("conv_id") == F.col("owner"), "left")
    last = F.when(F.col("top").isNull(), F.col("length")).otherwise(F.greatest(F.col("top") - 1, none)) - F.col("segment") * segment_turns
    keys = ["segment", "o1", "o2", "osize"]
    stops = placed.where((F.col("segment") == 0) | (last > 0)).select(*keys, F.slice("items", F.lit(1), last.cast("int")).alias("items"), one.alias("passing"), none.alias("ending"), F.coalesce("shared", "esize").alias("amount"), "conv_id")
    leaves = placed.where("below = 0").select(*keys, "items", none.alias("passing"), one.alias("ending"), none.alias("amount"), "conv_id")
    sums = trie_nodes(stops.unionAll(leaves), segment_turns, most_held).select(F.col("h1").alias("u1"), F.col("h2").alias("u2"), F.col("passing").alias("sharing"), F.col("ending").alias("n_leaves"), "amount")
    ends = end_digests(strings.where("segment = 0").select("e1", "e2", "conv_id"))
    parents = nodes.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, (F.col("h1") == F.col("u1")) & (F.col("h2") == F.col("u2")), "left")
    out = out.join(ends, (F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2")), "left")
    out = out.join(parents, (F.col("p1") == F.col("a1")) & (F.col("p2") == F.col("a2")), "left")
    saved = F.coalesce(F.col("amount") - F.col("sharing") * F.col("above"), none)
    nobody = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", F.col("passing").alias("n_convs"), "n_children", F.coalesce("n_leaves", none).alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", nobody).alias("ends_sha256"))
