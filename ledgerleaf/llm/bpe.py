"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece (what the pre-tokeniser's pattern cuts out) starts as its bytes. A segment tree holds, for every live
position, rank * width + position of the pair that begins there; its root is therefore the leftmost pair of lowest
rank. A merge changes at most three leaves, each of which is brought up to the root in logarithmic time, until the
root holds no mergeable pair. Short pieces of a batch run through one matrix of trees, a row each, so numpy does a
merge of every piece at a time; a piece of over 64 bytes has a tree of its own and stays O(n log n).

The tokenizer's file is read on the driver and its merge table broadcast: its size is the vocabulary's, whatever the
corpus. Pieces already encoded are kept in a dictionary of bounded size; that changes no result.

Defined results: a null or empty text has no ids and decodes to the empty text. A special token's string inside a
text is that token, as in the library's ``encode``; decoding keeps special tokens. Bytes that are no UTF-8 decode to
U+FFFD. Repeated rows each get their row. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerleaf.llm.shared import text_chunks

#: Fixed value: the byte-level pre-tokeniser's pattern, its white space named by property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = np.int64(1) << np.int64(40)
SHORT = 64
KEPT_PIECES = 300_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: a printable Latin-1 byte is itself, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merge ranks as sorted arrays, each id's bytes, and the special tokens of a ``tokenizers`` file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.zeros(256, np.int64)
        for symbol, byte in symbols.items():
            self.first[byte] = ids[symbol]
        self.bits = max([*ids.values(), *self.special.values()]).bit_length()
        keys = np.array([ids[a] << self.bits | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.int64(-1)), np.append(order, -1)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.bytes = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it doesn't merge. A negative id stands for no token."""
        key = np.where((left < 0) | (right < 0), -2, left << self.bits | right)
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def encode_matrix(pieces: list[bytes], width: int, vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of pieces of 1 to ``width`` bytes (a power of two), all trees side by side."""
    n, cols = len(pieces), width + 1
    sizes = np.fromiter(map(len, pieces), np.int64, n)
    ids = np.full((n, cols), -1, np.int64)
    ids[np.arange(cols) < sizes[:, None]] = vocab.first[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.where(np.arange(1, cols + 1) < sizes[:, None], np.arange(1, cols + 1), width)
    before = np.tile(np.arange(-1, width), (n, 1))
    tree = np.full((n, 2 * width), NONE)
    rank = vocab.rank(ids[:, :width], ids[:, 1:])
    tree[:, width:] = np.where(rank >= 0, rank * width + np.arange(width), NONE)
    for level in (width >> k for k in range(1, width.bit_length())):
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    ids_flat, after_flat, before_flat, tree_flat = ids.reshape(-1), after.reshape(-1), before.reshape(-1), tree.reshape(-1)
    live = np.arange(n)

    def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        base, node = rows * (2 * width), at + width
        tree_flat[base + node] = values
        while width > 1 and node[0] > 1:
            node = node >> 1
            both = base + 2 * node
            tree_flat[base + node] = np.minimum(tree_flat[both], tree_flat[both + 1])

    def pair(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = vocab.rank(ids_flat[rows * cols + at], ids_flat[rows * cols + after_flat[rows * cols + at]])
        return np.where(r >= 0, r * width + at, NONE)

    while True:
        root = tree_flat[live * (2 * width) + 1]
        live, root = live[root < NONE], root[root < NONE]
        if not len(live):
            break
        at, base = root % width, live * cols
        gone = after_flat[base + at]
        ids_flat[base + at] = vocab.merged[root // width]
        next_ = after_flat[base + gone]
        after_flat[base + at] = next_
        before_flat[base + next_] = at
        ids_flat[base + gone] = -1
        put(live, gone, np.full(len(live), NONE))
        put(live, at, pair(live, at))
        left = before_flat[base + at]
        some = left >= 0
        if some.any():
            put(live[some], left[some], pair(live[some], left[some]))
        ids_flat[base + width] = -1
    kept = ids >= 0
    flat = ids[kept].astype(np.int32)
    return np.split(flat, np.cumsum(kept.sum(1))[:-1])


def encode_long(piece: bytes, vocab: Vocabulary, ranks: dict[int, int]) -> np.ndarray:
    """Ids of one piece of any length, with a segment tree of its own. ``ranks``: pair key to rank."""
    ids = vocab.first[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    width = 1 << max(1, (n - 1).bit_length())
    none = int(NONE) * width
    after, before = [*range(1, n + 1)], [*range(-1, n)]
    bits, merged = vocab.bits, vocab.merged.tolist()

    def pair(at: int) -> int:
        right = after[at]
        r = ranks.get(ids[at] << bits | ids[right]) if right < n else None
        return none if r is None else r * width + at

    tree = [none] * (2 * width)
    tree[width : width + n] = map(pair, range(n))
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(at: int, value: int) -> None:
        node = at + width
        tree[node] = value
        node >>= 1
        while node:
            best = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node >>= 1

    while (root := tree[1]) < none:
        at = root % width
        gone = after[at]
        ids[at] = merged[root // width]
        after[at] = after[gone]
        before[after[gone]] = at
        ids[gone] = -1
        put(gone, none)
        put(at, pair(at))
        if before[at] >= 0:
            put(before[at], pair(before[at]))
    return np.array([i for i in ids if i >= 0], np.int32)


class Encoder:
    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.kept = vocab, {}
        self.cut = regex.compile(PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(vocab.special, key=len, reverse=True)) + ")") if vocab.special else None
        self.ranks: dict[int, int] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces that aren't kept yet; each is kept as the bytes of its int32 ids."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            by_width.setdefault(max(4, 1 << (len(raw) - 1).bit_length()) if len(raw) <= SHORT else 0, []).append((piece, raw))
        for width, group in by_width.items():
            if width:
                for lo in range(0, len(group), 8192):
                    part = group[lo : lo + 8192]
                    for (piece, _), ids in zip(part, encode_matrix([raw for _, raw in part], width, self.vocab), strict=True):
                        self.kept[piece] = ids.tobytes()
            else:
                if not self.ranks:
                    self.ranks = dict(zip(self.vocab.keys[:-1].tolist(), self.vocab.ranks[:-1].tolist(), strict=True))
                for piece, raw in group:
                    self.kept[piece] = encode_long(raw, self.vocab, self.ranks).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The int32 ids of each text, as bytes."""
        cut: list[list[str]] = []
        special = dict.fromkeys(self.vocab.special)
        for text in texts:
            if self.at_special and any(s in text for s in special):
                cut.append([p for i, part in enumerate(self.at_special.split(text)) for p in ([part] if i % 2 else self.cut(part))])
            else:
                cut.append(self.cut(text))
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        for s, i in self.vocab.special.items():
            self.kept.setdefault(s, np.int32(i).tobytes())
        self.learn(set().union(*cut).difference(self.kept))
        found = self.kept.__getitem__
        out = [b"".join(map(found, pieces)) for pieces in cut]
        for piece in [p for pieces in cut for p in pieces if len(p) > 4 * SHORT]:
            self.kept.pop(piece, None)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocab.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_and_decode(docs: DataFrame, tokenizer_path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text) and decode the ids again.

    Returns doc_id, the columns named in ``keep``, ids and decoded.
    """
    chosen = docs.select("doc_id", "text", *keep)
    kept = [chosen.schema.fields[i] for i in (0, *range(2, 2 + len(keep)))]
    schema = T.StructType([*kept, *T.StructType.fromDDL("ids array<int>, decoded string").fields])
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                raw = data.tobytes()
                at = offsets.tolist()
                coded = encoder.encode([raw[a:b].decode() for a, b in zip(at, at[1:], strict=False)])
                ids = [np.frombuffer(c, np.int32) for c in coded]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids)))
                texts = pa.array([encoder.decode(x) for x in ids], pa.string())
                others = [c.slice(lo, hi - lo) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([others[0], *others[2:], lists, texts], names=schema.names)

    return chosen.mapInArrow(run, schema)
