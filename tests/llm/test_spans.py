"""Prefix trie, fill-in-middle and substring dedup: brute-force versions, their SQL and edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import fill_middle, prefix_trie, queries_spans, suffix_dedup

TABLES = ("documents", "conversations")


@pytest.mark.parametrize("name", sorted(queries_spans.QUERIES))
def test_queries_equal_their_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = queries_spans.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries_spans.ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want))


# ---- prefix trie
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def nodes_by_walking(rows):
    """Every node by listing all prefixes of all rebuilt conversations."""
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = said.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in ids if len(rebuilt[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        children = sum(len(n) == len(node) + 1 for n in below)
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        out.append((min(ids), len(node), parent, len(ids), children, leaves, saved, sha(ends)))
    return sorted(out)


def talks(seed, n=60, longest=12):
    """Conversations that share beginnings: (conv_id, turn, role, text, more)."""
    rng = random.Random(seed)
    rows = []
    pool = [[(rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long " * 5])) for _ in range(rng.randint(0, longest))] for _ in range(6)]
    for c in rng.sample(range(-20, 200), n):
        turns = list(rng.choice(pool))[: rng.randint(0, longest)] + [("user", f"t{rng.randint(0, 2)}")] * rng.randint(0, 3)
        rows += [(c, i if rng.random() < 0.97 else None, role, text, "x") for i, (role, text) in enumerate(turns)]
    return rows


def trie_rows(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, depth string").repartition(3)
    return sorted(map(tuple, prefix_trie.prefix_trie(df, **options).collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize(("seed", "segment", "held"), [(1, 256, 400_000), (2, 3, 400_000), (3, 2, 10)])
def test_nodes_equal_all_prefixes(spark, seed, segment, held):
    rows = talks(seed)
    rows += [(None, 0, "user", "nobody", "x"), (500, 1, "u", "same", "x"), (500, 1, "u", "same", "x")]
    assert trie_rows(spark, rows, segment_turns=segment, most_held=held) == nodes_by_walking(rows)


def test_no_conversations_no_nodes(spark):
    assert trie_rows(spark, []) == [] and trie_rows(spark, [(None, 1, "u", "t", "x")]) == []


def test_copies_and_a_long_conversation(spark):
    rows = [(5 * c, t, "u", f"turn {t}", "x") for c in range(60) for t in range(3)] + [(1001, t, "u", str(t % 7), "x") for t in range(700)]
    assert trie_rows(spark, rows) == nodes_by_walking(rows)


def test_fat_search_finds_every_exit():
    rng = random.Random(4)
    name = lambda word: [(k, hash(word[:k])) for k in range(len(word) + 1)]
    words = ["".join(rng.choices("ab", k=rng.randint(0, 20))) for _ in range(300)]
    trie = prefix_trie.ZFastTrie(name(""), [0])
    for word in words:
        node = trie.insert(name(word), list(range(len(word) + 1)))
        node.passing += 1
    for probe in words + ["".join(rng.choices("abc", k=9)) for _ in range(300)]:
        node, depth = trie.exit_node(name(probe))
        best = max(next((k for k in range(len(w) + 1) if w[: k + 1] != probe[: k + 1] or k == len(w)), 0) for w in [*words, ""])
        assert depth == best and node.names[depth] == name(probe)[depth]
    # Compacted: every inner node ends a string or branches; every handle leads to its node.
    for node in trie.nodes()[1:]:
        assert node.passing or len(node.children) > 1
        assert trie.handles[node.names[prefix_trie.fattest(node.parent.extent, node.extent)]] is node
    assert len(trie.handles) == len(trie.nodes()) - 1 and prefix_trie.fattest(4, 11) == 8


# ---- fill in the middle
TEXTS = [None, "", " ", "\n\t ", "one", " one", "one ", "a<P>b c d", "é ü x  y\nz ", "<S", "P> <", "x" * 300_000, "w " * 200_001]


def test_texts_are_cut_rotated_and_restored(spark, docs):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "a b c"), (7, "again"), (7, "again")]
    made = fill_middle.restore_texts(fill_middle.fill_in_middle(docs(rows), keep=("lang", "text"))).collect()
    assert len(made) == len(rows)
    forms = set()
    for r in made:
        text = r.text or ""
        tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        digest = sha(f"42:{'' if r.doc_id is None else r.doc_id}")
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        n = len(tokens)
        lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
        form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        cuts = (None, None) if form == "plain" else (len(p), len(m))
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored, r.lang) == (n, form, *cuts, output, text, "en")
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_every_cut_restores(form):
    text = "ab <é> P> <S <M".encode()
    for first in range(len(text) + 1):
        for second in range(first, len(text) + 1):
            assert fill_middle.restore(bytes(fill_middle.transform(text, first, second, form)), form) == text


def test_rotation_in_blocks(monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", 3)
    for n in range(30):
        for middle in range(n + 1):
            buffer = bytearray(range(n))
            fill_middle.rotate(buffer, 0, middle, n)
            assert buffer == bytes([*range(middle, n), *range(middle)])


def test_no_documents_no_rows(spark, docs):
    assert fill_middle.restore_texts(fill_middle.fill_in_middle(docs([]))).count() == 0
    assert suffix_dedup.drop_repeated_spans(docs([])).count() == 0


# ---- substring dedup
def kept_by_listing(texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = defaultdict(int)
    for w in words:
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])] += 1
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for k in range(width)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("seed", "width", "group", "block"), [(1, 5, 1 << 20, 1 << 20), (2, 5, 50, 3000), (3, 35, 40, 2000), (4, 13, 7, 500), (5, 1, 20, 900)])
def test_spans_equal_all_windows(spark, docs, seed, width, group, block):
    rng = random.Random(seed)
    passage = [f"p{rng.randint(0, 9)}" for _ in range(3 * width)]
    texts = [None, "", " \n ", "one", " ".join(passage), "Z" * 5000, " ".join(["same"] * 200)]
    for _ in range(60):
        own = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(0, 80))]
        a, b = sorted(rng.choices(range(len(passage) + 1), k=2))
        at = rng.randint(0, len(own))
        texts.append(rng.choice([" ", "\n", "\t \r"]).join(own[:at] + passage[a:b] * rng.randint(0, 1) + own[at:]) + rng.choice(["", "\n"]))
    texts += texts[-5:] * 3
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    got = suffix_dedup.drop_repeated_spans(docs(rows).repartition(3), width, group, block, keep=("text", "lang")).collect()
    want = sorted((t or "", *k) for t, k in zip(texts, kept_by_listing(texts, width), strict=True))
    assert sorted((r.text or "", r.n_words, r.n_removed, r.kept_text) for r in got) == want
    for r in got:
        spans = [(s.start, s.end) for s in r.spans]
        assert sum(b - a for a, b in spans) == r.n_removed and all(b - a >= width for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_groups_hold_what_they_are_meant_to():
    counts = np.zeros(suffix_dedup.BINS, np.int64)
    counts[[3, 4, 9]] = 40, 50, 1000
    deal = suffix_dedup.Dealer(counts, 100)
    rng = np.random.default_rng(1)
    short = (np.repeat([3, 4, 9], [40, 50, 1000]).astype(np.uint64) << np.uint64(18)).astype(np.uint32)
    group = deal(short, rng.integers(0, 2**63, len(short), np.uint64))
    assert len(set(group[:90])) == 1 and len(set(group[90:])) == 10 and group.max() < deal.groups
    assert np.bincount(group).max() < 160


def test_a_passage_in_a_third_of_all_documents(spark, docs):
    passage = " ".join(f"x{i}" for i in range(50))
    rows = [(i, f"{passage} tail{i}" if i % 3 == 0 else " ".join(f"u{i}-{k}" for k in range(40))) for i in range(600)]
    got = suffix_dedup.drop_repeated_spans(docs(rows), block_bytes=4000, group_size=200).select("doc_id", "n_removed", "kept_text").collect()
    assert {(r.n_removed, r.kept_text) for r in got if r.doc_id % 3 == 0} == {(50, f"tail{i}") for i in range(0, 600, 3)}
    assert all(r.n_removed == 0 for r in got if r.doc_id % 3) and len(got) == 600


def test_extra_columns_may_clash(spark, docs):
    df = docs([(1, "a b c")]).withColumn("n", F.lit(1)).withColumn("block", F.lit(2)).withColumn("group", F.lit(3))
    assert fill_middle.fill_in_middle(df).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert suffix_dedup.drop_repeated_spans(df).first().kept_text == "a b c"
