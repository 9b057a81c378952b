"""Jaccard groups, decontamination and the pipeline against brute force, and their edge cases."""

import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerleaf.llm import contamination, ngram_join, queries_corpus

WORDS = [f"w{i}" for i in range(400)]


def shingles(text, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else set(zip(*(words[i:] for i in range(width)), strict=False))


def groups(rows, width, t):
    """Components by comparing all pairs."""
    sets = {i: shingles(x, width) for i, x in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and shared * t.denominator >= t.numerator * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def families(seed, n=18):
    """Families of edited copies around the thresholds, with a common line and passage, shuffled."""
    rng = random.Random(seed)
    line, passage = " ".join(rng.choices(WORDS, k=10)), " ".join(rng.choices(WORDS, k=60))
    texts = [None, "", " \n", "One", "one", "one TWO", "one two", "one two three"]
    for _ in range(n):
        base = rng.choices(WORDS, k=rng.choice([4, 9, 14, 30, 60, 120, 400, 1500]))
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, len(base) // 40, len(base) // 15])):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(WORDS)], [copy[at], rng.choice(WORDS)]])
            texts.append(rng.choice(["", line + "\n", passage + "\n"]) * rng.randint(0, 1) + " ".join(copy).replace(" ", "\n", 1))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "width", "t"), [(1, 3, Fraction(9, 10)), (2, 5, Fraction(8, 10)), (3, 3, Fraction(8, 10))])
def test_groups_equal_all_pairs(docs, monkeypatch, seed, width, t):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    rows = families(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs(rows).repartition(5), width, t).collect()}
    assert got == groups(rows, width, t)


@pytest.mark.parametrize(("seed", "width", "t"), [(4, 3, Fraction(9, 10)), (5, 5, Fraction(8, 10))])
def test_frequent_shingles_change_no_group(docs, monkeypatch, seed, width, t):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    rows = families(seed)
    df = docs(rows).repartition(3)
    assert ngram_join.frequent_shingles(df, width, least=4, counted_from=1) is not None
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(df, width, t, least=4, counted_from=1).collect()}
    assert got == groups(rows, width, t)


def test_a_common_footer_brings_no_documents_together(spark, docs):
    rng = random.Random(6)
    footer = " all rights reserved by us forever and ever"
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) + footer) for i in range(4000)]
    rows += [(4000 + i, t + " x") for i, t in rows[:50]]
    df = docs(rows)
    bands = ngram_join.Bands(Fraction(8, 10), ngram_join.frequent_shingles(df, 5))
    assert bands.frequent is not None
    stars = ngram_join._stars(ngram_join._tile_packs(df, 5, bands, 8))
    assert stars.groupBy("key").count().agg(F.max("count")).first()[0] <= 20  # 4000 and more before
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(df, 5, Fraction(8, 10)).collect()}
    assert got == {**{i: i for i in range(4000)}, **{4000 + i: i for i in range(50)}}


@pytest.mark.parametrize("t", [Fraction(9, 10), Fraction(8, 10)])
@pytest.mark.parametrize("share", [0, 0.2, 0.9])
def test_linked_sets_share_a_tile(t, share):
    rng = np.random.RandomState(4)
    often = np.packbits((rng.random_sample(ngram_join.BINS) < share).astype(np.uint8))
    bands = ngram_join.Bands(t, often if share else None)
    for size in (1, 2, 5, 9, 10, 33, 100, 101, 700, 3000):
        for _ in range(30):
            a = np.unique(rng.randint(0, 2**63, size).astype(np.uint64))
            gone = rng.randint(0, max(1, int(len(a) * (1 - t))) + 1)
            b = np.sort(np.concatenate([a[rng.permutation(len(a))[gone:]], rng.randint(0, 2**63, rng.randint(0, 2 + gone)).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if shared and shared * t.denominator >= t.numerator * (len(a) + len(b) - shared):
                keys = [set(bands.keys(x, ngram_join.mix(x)).tolist()) for x in (a, b)]
                assert keys[0] & keys[1], (size, len(a), len(b))


def test_groups_of_odd_tables(docs):
    assert ngram_join.jaccard_groups(docs([]), 3, Fraction(9, 10)).count() == 0
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, "a b c d"), (9, "x " * 50_000), (None, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs(rows), 3, Fraction(9, 10)).collect())
    assert got == [(-1, 0, None), (-1, 2, None), (3, 2, 3), (7, 2, 3), (7, 2, 3), (9, 1, 9)]
    kept = sorted(str(r.doc_id) for r in ngram_join.keep_one_of_each_group(docs(rows)).collect())
    assert kept == ["3", "9", "None", "None"]


def test_one_id_with_several_texts(docs):
    a, b, c = ("%s one two three four five six" % x for x in ("left", "right", "none"))
    other = "quite another text without any word of those before"
    rows = [(1, a), (5, a), (5, other), (5, other), (8, other + " "), (9, b), (9, b), (9, c), (4, ""), (4, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs(rows), 5, Fraction(8, 10)).collect())
    assert got == [(1, 3, 1), (4, 0, 4), (4, 0, 4), (5, 3, 1), (5, 5, 5), (5, 5, 5), (8, 5, 5), (9, 3, 9), (9, 3, 9), (9, 3, 9)]
    kept = sorted((r.doc_id, r.text or "") for r in ngram_join.keep_one_of_each_group(docs(rows)).collect())
    assert kept == [(1, a), (4, ""), (5, other), (9, c), (9, b)]


def test_very_many_partners_are_dealt_in_groups(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "PARTNERS", 3)
    monkeypatch.setattr(ngram_join, "HELD_ENTRIES", 50)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:58] + [f"own{i}"])) for i in range(40)] + [(90, " ".join(base))]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(docs(rows).repartition(6), 5, Fraction(8, 10)).collect()}
    assert set(got.values()) == {0}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)] + [(60, 50), (55, 60)]
    got = {r.node: r.component for r in ngram_join.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100), 50: 50, 55: 50, 60: 50}


def test_jaccard_query_equals_all_pairs(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries_corpus.op2_ngram_jaccard(spark, small).collect()}
    assert got == groups(rows, 3, Fraction(9, 10))


def distance(item, text):
    """Least edits of the item to any stretch of the text, by the plain table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        last, row = row, [0]
        for i, x in enumerate(item, 1):
            row.append(min(last[i] + 1, row[i - 1] + 1, last[i - 1] + (x != c)))
        best = min(best, row[-1])
    return best


def test_myers_equals_the_plain_table():
    rng = random.Random(8)
    for _ in range(300):
        item, text = ("".join(rng.choices("abc", k=rng.randint(1, n))) for n in (70, 90))
        bits = {c: sum(1 << i for i, x in enumerate(item) if x == c) for c in set(item)}
        want = distance(item, text)
        assert (contamination.best_match(item, bits, text, len(item)) or (len(item),))[0] == want
        if want:
            assert contamination.best_match(item, bits, text, want - 1) is None


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], ["#"], [out[at], "#"]])
    return "".join(out)


@pytest.mark.parametrize("block", [90, 1 << 20])
def test_contamination_equals_all_comparisons(spark, docs, block):
    rng = random.Random(9)
    items = [" ".join(rng.choices(WORDS, k=rng.choice([3, 12, 40]))) for _ in range(9)] + ["", None]
    items += [items[3], items[0]]  # one without an id, one repeated
    texts = [None, "", "short", items[1].upper(), "x " + items[2].replace(" ", " \n ") + " y", " ".join(rng.choices(WORDS, k=3000))]
    texts += [" ".join(rng.choices(WORDS, k=30)) + " " + edited(rng, rng.choice(items[:9]), n) + " tail" for n in (0, 1, 2, 4, 6, 9, 12, 15) for _ in range(3)]
    ids = [*range(len(items) - 2), None, 99]
    benchmark = spark.createDataFrame(list(zip(ids, items, strict=True)), "item_id bigint, text string").withColumn("mark", F.lit("x"))
    got = {(r.doc_id, r.item_id): r.distance for r in contamination.find_contamination(docs(list(enumerate(texts))), benchmark, block_bytes=block).collect()}
    want = {}
    for (i, t), (k, item) in itertools.product(enumerate(texts), zip(ids, items, strict=True)):
        item, t = contamination.normalise(item or ""), contamination.normalise(t or "")
        if item and (d := distance(item, t)) <= int(contamination.RATE * len(item)):
            want[i, k] = d
    assert got == want
    left = contamination.drop_contaminated(docs(list(enumerate(texts))), benchmark, block_bytes=block)
    assert left._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 1
    clean = {r.doc_id for r in left.collect()}
    assert clean == set(range(len(texts))) - {i for i, _ in want}


def test_lightly_altered_leaks_are_found(spark, docs):
    item = "the harbour master wrote down every ship that came before noon in his red book"
    texts = [item.replace("harbour", "station"), "so: " + item.replace(" ", ", ").upper() + "!", item.replace("every", "any").replace("red", "old"), "nothing of the kind", "a ?!?... b"]
    benchmark = spark.createDataFrame([(1, item), (2, "?!?...")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in contamination.find_contamination(docs(list(enumerate(texts))), benchmark).collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 1), (4, 2)} and got[1, 1] == got[4, 2] == 0 and got[0, 1] > int(0.06 * len(item))


def test_contamination_query_equals_all_comparisons(spark, small):
    """The query on the real tables; an exact prefilter-free comparison by the plain Myers distance of every pair."""
    read = lambda name: spark.read.parquet(f"{small}/{name}.parquet").collect()
    got = {(r.doc_id, r.item_id): r.distance for r in queries_corpus.op10_decontamination(spark, small).collect()}
    want = {}
    items = [(r.item_id, contamination.normalise(r.text)) for r in read("benchmark")]
    for r in read("documents"):
        text = contamination.normalise(r.text or "")
        for k, item in items:
            bits = {c: sum(1 << i for i, x in enumerate(item) if x == c) for c in set(item)}
            if len(text) < 1200 and (hit := contamination.best_match(item, bits, text, int(contamination.RATE * len(item)))):
                want[r.doc_id, k] = hit[0]
    short = {r.doc_id for r in read("documents") if len(contamination.normalise(r.text or "")) < 1200}
    assert want and {k: d for k, d in got.items() if k[0] in short} == want


def test_contamination_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination.find_contamination(docs([(1, "a")]), none).count() == 0
    assert contamination.drop_contaminated(docs([(1, "a")]), none).count() == 1
    assert contamination.find_contamination(docs([]), spark.createDataFrame([(1, "a")], none.schema)).count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark, small):
    """The last three stages are redone plainly from what the classifiers keep."""
    documents = spark.read.parquet(f"{small}/documents.parquet")
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, small)
        assert docs.schema == documents.schema or docs.columns == documents.columns, name
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert 0.5 * documents.count() < len(kept) < documents.count()
    first = {i: c for i, (_, c) in groups(kept, 5, Fraction(8, 10)).items()}
    items = [contamination.normalise(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in kept if first[i] == i and not any(contamination.Matcher([(0, b)], contamination.RATE).find(t) for b in items)]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(got) == {i for i, _ in left} and all(r.lossless and r.n_tokens == len(r.ids) for r in got.values())


def test_pipeline_on_odd_documents(spark, docs, tmp_path):
    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog and runs", "en") for i in range(40)] + [(50, None, "en"), (51, "", "en"), (None, "the quick brown fox", "en"), (52, "word " * 30_000, "en")]
    folder = str(tmp_path)
    docs(rows).drop("score").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert 0 in got and 52 in got and None in got and not {50, 51} & got
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_bitmaps_bound_the_difference():
    rng = np.random.RandomState(6)
    for _ in range(60):
        a = np.unique(rng.randint(0, 2**63, rng.randint(1, 3000)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.rand(len(a)) < rng.rand()], rng.randint(0, 2**63, rng.randint(0, 3000)).astype(np.uint64)]))
        differ = ngram_join.differing_bits(ngram_join.wide_signature(a), ngram_join.wide_signature(b))
        assert differ <= len(np.setxor1d(a, b)) and ngram_join.differing_bits(ngram_join.wide_signature(a), ngram_join.wide_signature(a)) == 0
