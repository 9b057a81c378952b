"""Quality, language and language-model scores: held-out accuracy, brute force and edge cases."""

import math
import os
import random
import resource
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import language_id, lm_scoring, quality, queries_models
from ledgerleaf.llm.shared import windows, word_hashes

MIDDLE = "/root/testdata/sf0.01"


def chunk(*texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_word_hashes_and_windows_know_rows():
    texts = ["a b a", "", " \n ", "b a", "é x" + "y" * 200, "a"]
    hashes, bounds = word_hashes(*chunk(*texts))
    words = [w for t in texts for w in t.split()]
    assert np.diff(bounds).tolist() == [len(t.split()) for t in texts]
    assert len({(w, h) for w, h in zip(words, hashes.tolist(), strict=True)}) == len(set(words)) == len(set(hashes.tolist()))
    grams, at = windows(hashes, bounds, 3)
    assert np.diff(at).tolist() == [1, 0, 0, 1, 1, 1] and len(set(grams.tolist())) == 4


def test_statistics_of_rows_stand_alone():
    texts = ["Plain words of a line.\nAnd more!", "", "SHOUT!! SHOUT!! SHOUT!!", "a | b | c"]
    together = quality.text_statistics(*chunk(*texts))
    assert np.allclose(together, np.vstack([quality.text_statistics(*chunk(t)) for t in texts]))
    assert not together[1, :14].any() and together[1, -3] == 0


def test_quality_on_held_out_labels(spark):
    scored = queries_models.op3_quality_classifier(spark, MIDDLE)
    rows = scored.join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert scored.count() == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()


def test_isotonic_fit_is_monotone_and_pools():
    knots, values = quality._pool(np.array([10.0, 10, 10, 10]), np.array([1.0, 5, 3, 9]), np.array([0.1, 0.2, 0.3, 0.4]))
    assert len(knots) == 3 and (np.diff(values) > 0).all() and math.isclose(knots[1], 0.25)


def test_normal_equations_are_the_sum_over_all_rows(spark):
    rng = np.random.RandomState(0)
    x, y = rng.rand(60, quality.STATISTICS), rng.randint(0, 2, 60)
    model = quality.QualityModel(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), rng.randn(quality.STATISTICS, 8), rng.rand(8), np.zeros(9), np.zeros(1), np.zeros(1))
    rows = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)], "stats array<double>, label int").repartition(5)
    z = np.hstack([model.cosines(x), y[:, None]])
    assert np.allclose(quality._normal_equations(rows, model), z.T @ z)


def test_quality_without_labels_and_odd_rows(spark, docs):
    rows = docs([(None, None), (1, ""), (2, "x" * 100_000), (2, "x" * 100_000)])
    stats = quality.statistics_table(rows)
    none = spark.createDataFrame([], "doc_id bigint, label int")
    assert {r.score for r in quality.score_statistics(stats, quality.fit_quality(stats, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None), (2, 1), (9, 0)], "doc_id bigint, label int")
    model = quality.fit_quality(stats, odd)
    assert quality.keep_good_documents(rows, model, 0.0).count() == 4 and quality.keep_good_documents(rows, model).columns == rows.columns
    assert quality.statistics_table(docs([])).count() == 0


def test_language_on_held_out_documents(spark):
    rows = queries_models.op8_language_id(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_kernel_is_the_normalised_intersection():
    present = language_id.presences(*chunk("abc abd", "ABD", ""))
    sets = [set(np.flatnonzero(p)) for p in present]
    want = {language_id.presences(*chunk(t)).nonzero()[1].tolist().__len__() for t in ("abd",)}
    assert sets[1] <= sets[0] and {len(sets[1])} == want and not sets[2]
    marks = present[:2] / np.sqrt(present[:2].sum(1, keepdims=True))
    model = language_id.LanguageModel(["a", "b"], marks.astype(np.float32), np.eye(2, dtype=np.float32))
    assert np.allclose(model.scores(present[:1])[0], [1, len(sets[1]) / math.sqrt(len(sets[0]) * len(sets[1]))], atol=1e-6)


def test_language_edge_cases(docs):
    rows = docs([(i, "the cat sat on the mat and the hat", "en") for i in range(20)] + [(100 + i, "der hund und die katze gehen aus dem haus", "de") for i in range(20)] + [(200, None, "en"), (201, "12 34 !", "en"), (202, "日本", None), (203, "the hat", None)])
    model = language_id.fit_language(rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify_languages(rows, model).collect()}
    assert got[200] == got[201] == ("und", 0.0) and got[202][0] in ("de", "en") and got[203][0] == "en" and got[0][0] == "en" and got[100][0] == "de"
    assert {200, 201}.isdisjoint(r.doc_id for r in language_id.keep_known_languages(rows, model).collect())
    none = language_id.fit_language(docs([]))
    assert {r.lang_pred for r in language_id.identify_languages(rows, none).collect()} == {"und"}


def test_texts_in_no_learnt_language_go(spark, docs):
    rng = random.Random(5)
    real = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text", "lang").collect() if r.text]
    russian = "Старый рыбак вышел из дома рано утром и долго смотрел на холодное море, а потом вернулся к своей лодке. "
    chinese = "老渔夫清早离开家，望着寒冷的大海看了很久，然后回到自己的船上。"
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    foreign = [russian, russian * 20, russian * 2000, chinese, chinese * 60, noise(2000), noise(200_000), "7 1 9 x " + " ".join(str(rng.random()) for _ in range(200))]
    long = [(-100 - i, " ".join(t for _, t, at in real if at == lang), None) for i, lang in enumerate(sorted({x for _, _, x in real if x}))]
    model = language_id.fit_language(docs(real))
    table = docs([*real, *long, *((-1 - i, t, None) for i, t in enumerate(foreign))])
    kept = {r.doc_id for r in language_id.keep_known_languages(table, model).select("doc_id").collect()}
    assert not [i for i in range(len(foreign)) if -1 - i in kept]
    assert all(i in kept for i, _, _ in long) and len(kept) - len(long) > 0.99 * len(real)


def brute_force(texts, train):
    """Scores by dictionaries: (tokens, known, base, score) of each text; and all training tokens."""
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = [[w for w in (t or "").translate(upper).replace("\n", " ").split(" ") if w] + ["</s>"] for t in texts]
    threes = lambda t: zip(["<s>", "<s>", *t[:-1]], ["<s>", *t[:-1]], t, strict=False)
    count = Counter(w for t, k in zip(cut, train, strict=True) if k for w in t)
    c = Counter(x for t, k in zip(cut, train, strict=True) if k for x in threes(t))
    a = Counter((v, w) for _, v, w in c)
    b = Counter(w for _, w in a)
    total, size = sum(count.values()), len(count)

    def level(counts):
        discounts = lm_scoring._discounts([sum(x == k for x in counts.values()) for k in (1, 2, 3, 4)])
        sums, kinds = Counter(), defaultdict(lambda: [0, 0, 0])
        for gram, k in counts.items():
            sums[gram[:-1]] += k
            kinds[gram[:-1]][min(k, 3) - 1] += 1

        def p(gram, below):
            if not sums[gram[:-1]]:
                return below
            k = counts[gram]
            own = k - discounts[min(k, 3) - 1] if k else 0
            return (own + sum(x * y for x, y in zip(discounts, kinds[gram[:-1]], strict=True)) * below) / sums[gram[:-1]]

        return p

    two, three = level(a), level(c)
    f = lm_scoring._discounts([sum(x == k for x in b.values()) for k in (1, 2, 3, 4)])
    unknown = sum(f[min(k, 3) - 1] for k in b.values()) / sum(b.values()) / (size + 1)
    lowest = lambda w: (b[w] - f[min(b[w], 3) - 1] if b[w] else 0) / sum(b.values()) + unknown
    p = lambda u, v, w: three((u, v, w), two((v, w), lowest(w)))
    return [(len(t), sum(count[w] > 0 for w in t), sum(math.log10((count[w] + 1) / (total + size + 1)) for w in t), sum(math.log10(p(*x)) for x in threes(t))) for t in cut], total, p


@pytest.mark.parametrize("spread", [False, True])
def test_lm_scores_equal_brute_force(spark, small, monkeypatch, spread):
    if spread:  # many shards, and the commonest words spread over several
        monkeypatch.setattr(lm_scoring, "TRIGRAMS_A_SHARD", 1500)
        monkeypatch.setattr(lm_scoring, "WORDS_A_SHARD", 2000)
    got = {r.doc_id: r for r in queries_models.op7_lm_scoring(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    train = [zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for r in rows]
    want, total, _ = brute_force([r.text for r in rows], train)
    for r, t, w in zip(rows, train, want, strict=True):
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (not t, *w[:2], total)
        assert math.isclose(g.base_score, w[2], rel_tol=1e-9) and math.isclose(g.score, w[3], rel_tol=1e-9)
        assert math.isclose(g.perplexity, 10 ** (-w[3] / w[0]), rel_tol=1e-6)


def test_lm_edge_cases(spark, docs):
    rows = docs([(1, None), (2, ""), (3, "a b a b a c"), (3, "a b a b a c"), (4, "z " * 20_000), (None, "b a")])
    model = lm_scoring.train(rows.where("doc_id < 4"))
    got = {r.doc_id: r for r in lm_scoring.score_texts(rows, model).collect()}
    want, _, _ = brute_force([None, "", "a b a b a c", "a b a b a c", "z " * 20_000, "b a"], [True, True, True, True, False, False])
    for ident, w in ((1, want[0]), (3, want[2]), (4, want[4]), (None, want[5])):
        assert (got[ident].n_tokens, got[ident].n_known) == w[:2] and math.isclose(got[ident].score, w[3], rel_tol=1e-9)
    nothing = lm_scoring.train(rows.where("false"))
    assert {(r.n_known, r.score) for r in lm_scoring.score_texts(rows, nothing).collect()} == {(0, 0.0)}
    assert lm_scoring.score_texts(docs([]), model).count() == 0


def test_probabilities_of_a_context_sum_to_one():
    texts = ["a b c a b d", "a c b a", "b a b a c"]
    _, _, p = brute_force(texts, [True] * 3)
    every = sorted({w for t in texts for w in t.split()}) + ["</s>", "never seen"]
    for u, v in (("a", "b"), ("<s>", "<s>"), ("x", "b"), ("x", "y")):
        assert math.isclose(sum(p(u, v, w) for w in every), 1.0, rel_tol=1e-9)


def test_tables_find_what_they_hold(tmp_path):
    rng = np.random.RandomState(2)
    key = np.unique(rng.randint(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    counts = rng.randint(1, 600, len(key))
    lm_scoring.save_table(f"{tmp_path}/three-0", key, counts)
    model = lm_scoring.Model(str(tmp_path))
    asked = np.concatenate([key, key + np.uint64(1 << 40), np.array([0, 2**64 - 1], np.uint64)])
    assert model.counts("three", asked, np.zeros(len(asked), np.int32)).tolist() == [*counts.tolist(), *[0] * (len(key) + 2)]


def crc_fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_quality_query_equals_plain_numpy(spark, small):
    """Standardising, cosines, ridge, pooling and interpolation redone over all rows at once."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r.quality is not None and r.doc_id in docs]
    stats = {i: quality.text_statistics(*chunk(t))[0] for i, t in docs.items()}
    fitting = [(stats[i], y) for i, y in labels if crc_fold(i, 5) > 1]
    x, y = np.array([a for a, _ in fitting]), np.array([float(b) for _, b in fitting])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    rng = np.random.RandomState(11)
    w, b = rng.randn(quality.STATISTICS, 128) / 3.0, rng.uniform(0, 2 * np.pi, 128)
    features = lambda v: np.append(np.sqrt(2 / 128) * np.cos(((v - mean) / scale) @ w + b), 1.0)
    z = np.array([features(v) for v in x])
    solved = np.linalg.lstsq(np.vstack([z, np.sqrt(1e-3 * len(z) / 128) * np.eye(129)]), np.append(y, np.zeros(129)), rcond=None)[0]
    width = (quality.HIGHEST - quality.LOWEST) / quality.BINS
    bins = defaultdict(list)
    for i, label in labels:
        if crc_fold(i, 5) == 1:
            bins[int((np.clip(features(stats[i]) @ solved, quality.LOWEST, quality.HIGHEST) - quality.LOWEST) / width)].append(label)
    pools = [[len(v), sum(v), len(v) * (quality.LOWEST + (k + 0.5) * width)] for k, v in sorted(bins.items())]
    at = 0
    while at + 1 < len(pools):  # merge neighbours out of order until none is left
        if pools[at][1] / pools[at][0] >= pools[at + 1][1] / pools[at + 1][0]:
            pools[at : at + 2] = [[p + q for p, q in zip(pools[at], pools[at + 1], strict=True)]]
            at = max(at - 1, 0)
        else:
            at += 1
    knots, values = [p[2] / p[0] for p in pools], np.maximum.accumulate([(p[1] + 0.5) / (p[0] + 1) for p in pools])
    got = {r.doc_id: r for r in queries_models.op3_quality_classifier(spark, small).collect()}
    assert set(got) == set(docs)
    for i, v in stats.items():
        assert math.isclose(got[i].score, np.interp(features(v) @ solved, knots, values), abs_tol=2e-3), i
        assert got[i].held_out == (crc_fold(i, 5) == 0) and got[i].predicted == int(got[i].score >= 0.3)


def test_quality_of_odd_rows(spark, docs):
    texts = [(None, "no id"), (1, None), (1, "same"), (1, "same"), (2, ""), (3, "long " * 40_000)] + [(10 + i, "Some words here. " * (i % 3 + 1)) for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1), (4, None), (1, 1)], "doc_id bigint, label int")
    stats = quality.statistics_table(docs(texts))
    scores = quality.score_statistics(stats, quality.fit_quality(stats, labels)).collect()
    assert len(scores) == len(texts) and all(0 <= r.score <= 1 for r in scores)
    none = quality.fit_quality(stats, labels.where("doc_id > 1000"))
    assert {r.score for r in quality.score_statistics(stats, none).collect()} == {0.5}


def test_language_query_equals_plain_kernels(spark, small):
    """The sample, landmarks, Nystroem map and ridge redone with sets of n-gram places and plain solvers."""
    rows = spark.read.parquet(f"{small}/documents.parquet").withColumn("draw", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))).collect()
    present = {r.doc_id: language_id.presences(*chunk(r.text or ""))[0].astype(np.float64) for r in rows}
    usable = sorted((r.draw, r.lang, r.doc_id) for r in rows if r.lang and r.text is not None and crc_fold(r.doc_id, 4) != 2)
    languages = sorted({lang for _, lang, _ in usable})
    taken, sample, marks = Counter(), [], []
    for _, lang, i in usable:
        if taken[lang] < 96 // len(languages):
            marks.append(i)
        if taken[lang] < 600:
            sample.append((i, languages.index(lang)))
        taken[lang] += 1
    unit = lambda i: present[i] / np.sqrt(max(present[i].sum(), 1))
    m = np.array([unit(i) for i in marks])
    k = np.array([unit(i) for i, _ in sample]) @ m.T
    values, vectors = np.linalg.eigh(m @ m.T)
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    target = -np.ones((len(sample), len(languages)))
    target[np.arange(len(sample)), [j for _, j in sample]] = 1
    z = k @ root
    weights = root @ np.linalg.inv(z.T @ z + 1e-3 * len(sample) * np.eye(len(marks))) @ z.T @ target
    got = {r.doc_id: r for r in queries_models.op8_language_id(spark, small).collect()}
    for r in rows:
        whole = (r.text or "").encode()
        cut = [whole[at : at + language_id.PIECE] for at in range(0, len(whole), language_id.PIECE)]
        places = [language_id.presences(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0].astype(np.float64) for x in cut]
        raw = sum((len(x) / len(whole) * (p / np.sqrt(max(p.sum(), 1)) @ m.T @ weights) for x, p in zip(cut, places, strict=True)), np.zeros(len(languages)))
        if not any(map(str.isalpha, r.text or "")):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
        else:
            assert math.isclose(got[r.doc_id].score, min(max((raw.max() + 1) / 2, 0), 1), abs_tol=2e-3)
            assert got[r.doc_id].lang_pred == languages[int(raw.argmax())] or np.sort(raw)[-1] - np.sort(raw)[-2] < 1e-3


def test_language_learns_from_every_row(spark, docs):
    """Weights and cuts of all learning rows, redone with dense presences: 10 a language is no bound on rows, only on weight."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows += [(1000, "", "en"), (1001, "é", "de"), (1002, "zz " * 100_000, "en"), rows[0], rows[0], (None, "no id", "en"), (1003, "no lang", None)]
    model = language_id.fit_language(docs(rows).repartition(3), per_language=10, landmarks=16)
    learnt = [(t.encode(), lang) for i, t, lang in rows if i is not None and lang and t is not None and crc_fold(i, 4) != 2]
    languages = sorted({lang for _, lang in learnt})
    count = Counter(lang for _, lang in learnt)
    assert model.languages == languages and max(count.values()) > 20 and any(len(t) > 1 << 18 for t, _ in learnt)
    whole = lambda x: language_id.presences(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0].astype(np.float64)
    own = (model.landmarks > 0).astype(np.float64)
    m = own / np.sqrt(np.maximum(own.sum(1, keepdims=True), 1))
    present = [whole(t) for t, _ in learnt]
    k = np.array([p / np.sqrt(max(p.sum(), 1)) @ m.T for p in present])
    w = np.array([min(1, 10 / count[lang]) for _, lang in learnt])[:, None]
    values, vectors = np.linalg.eigh(m @ m.T)
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for _, lang in learnt])
    z = k @ root
    assert np.allclose(model.weights, root @ np.linalg.solve(z.T @ (w * z) + 1e-3 * w.sum() * np.eye(len(m)), z.T @ (w * target)), atol=2e-3)
    found = defaultdict(list)
    for (t, _), p in zip(learnt, present, strict=True):
        low = language_id.fold_case(np.frombuffer(t, np.uint8)).tobytes()
        others, known = own[(own != p).any(1)], {}
        for n in (8 << k for k in range(9)):
            for at in range(0, len(t) - n + 1, n):
                if (x := low[at : at + n]) not in known:
                    known[x] = (others @ (piece := whole(x))).max() / piece.sum()
                found[n].append((known[x], 1 / (len(t) // n)))
    for cut, n in zip(model.cuts, sorted(found), strict=True):
        shares, each = zip(*sorted(found[n]), strict=True)
        upto = np.cumsum(each)
        want = shares[int(np.searchsorted(upto, 0.005 * upto[-1], side="right"))]
        assert abs(cut / language_id.SLACK - want) <= 1 / 4096 + 1e-9


def test_language_ties_repeats_and_long_texts(spark, docs):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("aaa bbb", "xx"), ("aaa bbb", "aa")] * 20)]
    rows += [(100, "ccc ddd " * 60_000, "aa"), (100, "ccc ddd " * 60_000, "aa"), (None, "aaa bbb", None)]
    model = language_id.fit_language(docs(rows))
    got = language_id.identify_languages(docs(rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    tied = {r.lang_pred for r in got if r.doc_id is None or r.doc_id < 100}
    assert len(tied) == 1 and tied <= {"aa", "xx"} and len({(r.lang_pred, r.score) for r in got if r.doc_id == 100}) == 1
    even = language_id.LanguageModel(["aa", "xx"], model.landmarks, np.ones((len(model.landmarks), 2), np.float32))
    assert even.predict(*chunk("aaa bbb"))[0] == ["aa"]


def test_mapped_files_keep_no_descriptor(tmp_path):
    """More shards than a process may have open files."""
    from ledgerleaf.llm import lm_scoring

    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (min(soft, 1024), hard))
    try:
        model = lm_scoring.Model(str(tmp_path))
        key = np.sort(np.random.RandomState(1).randint(0, 2**63, 50).astype(np.uint64))
        for k in range(500):
            lm_scoring.save_table(f"{tmp_path}/t-{k}", key + np.uint64(k), np.arange(50) + 250)
        held = len(os.listdir("/proc/self/fd"))
        tables = [model.files(f"t-{k}", lm_scoring.COUNTED) for k in range(500)]
        assert len(os.listdir("/proc/self/fd")) == held
        for k, (starts, low, count, _, large) in enumerate(tables):
            at, there = lm_scoring.find(starts, low, key + np.uint64(k))
            assert there.all() and (at == np.arange(50)).all() and count[4] == 254 and large[-1] == 299
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
