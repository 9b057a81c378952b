"""URL filters, license scans and chat formatting: small cases and their SQL."""

import random
import textwrap
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import license_scan, queries_native, url_filters
from ledgerleaf.llm.chat_format import END, rotate_perspectives

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"))


def judged(spark, urls, outcomes=(), rules=RULES, **more):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    counts = spark.createDataFrame(list(outcomes), "host string, n_outcomes bigint, n_good bigint")
    return {r.page_id: r for r in url_filters.filter_urls(pages, counts, rules, **more).collect()}


def test_urls_and_rules(spark):
    got = judged(spark, ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://notexample.org/en/12", "http://b.org", None, "no scheme", "x://h:80#y", "a://b://c/d", "https://example.org?/es/"])
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [
        ("a.example.org", "/es/x", "example.org/es/"),
        ("example.org", "/en/12", "example.org/en/1"),
        ("notexample.org", "/en/12", "org/"),
        ("b.org", "", None),
        ("", "", None),
        ("", "", None),
        ("h:80", "", None),
        ("b:", "//c/d", None),
        ("example.org", "", None),
    ]
    assert [got[i].verdict for i in range(3)] == ["block", "block", "allow"]


def test_levels(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "u@h.example.net:80": ("example.net", "net"), "": ("", ""), "local": ("local", "local")}
    domain, suffix = url_filters.levels(F.col("h"))
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(domain.alias("d"), suffix.alias("s")).collect()
    assert [(r.d, r.s) for r in got] == list(hosts.values())


def test_reputation_shrinks_and_inherits(spark):
    urls = ["http://good.a.com/1"] * 40 + ["http://bad.b.com/1"] * 40 + ["http://new.b.com/1", "http://new.a.com/1", "http://one.c.com/1"]
    outcomes = [("good.a.com", 30, 30), ("good.a.com", 10, 10), ("bad.b.com", 40, 0), ("one.c.com", 1, 0), ("bad.b.com", None, None)]
    got = judged(spark, urls, outcomes, rules=(), min_rate=0.5)
    assert got[0].verdict == "allow" and got[40].verdict == "block" and (got[0].n_outcomes, got[0].n_good) == (40, 40)
    assert got[80].reputation < 0.5 < got[81].reputation and got[80].n_outcomes == 0
    assert all(r.bound < r.reputation < 1 for r in got.values())


def test_urls_without_outcomes_or_rows(spark):
    got = judged(spark, ["http://a.com/"])
    assert got[0].reputation == 0.5 and got[0].verdict == "block"
    assert judged(spark, []) == {}


def scanned(docs, rows, **more):
    return sorted((r.doc_id, r.passage, r.license, r.dice) for r in license_scan.scan_licenses(docs(rows), **more).collect())


def test_licenses(docs):
    rows = [
        (1, "prose of all kinds\nLicensed under the Apache License, Version 2.0.\nmore prose"),
        (2, "RELEASED under the --MIT-- license"),
        (3, None),
        (4, ""),
        (5, "This work is\nlicensed under the GNU General\nPublic License, version 3."),
        (6, "The license version of under the apache " * 3),
        (7, "word " * 5000),
        (8, "Licensed under the Apache License Version 3"),
    ]
    got = scanned(docs, rows + [rows[1]])
    assert (1, 2, "apache-2.0", 1.0) in got and got.count((2, 1, "mit", 1.0)) == 2 and (5, 0, "gpl-3.0", 1.0) in got
    assert not {3, 4, 6, 7} & {g[0] for g in got}
    assert scanned(docs, []) == [] and scanned(docs, rows, templates=(("x", "word"),)) == []


def test_dice_equals_counting_by_hand(docs):
    template, passage = "a b a b c d e f g h", "a b a b a b c d e f g"
    bag = lambda t: [p for p in zip(t.split(), t.split()[1:])]
    shared = sum(min(bag(template).count(p), bag(passage).count(p)) for p in set(bag(template)))
    assert scanned(docs, [(1, passage)], templates=(("t", template),), threshold=0.5) == [(1, 1, "t", round(2 * shared / (9 + 10), 6))]


def test_perspectives(spark):
    rows = [(1, 0, "system", "be good"), (1, 1, "ann", "hi é"), (1, 2, "bob", None), (1, 3, None, "who"), (1, 1, "ann", "hi é"), (2, 0, "system", "alone"), (None, None, "x", "y")]
    got = {(r.conv_id, r.perspective): r for r in rotate_perspectives(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit(9))).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "x")}
    ann = got[1, "ann"]
    assert ann.text == f"<|system|>\nbe good{END}<|assistant|>\nhi é{END}<|user name=bob|>\n{END}<|user name=unknown|>\nwho{END}"
    assert [ann.text[m.start : m.end] for m in ann.mask] == [f"hi é{END}"]
    assert [got[1, "bob"].text[m.start : m.end] for m in got[1, "bob"].mask] == [END]


def test_long_and_crowded_dialogues_come_in_parts(spark):
    rows = [(1, t, f"p{t % 2}", f"t{t}") for t in range(10)] + [(2, 0, "p", f"t{i}") for i in range(90)] + [(2, 1, "q", "last"), (2, -5, "q", "first"), (2, None, "q", "none")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    got = rotate_perspectives(df, messages_per_part=4).collect()
    whole = {(r.conv_id, r.perspective): r.text for r in rotate_perspectives(df).collect()}
    for conv, who, n in ((1, "p0", 10), (1, "p1", 10), (2, "p", 93), (2, "q", 93)):
        parts = sorted((r.part, r.n_turns, r.text) for r in got if (r.conv_id, r.perspective) == (conv, who))
        assert [p for p, _, _ in parts] == list(range(-(-n // 4))) and {k for _, k, _ in parts[:-1]} == {4} and sum(k for _, k, _ in parts) == n
        assert "".join(t for _, _, t in parts) == whole[conv, who]
    said = [line for line in whole[2, "p"].split("\n") if line and not line.startswith("<|")]
    assert [x.removesuffix("<|end|>") for x in (said[0], said[1], said[-1])] == ["first", "none", "last"]


def equal_to_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("pages", "labels", "documents", "conversations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'' if folder.startswith('/root') else '/*.parquet'}'")
    df = queries_native.QUERIES[name](spark, folder)
    columns = ", ".join(sorted(df.columns))
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(map(key, df.selectExpr(*sorted(df.columns)).collect()))
    assert got == sorted(map(key, con.execute(f"select {columns} from ({queries_native.ORACLES[name]})").fetchall()))
    return got


@pytest.mark.parametrize("name", sorted(queries_native.QUERIES))
def test_queries_equal_their_sql(spark, small, name):
    assert equal_to_sql(spark, small, name)


def test_queries_equal_their_sql_on_odd_rows(spark, tmp_path):
    """Repeated and null page ids, repeated labels, crowded turns, nulls everywhere."""
    folder = str(tmp_path)
    pages = [(1, "http://a.example.com/en/1"), (1, "http://a.example.com/en/1"), (None, "http://a.example.com/en/2"), (None, "http://b.org/fr/3"), (5, None), (6, "none"), (1, "http://b.org/en/77")]
    labels = [(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, None, 0), (None, 1, 0)]
    talks = [(1, 0, "p", f"t{i}") for i in range(1100)] + [(1, 1, "q", "x"), (None, None, None, None), (2, None, "system", "y")]
    frames = {"pages": (pages, "page_id bigint, url string"), "labels": (labels, "doc_id bigint, quality int, toxic int"), "conversations": (talks, "conv_id bigint, turn bigint, role string, text string")}
    frames["documents"] = ([(1, "Released under the MIT License."), (1, None), (None, "")], "doc_id bigint, text string")
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    for name in sorted(queries_native.QUERIES):
        assert len(equal_to_sql(spark, folder, name)) == {"op1_url_filters": 7, "op4_license_scan": 1, "op5_chat_formatting": 7}[name]


def test_wrapped_and_inline_notices(docs):
    templates = dict((n, t) for n, t in license_scan.TEMPLATES)
    code = "\n".join(f"    value{i} = compute(value{i - 1}, {i})" for i in range(60))
    isc = "\n".join(" * " + line for line in textwrap.wrap(templates["isc"], 72))
    cc = templates["cc-by-4.0"]
    rows = [
        (1, f"/* Copyright\n{isc}\n */\n{code}"),
        (2, f"some prose\nAll of the pictures were taken by us last summer. {cc} Ask before you print them in a book of yours."),
        (3, f"one {templates['unlicense']} two three four five {cc} six\nseven " + "words " * 200),
        (4, "\n".join(["prose"] * 5 + [isc] * 40)),
        (5, f"{cc} " * 3),
        (6, code + "\nthis software is provided with permission and the license of the public\n" + code),
    ]
    got = scanned(docs, [*rows, rows[0]])
    assert got.count((1, 2, "isc", 1.0)) == 2 and (2, 2, "cc-by-4.0", 1.0) in got
    assert [g for g in got if g[0] == 3] == [(3, 1, "cc-by-4.0", 1.0), (3, 1, "unlicense", 1.0)]
    height = isc.count("\n") + 1
    assert [g[1:] for g in got if g[0] == 4] == [(6 + height * i, "isc", 1.0) for i in range(40)]
    assert [g[1:] for g in got if g[0] == 5] == [(1, "cc-by-4.0", 1.0)] * 3 and not [g for g in got if g[0] == 6]


def test_runs_equal_trying_all(docs):
    rng = random.Random(4)
    given = (("s", "a b c a b d"), ("t", "c d e f a c d"))
    texts = []
    for _ in range(40):
        words = " ".join(rng.choice(given)[1] for _ in range(4)).split()
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["x"], [words[at], "y"]])
        texts.append(" ".join(words))
    pairs = lambda w: list(zip(w, w[1:]))

    def dice(run, template):
        x, y = Counter(pairs(run)), Counter(pairs(template.split()))
        return 2 * (x & y).total() / (x.total() + y.total())

    want = []
    for k, text in enumerate(texts):
        w = text.split()
        tried = sorted((-d, name, a, -b) for a in range(len(w)) for b in range(a + 2, len(w) + 1) for name, t in given if (d := dice(w[a:b], t)) >= 0.7)
        taken = []
        for d, name, a, b in tried:
            if all(-b <= x or a >= y for x, y in taken):
                taken.append((a, -b))
                want.append((k, 1, name, round(-d, 6)))
    lines = {(k, name) for k, text in enumerate(texts) for name, t in given if dice(text.split(), t) >= 0.7}
    assert len(want) > 100 and not lines and scanned(docs, list(enumerate(texts)), templates=given, threshold=0.7) == sorted(want)
