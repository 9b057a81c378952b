"""License scans: normalised passages against licence templates by the Dice coefficient over word bigrams.

A passage is a line of a text, the whole text if it has several lines, or any run of its words, which may begin and
end inside lines and cross line breaks: so a wrapped notice, or one among other prose, is compared as a unit. Of runs
that overlap only the best counts, and none that shares a line with a passage of the same licence. Both sides are
lower-cased, every run of other characters than letters and digits becomes one space, and the bags of adjacent word
pairs are compared: dice = 2 * shared / (pairs of the passage + pairs of the template), where a pair repeated on both sides is shared as
often as on the side with fewer. A dice of at least t needs a pair count between t / (2 - t) and (2 - t) / t times
the template's, so a passage's word count alone rules out most templates; it also needs a share of the template's own
pairs, so a text without a word of any sufficient choice of them is out before it is normalised.

Word pairs that no template has end in the scanning task; the others are written once, with their places, and only they
shuffle, keyed by row: a line that a third of the documents carry is no hot key.

Defined results: a null or empty text has no passage; a template of fewer than two words never matches; the template
of the highest dice wins, of equals the first by id. Repeated documents each get their rows. Extra columns are ignored.
Only DataFrame functions run.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.llm.shared import written

#: Licence notices and grants as their authors publish them.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
#: What becomes one space: runs with anything but letters, digits and spaces, and runs of spaces (no single space).
OTHER = " ?[^a-z0-9\\u00C0-\\u024F ][^a-z0-9\\u00C0-\\u024F]*| {2,}"


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), OTHER, " "))


def pair_count(normal: Column) -> Column:
    """Adjacent word pairs of a normalised text: its spaces."""
    return F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit("")))


def word_pairs(normal: Column) -> Column:
    words = F.split(normal, " ")
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def anchor_words(normal: str, low: float) -> set[str]:
    """Words of which every passage near enough to a normalised template has at least one.

    Such a passage has ``low`` of the template's pairs, so of any choice of more pairs than may be missing it has one;
    the longest pairs are chosen, as the rarest, and of each its longer word.
    """
    words = normal.split(" ")
    pairs = sorted(zip(words, words[1:], strict=False), key=lambda p: (-len(p[0]) - len(p[1]), p))
    return {max(p, key=len) for p in pairs[: len(pairs) - math.ceil(low * len(pairs)) + 1]}


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """license, template (its place in the list) and normal, as a relation of literals."""
    rows = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(i).alias("template"), F.lit(text).alias("raw")) for i, (name, text) in enumerate(templates)))
    return spark.range(1).select(F.inline(rows)).select("license", "template", normalise(F.col("raw")).alias("normal"))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Every passage of ``docs`` (doc_id, text) that matches a template.

    Returns doc_id, passage (0: the whole text, else the number of the line or of the run's first line), license, n_pairs and dice (six digits).
    """
    spark = docs.sparkSession
    rows = template_table(spark, templates).select("license", "template", pair_count(F.col("normal")).alias("t_pairs"), "normal").where("t_pairs > 0")
    known = rows.select("t_pairs", "normal").collect()  # the given list of templates
    sizes = {r.t_pairs for r in known}
    if not sizes:
        return docs.select("doc_id", F.lit(0).alias("passage"), F.lit("").alias("license"), F.lit(0).alias("n_pairs"), F.lit(0.0).alias("dice")).where("false")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    anchors = sorted({w for r in known for w in anchor_words(r.normal, low)})
    wanted = rows.select("license", "template", "t_pairs", F.explode(word_pairs(F.col("normal"))).alias("pair")).groupBy("license", "template", "t_pairs", "pair").agg(F.count(F.lit(1)).alias("t_times"))
    given = wanted.select("pair", "t_times").distinct().collect()  # pairs of the given templates
    listed = sorted({r.pair for r in given})

    def found(normal: Column) -> Column:
        """The text's word pairs that templates have: place, first and last line, pairs of the line and of the text."""
        lines = F.filter(F.transform(normal, lambda p, i: F.struct((i + 1).alias("line"), pair_count(p).alias("n_line"), p.alias("normal"))), lambda p: p["normal"] != "")
        words = F.flatten(F.transform(lines, lambda p: F.transform(F.split(p["normal"], " "), lambda w: F.struct(w.alias("word"), p["line"].alias("line"), p["n_line"].alias("n_line")))))
        return F.element_at(F.transform(F.array(words), lambda w: neighbours(w, F.size(normal))), 1)

    def neighbours(words: Column, n_lines: Column) -> Column:
        n = F.size(words) - 1
        both = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.struct(F.concat_ws(" ", a["word"], b["word"]).alias("pair"), a["line"].alias("line"), b["line"].alias("last"), a["n_line"].alias("n_line")))
        placed = F.transform(both, lambda p, i: F.struct(i.alias("pos"), p["pair"].alias("pair"), p["line"].alias("line"), p["last"].alias("last"), p["n_line"].alias("n_line"), n.alias("n_text"), n_lines.alias("n_lines")))
        return F.when(n > 0, F.filter(placed, lambda p: p["pair"].isin(listed)))

    # A text without a letter sequence of any anchor word has no passage near enough; only the others are normalised.
    named = F.exists(F.array(F.lower("text")), lambda t: reduce(or_, (F.contains(t, F.lit(a)) for a in anchors)))
    # As an element of an array the normalised lines are made once, whatever reads them.
    normal = F.transform(F.split(F.col("text"), "\n"), normalise)
    cleaned = F.element_at(F.transform(F.array(normal), found), 1)
    # The row's own number keeps repeated documents apart; it is given before the row is exploded.
    numbered = docs.where(named).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    cut = numbered.select("doc_id", "row", F.inline_outer(cleaned)).where("pair is not null")  # outer: else the arrays are made again to find empty ones
    # The given list of templates bounds the broadcast; written once, as lines and runs both read the pairs found.
    hits = written(cut.join(F.broadcast(wanted), "pair"))
    named_alike = ["row", "doc_id", "license", "template", "t_pairs", "pair", "t_times"]
    lines = hits.where("line = last").select(*named_alike, F.col("line").alias("passage"), F.col("n_line").alias("n_pairs"))
    whole = hits.where("n_lines > 1").select(*named_alike, F.lit(0).alias("passage"), F.col("n_text").alias("n_pairs"))
    passage = ["row", "doc_id", "passage", "n_pairs"]
    inside = (F.col("n_pairs") >= F.col("t_pairs") * low) & (F.col("n_pairs") <= F.col("t_pairs") * high)
    counted = lines.unionByName(whole).where(inside).groupBy(*passage, "license", "template", "t_pairs", "pair", "t_times").agg(F.count(F.lit(1)).alias("times"))
    shared = counted.groupBy(*passage, "license", "template", "t_pairs").agg(F.sum(F.least("times", "t_times")).alias("shared"))
    scored = shared.withColumn("dice", 2 * F.col("shared") / (F.col("n_pairs") + F.col("t_pairs"))).where(F.col("dice") >= threshold)
    best = scored.groupBy(*passage).agg(F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"))
    best = best.select("row", "doc_id", "passage", F.col("best.license").alias("license"), "n_pairs", (-F.col("best.d")).alias("dice"))
    runs = matching_runs(hits, threshold, max(sizes), sorted({r.t_times for r in given}))
    # A run that shares a line with a passage of the same licence is that passage's notice.
    told = best.select(F.col("row").alias("at"), F.col("license").alias("as"), F.col("passage").alias("on"))
    rest = runs.join(told, (F.col("row") == F.col("at")) & (F.col("license") == F.col("as")) & ((F.col("on") == 0) | F.col("on").between(F.col("line"), F.col("last"))), "left_anti")
    out = ["doc_id", "passage", "license", "n_pairs", F.round("dice", 6).alias("dice")]
    return best.select(*out).unionAll(rest.withColumn("passage", F.col("line")).select(*out))


def matching_runs(hits: DataFrame, threshold: float, longest: int, times: Sequence[int]) -> DataFrame:
    """The runs of words, within and across lines, that match a template: the best first, then what overlaps no better one.

    ``hits``: the templates' pairs found in texts, with their places. A best run begins and ends with a shared pair, so
    for each pair as its beginning the shared ones that follow are its ends. Returns row, doc_id, license, start, end,
    line, last, n_pairs and dice.
    """
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    reach = math.ceil(longest * high)
    alike = Window.partitionBy("row", "template", "pair").orderBy("pos")
    # Where the pair stood as many times before as the template has it: in a run from there on it is one too many.
    before = F.coalesce(*(F.when(F.col("t_times") == n, F.lag("pos", n).over(alike)) for n in times), F.lit(-1))
    within = F.floor(F.col("pos") * F.lit(1000) / F.col("t_pairs"))  # places in thousandths of the template
    span = math.ceil(high * 1000) + 1
    near = Window.partitionBy("row", "template").orderBy("within")
    dense = hits.withColumn("before", before).withColumn("within", within).withColumn("around", F.count(F.lit(1)).over(near.rangeBetween(-span, span))).where(F.col("around") >= F.col("t_pairs") * low)
    after = F.sort_array(F.collect_list(F.struct("pos", "before", "last")).over(near.rangeBetween(0, span)))
    held = dense.withColumn("after", after).withColumn("kept", F.filter("after", lambda x: (x["before"] < F.col("pos")) & (x["pos"] >= F.col("pos"))))
    size = lambda x: x["pos"] - F.col("pos") + 1
    ends = F.transform("kept", lambda x, i: F.struct((2 * (i + 1) / (size(x) + F.col("t_pairs"))).alias("dice"), size(x).alias("n_pairs"), x["pos"].alias("end"), x["last"].alias("last")))
    # All ends near enough, not the best alone: a run that ends earlier may be free where the best is not.
    found = held.select("row", "doc_id", "license", "template", F.col("pos").alias("start"), "line", F.inline(F.filter(ends, lambda x: x["dice"] >= threshold)))
    found = found.withColumn("rank", F.struct((-F.col("dice")).alias("d"), "license", "start", (-F.col("n_pairs")).alias("n"), "template"))
    beside = Window.partitionBy("row").orderBy("start").rangeBetween(-reach, reach)
    # A pair of the end is a word more: runs that share a word overlap.
    meets = lambda x: (x["start"] <= F.col("end") + 1) & (F.col("start") <= x["end"] + 1)
    ranked = found.withColumn("all", F.collect_list(F.struct("rank", "start", "end")).over(beside))
    ranked = ranked.withColumn("first", ~F.exists("all", lambda x: meets(x) & (x["rank"] < F.col("rank")))).drop("all")
    ranked = ranked.withColumn("firsts", F.collect_list(F.when(F.col("first"), F.struct("start", "end"))).over(beside))
    ranked = ranked.where(F.col("first") | ~F.exists("firsts", meets)).drop("firsts")
    # Few are left that lost only to one that is out itself: they are taken in order of rank.
    run = F.struct("rank", "start", "end", "license", "line", "last", "n_pairs", "dice")
    lists = ranked.groupBy("row", "doc_id").agg(F.collect_list(F.when(F.col("first"), run)).alias("firsts"), F.sort_array(F.collect_list(F.when(~F.col("first"), run))).alias("others"))
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["start"] <= x["end"] + 1) & (x["start"] <= y["end"] + 1))
    more = F.aggregate("others", F.filter("firsts", lambda x: F.lit(False)), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return lists.select("row", "doc_id", F.inline(F.concat("firsts", more))).drop("rank")
