"""Queries of the operators on the whole corpus: n-gram Jaccard join, benchmark decontamination."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from ledgerleaf.llm.contamination import find_contamination
from ledgerleaf.llm.ngram_join import jaccard_groups
from ledgerleaf.llm.shared import table


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share at least 90 % of their three-word shingles."""
    return jaccard_groups(table(spark, sf_dir, "documents"), 3, Fraction(9, 10))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it contains within the edit budget."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard, "op10_decontamination": op10_decontamination}

_JACCARD_ORACLE = r"""
    with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') as w from documents),
      grams as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from words),
      sizes as (select doc_id, count(*) as n from grams group by doc_id),
      shared as (select x.doc_id as a, y.doc_id as b, count(*) as k from grams x join grams y on x.g = y.g and x.doc_id <> y.doc_id group by all),
      links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
      reach(start, here) as (select doc_id, doc_id from documents union select start, b from reach join links on a = here),
      least as (select start, min(here) as component_id from reach group by start)
    select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
    from documents d left join sizes using (doc_id) join least on start = d.doc_id"""

ORACLES = {"op2_ngram_jaccard": _JACCARD_ORACLE}
