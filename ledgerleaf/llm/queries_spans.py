"""Queries of the operators on prefixes and substrings: prefix trie, fill-in-middle, substring dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.fill_middle import fill_in_middle, restore_texts
from ledgerleaf.llm.prefix_trie import prefix_trie
from ledgerleaf.llm.shared import table
from ledgerleaf.llm.suffix_dedup import drop_repeated_spans


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text transformed and restored, as digests."""
    done = restore_texts(fill_in_middle(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the words that windows of 35 repeated words cover, as digests."""
    kept = drop_repeated_spans(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op11_prefix_trie": op11_prefix_trie, "op12_fill_in_middle": op12_fill_in_middle, "op13_substring_dedup": op13_substring_dedup}

# CRC-32 is made of the table of its 256 steps, as SQL has no such function.
_TRIE_ORACLE = """
    with recursive steps(i, v, k) as (select range, range::ubigint, 0 from range(256)
        union all select i, case when v % 2 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end, k + 1 from steps where k < 8),
      crc_table as (select list(v order by i) as t from steps where k = 8),
      given as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
      placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as p from given),
      ids as (select distinct conv_id from given),
      crc as (select conv_id, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::ubigint)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) % 256 + 1)::bigint])), 4294967295::ubigint) % 9 as h from ids, crc_table),
      heads as (select c.conv_id, p, role, text from crc c join placed b on b.conv_id = c.conv_id - c.conv_id % 5 and p <= h),
      n_heads as (select c.conv_id, h, count(p) as m from crc c left join heads using (conv_id) group by all),
      rebuilt as (select conv_id, p as d, role, text from heads
        union all select conv_id, p - h + m, role, text from placed join n_heads using (conv_id) where p > h),
      keyed as (select conv_id, d, octet_length(encode(text)) as size,
        sha256(list(sha256(role) || sha256(text)) over (partition by conv_id order by d)::varchar) as node,
        sha256(list(sha256(role) || sha256(text)) over (partition by conv_id order by d rows between unbounded preceding and 1 preceding)::varchar) as up from rebuilt),
      path as (select conv_id, d, size, node, case when d = 1 then '' else up end as up from keyed union all select conv_id, 0, 0, '', null from ids),
      nodes as (select node, any_value(up) as up, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size from path group by node),
      kids as (select up as node, count(*) as n from nodes where up is not null group by up),
      under as (select p.node, u.node as below, u.n_convs, u.size, coalesce(k.n, 0) as n from nodes u
        join path p on p.conv_id = u.conv_id and p.d <= u.depth left join kids k on k.node = u.node),
      sums as (select node, count(*) filter (where n = 0) as n_leaves, sum((n_convs - 1) * size)::bigint as saved_tokens from under group by node),
      ends as (select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as digest from
        (select conv_id, node from path qualify d = max(d) over (partition by conv_id)) group by node)
    select n.conv_id, n.depth::bigint as depth, a.conv_id as parent_conv_id, n.n_convs, coalesce(k.n, 0) as n_children, s.n_leaves, s.saved_tokens,
      coalesce(e.digest, sha256('')) as ends_sha256
    from nodes n join sums s using (node) left join kids k using (node) left join ends e using (node) left join nodes a on a.node = n.up"""

_MIDDLE_ORACLE = r"""
    with given as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as x from documents),
      cut as (select *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w from given),
      drawn as (select *, len(w) as n, ('0x' || x[1:8])::bigint % (len(w) + 1) as a, ('0x' || x[9:16])::bigint % (len(w) + 1) as b,
        ('0x' || x[17:24])::bigint % 100 as c, ('0x' || x[25:32])::bigint % 100 as d from cut),
      formed as (select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or c >= 50 then 'plain'
        when d < 80 then 'spm' else 'psm' end as form, least(a, b) as lo, greatest(a, b) as hi from drawn),
      parts as (select *, array_to_string(w[1:lo], '') as p, array_to_string(w[lo + 1:hi], '') as m, array_to_string(w[hi + 1:n], '') as s from formed)
    select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
      sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
      sha256(text) as restored_sha256
    from parts"""

_SUBSTRING_ORACLE = r"""
    with given as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
      words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as i, len(w) as n from given),
      starts as (select r, i, sha256(string_agg(word, ' ') over (partition by r order by i rows between current row and 34 following)) as key from words qualify i + 34 <= n),
      repeats as (select r, i from starts qualify count(*) over (partition by key) > 1),
      marked as (select w.r, w.i, word, count(x.i) over (partition by w.r order by w.i rows between 34 preceding and current row) as under
        from words w left join repeats x on x.r = w.r and x.i = w.i),
      kept as (select r, count(*) as n, string_agg(word, ' ' order by i) as text from marked where under = 0 group by r)
    select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from given left join kept using (r)"""

ORACLES = {"op11_prefix_trie": _TRIE_ORACLE, "op12_fill_in_middle": _MIDDLE_ORACLE, "op13_substring_dedup": _SUBSTRING_ORACLE}
