"""Queries of the operators that use DataFrame functions alone: URL filters, license scans, chat formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.chat_format import rotate_perspectives
from ledgerleaf.llm.license_scan import OTHER, TEMPLATES, scan_licenses
from ledgerleaf.llm.shared import table
from ledgerleaf.llm.url_filters import DOMAIN_PATTERN, HOST, MAX_STRENGTH, MIN_STRENGTH, PATH, SUFFIX_PATTERN, filter_urls, split_url

#: The query contract's rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A page's url path ends in the number of the document that it shows.
DOCUMENT_NUMBER = r"/([0-9]{1,18})(?:[^0-9]|$)"


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n_outcomes, n_good): of every page row the quality labels of the document that the page shows."""
    host, path = split_url(F.col("url"))
    shown = F.regexp_extract(path, DOCUMENT_NUMBER, 1).try_cast("long")
    # Rows that show the same document on the same host are counted before they meet its labels.
    views = pages.select(host.alias("host"), shown.alias("doc_id")).where("doc_id is not null").groupBy("host", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    known = labels.groupBy("doc_id").agg(F.count("quality").alias("n"), F.sum("quality").alias("k"))
    return views.join(known, "doc_id").groupBy("host").agg(F.sum(F.col("rows") * F.col("n")).alias("n_outcomes"), F.sum(F.col("rows") * F.col("k")).alias("n_good"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page; an outcome is the quality label of the document that the page shows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, labelled_outcomes(pages, table(spark, sf_dir, "labels")), RULES)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the documents that matches a licence template."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's perspective: digests of the rendered parts and their masks."""
    parts = rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ";")
    target = F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["start"])
    return parts.select("conv_id", "perspective", "part", "n_turns", F.length("text").alias("n_chars"), target.alias("n_target_chars"), spans.alias("mask"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op1_url_filters": op1_url_filters, "op4_license_scan": op4_license_scan, "op5_chat_formatting": op5_chat_formatting}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _url_oracle() -> str:
    fits = []
    for action, rule in sorted(RULES, key=lambda r: -len(r[1])):
        host, slash, rest = rule.partition("/")
        fits.append((f"((host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{slash}{rest}'))", rule, action))
    rule = " ".join(f"when {f} then '{r}'" for f, r, _ in fits)
    action = " ".join(f"when {f} then '{a}'" for f, _, a in fits)

    def moments(level: str) -> str:
        return f"""{level}_s as (select rate, case when nn = 0 or kk / nn - rate * rate <= 0 then {MAX_STRENGTH}
          else least(greatest((rate - kk / nn) / (kk / nn - rate * rate), {MIN_STRENGTH}), {MAX_STRENGTH}) end as s from (
          select case when sum(n) > 0 then sum(k)::double / sum(n)::double else 0.5 end as rate,
            coalesce(sum(n * (n - 1)), 0)::double as nn, coalesce(sum(k * (k - 1)), 0)::double as kk from {level}))"""

    return f"""
    with split as (select page_id, url,
        coalesce(translate(regexp_extract(url, {_quoted(HOST)}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(url, {_quoted(PATH)}, 1), '') as path from pages),
      hosts as (select host, regexp_extract(regexp_replace(host, '^[^@]*@|:[0-9]*$', '', 'g'), {_quoted(DOMAIN_PATTERN)}, 1) as domain,
        regexp_extract(regexp_replace(host, '^[^@]*@|:[0-9]*$', '', 'g'), {_quoted(SUFFIX_PATTERN)}, 1) as suffix,
        count(quality) as n, coalesce(sum(quality), 0)::bigint as k
        from split left join labels on doc_id = try_cast(regexp_extract(path, {_quoted(DOCUMENT_NUMBER)}, 1) as bigint) group by host),
      domains as (select domain, suffix, sum(n)::bigint as n, sum(k)::bigint as k from hosts group by domain, suffix),
      suffixes as (select suffix, sum(n)::bigint as n, sum(k)::bigint as k from domains group by suffix),
      {moments("hosts")}, {moments("domains")}, {moments("suffixes")},
      suffix_p as (select suffix, (k + s * rate) / (n + s) as m from suffixes, suffixes_s),
      domain_p as (select domain, suffix, (k + s * m) / (n + s) as m from domains join suffix_p using (suffix), domains_s),
      host_p as (select host, n, k, (k + s * m) / (n + s) as mean, n + s as total from hosts join domain_p using (domain, suffix), hosts_s),
      bounded as (select *, round(mean - 1.645::double * sqrt(mean * (1 - mean) / (total + 1)), 9) as bound from host_p)
    select page_id, host, path, case {rule} end as rule,
      case {action} when bound >= 0.5 then 'allow' else 'block' end as verdict,
      n as n_outcomes, k as n_good, round(mean, 9) as reputation, bound
    from split join bounded using (host)"""


def _license_oracle() -> str:
    values = ", ".join(f"({_quoted(name)}, {i}, {_quoted(text)})" for i, (name, text) in enumerate(TEMPLATES))
    other = OTHER.replace("\\u", "\\x{").replace("{00C0", "{00C0}").replace("{024F", "{024F}")
    normal = lambda c: f"trim(regexp_replace(lower({c}), {_quoted(other)}, ' ', 'g'))"
    pairs = lambda c: f"(length({c}) - length(replace({c}, ' ', '')))"
    return f"""
    with given(license, template, raw) as (values {values}),
      normal_t as (select license, template, {normal("raw")} as normal from given),
      t_words as (select license, template, {pairs("normal")} as t_pairs, string_split(normal, ' ') as w from normal_t),
      t_pair as (select license, template, t_pairs, pair, count(*) as t_times from (
        select license, template, t_pairs, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as pair from t_words) group by all),
      lines as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) as passage from documents
        union all select doc_id, text, 0 from documents where contains(text, chr(10))),
      cut as (select doc_id, passage::int as passage, {normal("raw")} as normal from lines),
      fit as (select *, {pairs("normal")} as n_pairs from cut where {pairs("normal")} between (select min(t_pairs) * 0.6 from t_words) and (select max(t_pairs) * 1.6 from t_words)),
      uniq as (select distinct normal, n_pairs from fit),
      p_words as (select normal, n_pairs, string_split(normal, ' ') as w from uniq),
      p_pair as (select normal, n_pairs, pair, count(*) as times from (
        select normal, n_pairs, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as pair from p_words) group by all),
      scored as (select normal, license, template, 2 * sum(least(times, t_times))::double / (n_pairs + t_pairs) as dice
        from p_pair join t_pair using (pair) group by normal, license, template, n_pairs, t_pairs),
      best as (select normal, license, dice, row_number() over (partition by normal order by dice desc, license) as r from scored where dice >= 0.8)
    select doc_id, passage, license, n_pairs::int as n_pairs, round(dice, 6) as dice from fit join best using (normal) where r = 1"""


_CHAT_ORACLE = """
    with said as (select distinct conv_id, coalesce(turn, -1) as turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations),
      placed as (select *, row_number() over (partition by conv_id order by turn, speaker, sha256(text)) - 1 as place from said),
      people as (select distinct conv_id, speaker as perspective from said where speaker <> 'system'),
      wide as (select s.*, p.perspective, (place // 512)::bigint as part,
        case when speaker = perspective then '<|assistant|>' || chr(10) when speaker = 'system' then '<|system|>' || chr(10)
          else '<|user name=' || speaker || '|>' || chr(10) end as head
        from placed s join people p on s.conv_id is not distinct from p.conv_id),
      sized as (select *, head || text || '<|end|>' || chr(10) as piece, sum(length(head) + length(text) + 8) over (
        partition by conv_id, perspective, part order by place rows unbounded preceding)::bigint as stop from wide)
    select conv_id, perspective, part, count(*)::int as n_turns, sum(length(piece))::int as n_chars,
      coalesce(sum(length(text) + 8) filter (where speaker = perspective), 0)::bigint as n_target_chars,
      coalesce(string_agg((stop - length(text) - 8) || '-' || stop, ';' order by place) filter (where speaker = perspective), '') as mask,
      sha256(string_agg(piece, '' order by place)) as text_sha256
    from sized group by conv_id, perspective, part"""

ORACLES = {"op1_url_filters": _url_oracle(), "op4_license_scan": _license_oracle(), "op5_chat_formatting": _CHAT_ORACLE}
