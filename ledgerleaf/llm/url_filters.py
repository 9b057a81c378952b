"""URL filters: explicit allow/block rules, then empirical-Bayes host reputation.

Labelled page outcomes (1 good, 0 bad) are counted per host. Each level's rate is shrunk towards the level above
through a beta-binomial prior: host to registered domain to suffix to the whole corpus. The prior strength of a level
comes from its moments, written as ratios of whole-number sums, so every engine that sums them gets the same value:

    m1 = sum(k) / sum(n),  m2 = sum(k (k - 1)) / sum(n (n - 1)),  strength = (m1 - m2) / (m2 - m1^2)

A host passes if the lower bound of its posterior (mean less ``z`` standard deviations) reaches ``min_rate``.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by the reputation of
the empty host. A host without outcomes has its domain's posterior mean and the host level's strength. Every row of
``pages`` gets a row, repeated and null page_ids too, as nothing is joined by page_id; null counts are 0. Without any
outcome the corpus rate is 0.5. An empty table gives no rows; extra columns are ignored.

Only DataFrame functions run; the joins are keyed by host, domain and suffix, so AQE splits a host that holds a
large share of the pages, and counting combines before it shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.shared import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
BARE = r"^[^@]*@|:[0-9]*$"
#: Suffixes of two labels under which names are registered. Any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
MAX_STRENGTH, MIN_STRENGTH = 10000.0, 1.0


_SUFFIX = "|".join(s.replace(".", r"\.") for s in TWO_LABEL_SUFFIXES) + "|[^.]*"
#: Group 1: a host's suffix; its registered domain, which is the suffix and one label more.
SUFFIX_PATTERN = rf"(?:^|\.)({_SUFFIX})$"
DOMAIN_PATTERN = rf"(?:^|\.)((?:[^.]*\.)?(?:{_SUFFIX}))$"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; the host's A-Z are lower-cased, both are empty without ``://``."""
    host = F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; user names and ports don't count."""
    bare = F.regexp_replace(host, BARE, "")
    return F.regexp_extract(bare, DOMAIN_PATTERN, 1), F.regexp_extract(bare, SUFFIX_PATTERN, 1)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, null if none does. ``rules``: (action, "host/path prefix")."""
    hit: Column | None = None
    action: Column | None = None
    for what, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0] != "block")):
        cut = re.match(r"[^/]*", rule).end()
        name, prefix = rule[:cut], rule[cut:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        hit = F.when(fits, rule) if hit is None else hit.when(fits, rule)
        action = F.when(fits, what) if action is None else action.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if hit is None else (hit, action)


def _strength(counts: DataFrame) -> tuple[float, float]:
    """(corpus rate, prior strength) from a level's (n, k) rows: one row of five sums comes to the driver."""
    n, k = F.col("n"), F.col("k")
    big = "decimal(38,0)"
    s = counts.agg(*(F.coalesce(F.sum(x.cast(big)), F.lit(0)).cast("double").alias(a) for a, x in (("n", n), ("k", k), ("nn", n * (n - 1)), ("kk", k * (k - 1))))).first()
    rate = s.k / s.n if s.n else 0.5
    if not s.nn:
        return rate, MAX_STRENGTH
    second = s.kk / s.nn
    spread = second - rate * rate
    if spread <= 0:
        return rate, MAX_STRENGTH
    return rate, min(max((rate - second) / spread, MIN_STRENGTH), MAX_STRENGTH)


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior of every host of ``outcomes`` (host, n_outcomes, n_good: any number of rows a host, counts or null).

    Returns host, n_outcomes, n_good, reputation (posterior mean) and bound (its lower bound).
    """
    domain, suffix = levels(F.col("host"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    # Written once: the sums of every level and the shrinking read it.
    hosts = cut_lineage(outcomes.groupBy("host").agg(total("n_outcomes").alias("n"), total("n_good").alias("k")).select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"))
    domains = cut_lineage(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    (rate, by_suffix), (_, by_domain), (_, by_host) = (_strength(x) for x in (suffixes, domains, hosts))

    def shrunk(prior: Column | float, strength: float) -> Column:
        prior = F.lit(prior) if isinstance(prior, float) else prior
        return (F.col("k") + F.lit(strength) * prior) / (F.col("n") + F.lit(strength))

    suffixes = suffixes.select("suffix", shrunk(rate, by_suffix).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", shrunk(F.col("suffix_mean"), by_domain).alias("domain_mean"))
    scored = hosts.join(domains, ["domain", "suffix"]).select("host", "n", "k", shrunk(F.col("domain_mean"), by_host).alias("mean"))
    mean, counted = F.col("mean"), F.col("n") + F.lit(by_host)
    bound = mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (counted + 1))
    return scored.select("host", F.col("n").alias("n_outcomes"), F.col("k").alias("n_good"), F.round("mean", 9).alias("reputation"), F.round(bound, 9).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], min_rate: float = 0.5, z: float = 1.645) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url). ``outcomes``: (host, n_outcomes, n_good), any number of rows a host.

    Returns page_id, host, path, rule, verdict ('allow' or 'block'), n_outcomes, n_good, reputation, bound.
    """
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    none = F.lit(0).cast("long")
    rated = host_reputation(outcomes.select("host", "n_outcomes", "n_good").unionAll(split.select("host", none, none)), z)
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("bound") >= min_rate, "allow").otherwise("block")
    return split.join(rated, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, judged).alias("verdict"), "n_outcomes", "n_good", "reputation", "bound")
