"""URL filters: rules by host and path, else the reputation of the host.

Labelled page outcomes are counted per host, registered domain and public suffix. Each
level's bad rate is shrunk to that of the level above by a beta-binomial prior: the suffix
to the rate of all pages, the domain to its suffix, the host to its domain. A prior's
strength is estimated from how much more the rates of a level differ than chance explains.
A host is blocked if the lower bound of its posterior is above ``limit``.

Defined results: a url that is null or has no ``://`` has empty host and path and is judged
by the rate of all pages; pages without outcome are judged by what is known of their host,
domain or suffix; outcomes that are null, or of null pages, are ignored; a page with several
outcomes counts as bad if one is; repeated pages are judged row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.tables import lower_ascii
from cartloom.session import materialize

#: Suffixes of two labels under which names are registered; others have one label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
#: A host is blocked if its bad rate is above this with about 95 percent certainty.
LIMIT, DEVIATIONS = 0.5, 1.645
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name (host and path) and action of the longest rule ``(action, host, path)`` that fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, action = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(level: DataFrame) -> float:
    """Strength of the prior that explains how far rates ``bad / n`` differ between the rows."""
    x = level.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") ** 2).alias("squares"),
        F.sum(F.col("bad") ** 2 / F.col("n")).alias("weighted"),
    ).first()
    if not x["n"] or x["k"] < 2 or x["bad"] in (0, x["n"]):
        return MOST_STRENGTH
    mean = x["bad"] / x["n"]
    spread = (x["weighted"] - x["n"] * mean * mean) / (mean * (1 - mean)) - (x["k"] - 1)
    room = x["n"] - x["squares"] / x["n"] - (x["k"] - 1)
    share = spread / room if room > 0 else 0.0
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, (1 - share) / share if share > 0 else MOST_STRENGTH))


def reputation(pages: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Posterior of every host of ``pages (page_id, host)`` from ``outcomes (page_id, bad)``.

    Returns (host, rate, strength) and the figures of all pages. Only hosts, domains and
    suffixes are joined with each other, never pages.
    """
    bad = (
        outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL")
        .groupBy(F.col("page_id").alias("outcome_id")).agg(F.max("bad").alias("bad"))
    )
    counted = (
        pages.join(bad, F.col("page_id") == F.col("outcome_id"), "left")
        .groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    )
    hosts = materialize(
        counted.select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix")), "hosts"
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = (total["bad"] or 0) / total["n"] if total["n"] else 0.0
    s = {name: _strength(df.where("n > 0")) for name, df in (("suffix", suffixes), ("domain", domains), ("host", hosts))}

    def posterior(bad: str, n: str, prior: Column, strength: float) -> Column:
        return (F.col(bad) + prior * strength) / (F.col(n) + strength)

    top = suffixes.select("suffix", posterior("bad", "n", F.lit(base), s["suffix"]).alias("suffix_rate"))
    mid = domains.join(top, "suffix").select("domain", posterior("bad", "n", F.col("suffix_rate"), s["domain"]).alias("domain_rate"))
    rated = hosts.join(mid, "domain").select(
        F.col("host").alias("rated_host"),
        posterior("bad", "n", F.col("domain_rate"), s["host"]).alias("rate"),
        (F.col("n") + s["host"]).alias("strength"),
    )
    return rated, {"rate": base, **s}


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]], limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, and the posterior rate and lower bound behind it."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rated, _ = reputation(parsed.select("page_id", "host"), outcomes)
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    rate, strength = F.col("rate"), F.col("strength")
    bound = rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (strength + 1))
    return parsed.join(rated, F.col("host") == F.col("rated_host"), "left").select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(action, F.when(bound > limit, "block").otherwise("allow")).alias("verdict"),
        "rate", bound.alias("bound"),
    )
