"""URL filter: rules, and host reputation by empirical Bayes where no rule fits.

Each labelled page is an outcome (bad or not) of its host. Bad shares are shrunk
through a chain of beta-binomial priors: all pages -> suffix -> registered
domain -> host. At every level the prior's strength is estimated from how
much the shares of that level's groups differ (moments of the beta-binomial),
and a group's posterior mean is the prior mean of the groups below it. A host's
posterior is Beta(strength * prior + bad, strength * (1 - prior) + good); the page
is blocked if the posterior's lower bound (mean less ``Z`` deviations) passes
``LIMIT``, that is, only where labels make it credible that most pages are bad.
Hosts without labelled pages have their domain's mean as the posterior mean.

The registered domain is the last two labels of the host, or three below one of
the listed two-label suffixes; a host of one label is its own domain and suffix.

Everything is DataFrame expressions. Outcomes are summed per host map-side, so a
host with a third of all pages is one row per task; the reputation (one row per
host) meets the pages in a shuffle join that adaptive execution may split.

Defined cases: a null url, or one without ``://``, has an empty host and path and
is judged by the reputation of the empty host; repeated rows are judged each;
without outcomes nothing is blocked by reputation; an empty table gives no rows;
outcomes that are null do not count; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# The rules in use and the two-label suffixes.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"),
         ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au",
                      "co.jp", "or.jp", "co.nz", "com.br", "co.in", "co.za", "com.mx")
LIMIT, Z = 0.5, 1.645
#: Bounds of a prior's strength, in pages.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), *LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its text) and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, key: str) -> DataFrame:
    """One row: ``{key}_strength``, from the spread of bad shares among groups."""
    total = groups.agg(F.sum("n").alias("n"), F.sum("bad").alias("b"), F.count("*").alias("g"),
                       F.sum(F.col("n") * F.col("n")).alias("nn"),
                       F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb"))
    p = F.col("b") / F.col("n")
    between = F.col("bb") - F.col("n") * p * p
    within = p * (1 - p) * (F.col("g") - 1)
    rho = (between - within) / (p * (1 - p) * (F.col("n") - F.col("nn") / F.col("n")
                                                - (F.col("g") - 1)))
    usable = (F.col("g") > 1) & (p > 0) & (p < 1) & (F.col("n") > F.col("g"))
    return total.select(F.when(usable & (rho > 0), F.greatest(F.lit(LEAST_STRENGTH), F.least(
        F.lit(MOST_STRENGTH), (1 - rho) / rho))).otherwise(F.lit(MOST_STRENGTH))
        .alias(f"{key}_strength"))


def reputation(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, bad_share, bound`` of every host in ``hosts(host)``, from
    ``outcomes(host, bad int)``."""
    seen = (outcomes.where("bad is not null").groupBy("host")
            .agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")))
    table = cut_lineage(
        hosts.select("host").distinct().join(seen, "host", "full_outer")
        .select("host", domain_of(F.col("host")).alias("domain"),
                suffix_of(F.col("host")).alias("suffix"),
                F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = cut_lineage(table.groupBy("suffix", "domain").agg(*sums))
    suffixes = domains.groupBy("suffix").agg(*sums)
    whole = suffixes.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("n")),
                                    F.lit(0.0)).alias("mean"))
    one = whole
    for level, key in ((suffixes, "suffix"), (domains, "domain"), (table, "host")):
        one = one.crossJoin(_strength(level.where("n > 0"), key))     # one row each
    one = F.broadcast(one)

    def shrunk(strength: str, prior: str) -> Column:
        return ((F.col(strength) * F.col(prior) + F.col("bad"))
                / (F.col(strength) + F.col("n")))

    by_suffix = suffixes.crossJoin(one).select(
        "suffix", shrunk("suffix_strength", "mean").alias("suffix_mean"))
    by_domain = domains.join(by_suffix, "suffix").crossJoin(one).select(
        "suffix", "domain", shrunk("domain_strength", "suffix_mean").alias("domain_mean"))
    share = shrunk("host_strength", "domain_mean")
    spread = F.sqrt(share * (1 - share) / (F.col("host_strength") + F.col("n") + 1))
    return table.join(by_domain, ["suffix", "domain"]).crossJoin(one).select(
        "host", share.alias("bad_share"), (share - Z * spread).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_share, bound`` of every row of
    ``pages(page_id, url)``; ``outcomes(host, bad)`` are the labelled pages."""
    url = F.col("url")
    cut = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    known = reputation(cut, outcomes)
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    return (cut.join(known, "host")
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(says, F.when(F.col("bound") > LIMIT, "block")
                               .otherwise("allow")).alias("verdict"),
                    "bad_share", "bound"))
