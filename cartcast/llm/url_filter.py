"""URL filter: rules first, else empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain (last two
labels of the host) and suffix (last label). Each level's good rates are taken
as draws from a beta distribution around the rate of the level above, whose
concentration is estimated from the level's own counts by moments. A host's
posterior is its counts under the prior its domain's posterior mean gives, and
so on up to all pages. The method allows a page when the lower bound of its
host's posterior reaches ``min_good``; a host without labelled pages has the
posterior of its domain, suffix or of all pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartcast.llm.common import UPPER, LOWER, attach, staged

# Rule and verdict, as given.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_GOOD = 0.5
Z = 1.645  # lower end of a one-sided 95 % bound
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
ALLOW, BLOCK = "allow", "block"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    c = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    host = F.translate(F.regexp_extract(c, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(c, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def document_number(path: Column) -> Column:
    """The number that ends a page's path, which names the document it shows (null without one)."""
    return F.regexp_extract(path, r"/(\d{1,18})(?:\.[A-Za-z]+)?/?$", 1).try_cast("long")


def strength(level: DataFrame, parent_rate: str) -> float:
    """Concentration of a level's beta prior by moments, weighting units by their pages.

    With n pages and rate r around m, E[n (r - m)^2] = m (1 - m) (1 + (n - 1) rho)
    and the concentration is 1 / rho - 1.
    """
    m = F.col(parent_rate)
    spread = m * (1 - m)
    s = level.agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - m, 2)).alias("seen"),
        F.sum(spread).alias("noise"),
        F.sum(spread * (F.col("n") - 1)).alias("room"),
    ).first()
    if not s["room"]:
        return LEAST_STRENGTH
    rho = min(max((s["seen"] - s["noise"]) / s["room"], 1 / (MOST_STRENGTH + 1)), 1 / (LEAST_STRENGTH + 1))
    return 1 / rho - 1


def suffix_of(host: str = "host") -> Column:
    return F.substring_index(F.col(host), ".", -1)


def domain_of(host: str = "host") -> Column:
    return F.substring_index(F.col(host), ".", -2)


def reputations(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """Posterior good rate (mean, lower bound) of every host.

    ``outcomes``: host and good (0 or 1) of labelled pages; ``hosts``: distinct
    hosts. Each level is a join of the one above's table; no level gathers a
    host's pages, only its counts.
    """
    counts = staged(
        outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").cast("double").alias("good")), "host-counts"
    ).withColumns({"domain": domain_of(), "suffix": suffix_of()})
    total = counts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    # Half a good and half a bad page stand in for what was never seen.
    overall = ((total["good"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)

    def posterior(level: DataFrame, parent: Column, prefix: str) -> DataFrame:
        level = level.withColumn("__parent", parent)
        s = strength(level.where(F.col("n") > 0), "__parent")
        a = F.col("good") + s * F.col("__parent")
        return level.withColumns({f"{prefix}_mean": a / (F.col("n") + s), f"{prefix}_weight": F.col("n") + F.lit(s)}).drop("__parent")

    def summed(*keys: str) -> DataFrame:
        return counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))

    suffixes = staged(posterior(summed("suffix"), F.lit(overall), "suffix").select("suffix", "suffix_mean", "suffix_weight"), "suffixes")
    domains = summed("domain").withColumn("suffix", F.substring_index("domain", ".", -1)).join(suffixes, "suffix", "left")
    domains = staged(posterior(domains, F.coalesce("suffix_mean", F.lit(overall)), "domain").select("domain", "domain_mean", "domain_weight"), "domains")

    known = (
        hosts.withColumns({"domain": domain_of(), "suffix": suffix_of()})
        .join(counts.select("host", "n", "good"), "host", "left")
        .join(domains, "domain", "left")
        .join(suffixes, "suffix", "left")
        .fillna(0, ["n", "good"])
    )
    parent = F.coalesce("domain_mean", "suffix_mean", F.lit(overall))
    out = posterior(known, parent, "host")
    # A host without labelled pages is known as well as the level that speaks for it.
    weight = F.when(F.col("n") > 0, F.col("host_weight")).otherwise(
        F.coalesce("domain_weight", "suffix_weight", F.lit(float((total["n"] or 0) + 1)))
    )
    deviation = F.sqrt(F.col("host_mean") * (1 - F.col("host_mean")) / (weight + 1))
    return out.select(
        "host", "n", F.col("host_mean").alias("mean"), F.greatest(F.col("host_mean") - Z * deviation, F.lit(0.0)).alias("lower")
    )


def url_verdicts(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    min_good: float = MIN_GOOD,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """id, host, path, rule, verdict for every page, and its host's posterior mean and lower bound.

    A labelled page is good when its document is labelled of quality 1 and not
    toxic; labels name the document by the number ending the page's path.
    Null or malformed urls have an empty host and path, fit no rule and get the
    verdict of all pages' posterior; without labels every posterior is 0.5.
    Repeated rows are judged each; other columns are ignored.
    """
    host, path = host_and_path(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    rows = staged(rows, "page-hosts")
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc"),
        ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int").alias("good"),
    )
    outcomes = rows.withColumn("doc", document_number(F.col("path"))).join(marked, "doc").where("host != ''").select("host", "good")
    hosts = staged(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    known = staged(reputations(outcomes, hosts.select("host")).join(hosts, "host"), "reputations")
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    return attach(rows, known, ["host"], "pages").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(says, F.when(F.col("lower") >= min_good, F.lit(ALLOW)).otherwise(F.lit(BLOCK))).alias("verdict"),
        F.col("mean").alias("good_rate"),
        F.col("lower").alias("good_rate_bound"),
    )
