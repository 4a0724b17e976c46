"""Mixing sources to target weights by soft domain membership [native].

A classifier learned from a labelled table gives each document a posterior over
domains: multinomial naive Bayes over hashed words, its log-likelihoods taken
per word so that long texts do not become certainties. Then nonnegative
document rates are fitted so that the expected domain totals of tokens,
``sum_i rate_i * tokens_i * p(domain | i)``, match the targets: projected
gradient steps on the least-squares distance, each one an aggregate over the
documents. Only built-in DataFrame expressions are used.

The fit is over rates, not over domains: rates start at 1 and move along the
posteriors, so documents of mixed membership move less than clear ones.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartcast.llm.common import staged, with_small_side

SLOTS = 1 << 14  # hashed words; bounds the classifier whatever the vocabulary
MAX_ROWS = 20_000  # labelled documents the classifier learns from, the first by a hash of the id
PRIOR_WORDS = 1000.0
SHARPNESS = 40.0  # weight of a text's mean log-likelihood per word against the prior
STEPS = 25
RIDGE = 1e-4  # keeps a step bounded for domains with next to no tokens
TOLERANCE = 1e-6  # share of all tokens by which domain totals may miss their targets

#: Domains of the driver's labels and the shares of tokens wanted.
DOMAINS = {"clean": 0.96, "toxic": 0.02, "poor": 0.02}


def label_domain() -> Column:
    """Domain of a row of ``labels``: poor, toxic or clean; null without a quality label."""
    return (
        F.when(F.col("quality") == 0, F.lit("poor"))
        .when(F.col("toxic") == 1, F.lit("toxic"))
        .when(F.col("quality") == 1, F.lit("clean"))
    )


def domain_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id and domain of the labelled documents."""
    return labels.select(id_col, label_domain().alias("domain")).where("domain IS NOT NULL")


def words(text: str) -> Column:
    """Lower-cased words between white space; empty for null or blank text."""
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[ \t-\r]+")
    return F.filter(parts, lambda w: w != "")


def slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def classifier(
    docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, max_rows: int
) -> tuple[Column, list[float]]:
    """Per-slot log probabilities by domain (one array column, domain-major) and log priors.

    ``labelled``: id and ``domain``. A domain's counts are smoothed by
    ``PRIOR_WORDS`` words of all domains' text, so what a domain has seen
    little of speaks neither for nor against it.
    """
    chosen = (
        labelled.where(F.col("domain").isin(domains) & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("__mx_id"), F.col("domain").alias("__mx_domain"))
        .orderBy(F.xxhash64("__mx_id"), "__mx_id", "__mx_domain")
        .limit(max_rows)
    )
    chosen = staged(chosen, "mix-labels")
    texts = docs.select(F.col(id_col).cast("long").alias("__mx_id"), words(text_col).alias("__mx_words"))
    counts = (
        with_small_side(texts, chosen, ["__mx_id"])
        .select("__mx_domain", F.explode("__mx_words").alias("w"))
        .groupBy("__mx_domain", slot(F.col("w")).alias("slot"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    index = F.array_position(F.array(*map(F.lit, domains)), F.col("__mx_domain")).cast("int") - 1
    counts = staged(counts.select(index.alias("d"), "slot", "n"), "mix-counts")
    totals = dict.fromkeys(range(len(domains)), 0) | {r["d"]: r["n"] for r in counts.groupBy("d").agg(F.sum("n").alias("n")).collect()}
    rows = {r["__mx_domain"]: r["n"] for r in chosen.groupBy("__mx_domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = sum(rows.values()) + len(domains)
    priors = [math.log((rows.get(d, 0) + 1) / every) for d in domains]
    # One row holding the whole table, len(domains) * SLOTS numbers, read as a scalar subquery.
    spark = docs.sparkSession
    grid = spark.range(len(domains) * SLOTS).select(
        F.col("id").alias("at"), (F.col("id") / SLOTS).cast("int").alias("d"), (F.col("id") % SLOTS).cast("int").alias("slot")
    )
    everything = sum(totals.values()) + SLOTS
    shared = counts.groupBy("slot").agg(F.sum("n").alias("all"))
    prior = PRIOR_WORDS * (F.coalesce("all", F.lit(0)) + 1) / F.lit(float(everything))
    total = F.element_at(F.array(*[F.lit(totals[k] + PRIOR_WORDS) for k in range(len(domains))]), F.col("d") + 1)
    filled = grid.join(counts, ["d", "slot"], "left").join(shared, "slot", "left").select(
        "at", F.log((F.coalesce("n", F.lit(0)) + prior) / total).cast("float").alias("lp")
    )
    table = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "lp"))), lambda s: s["lp"]).alias("lp"))
    return staged(table, "mix-table").scalar(), priors


def with_posteriors(docs: DataFrame, table: Column, priors: list[float], id_col: str, text_col: str) -> DataFrame:
    """The documents with ``__mx_id``, ``__mx_tokens`` (words) and ``__mx_p`` (array over domains)."""
    w, keep = F.col("__mx_words"), list(docs.columns)
    rows = docs.withColumns({"__mx_id": F.col(id_col).cast("long"), "__mx_words": words(text_col)})
    rows = rows.select(
        *keep, "__mx_id", F.size(w).cast("long").alias("__mx_tokens"), F.transform(w, slot).alias("__mx_slots"), table.alias("__mx_table")
    )

    def log_likelihood(k: int) -> Column:
        return F.aggregate("__mx_slots", F.lit(0.0), lambda acc, s: acc + F.get("__mx_table", s + k * SLOTS).cast("double"))

    sums = [log_likelihood(k) for k in range(len(priors))]
    size = F.greatest(F.col("__mx_tokens"), F.lit(1)).cast("double")
    logits = F.array(*[F.lit(prior) + SHARPNESS * s / size for prior, s in zip(priors, sums)])
    rows = rows.select(*keep, "__mx_id", "__mx_tokens", logits.alias("__mx_z"))
    weights = F.transform("__mx_z", lambda z: F.exp(z - F.array_max("__mx_z")))
    rows = rows.select(*keep, "__mx_id", "__mx_tokens", weights.alias("__mx_e"))
    total = F.aggregate("__mx_e", F.lit(0.0), lambda a, x: a + x)
    return rows.select(*keep, "__mx_id", "__mx_tokens", F.transform("__mx_e", lambda x: x / total).alias("__mx_p"))


def _posteriors(docs, labelled, targets, id_col, text_col, max_rows) -> DataFrame:
    table, priors = classifier(docs, labelled, sorted(targets), id_col, text_col, max_rows)
    return with_posteriors(docs, table, priors, id_col, text_col)


def _fit(rows: DataFrame, targets: Mapping[str, float]) -> list[list[float]]:
    whole = sum(targets.values())
    members = rows.select(F.col("__mx_tokens").alias("tokens"), F.col("__mx_p").alias("p"))
    return fit_rates(members, [targets[d] / whole for d in sorted(targets)])


def rate(moves: list[list[float]], p: str = "p") -> Column:
    """Rate after the given gradient steps: each subtracts p . step and is projected on >= 0."""
    out = F.lit(1.0)
    if not moves:
        return out
    steps = F.array(*[F.array(*map(F.lit, m)) for m in moves])
    dot = lambda m: F.aggregate(
        F.zip_with(F.col(p), m, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x
    )
    return F.aggregate(steps, out, lambda r, m: F.greatest(F.lit(0.0), r - dot(m)))


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """Gradient steps whose ``rate`` brings the expected domain totals to the targets.

    ``members``: tokens and p. The gradient of the least-squares distance is
    scaled by the domains' second moments over the documents whose rate is not
    held at 0, so a few steps suffice; the budget is the tokens there are. Each
    step is one aggregate of a few numbers. Totals that still miss their targets
    after the last step (a domain with next to no tokens) are told by a warning.
    """
    n = len(targets)
    moves: list[list[float]] = []
    for _ in range(steps + 1):
        t, r, p = F.col("t"), F.col("r"), [F.col("p")[k] for k in range(n)]
        pairs = [(j, k) for j in range(n) for k in range(j + 1)]
        s = members.select(F.col("tokens").cast("double").alias("t"), "p", rate(moves).alias("r")).agg(
            F.sum("t").alias("all"),
            *[F.sum(t * r * p[k]).alias(f"s{k}") for k in range(n)],
            *[F.sum(F.when(r > 0, t * p[j] * p[k])).alias(f"m{j}_{k}") for j, k in pairs],
        ).first()
        if not s["all"]:
            return []
        off = np.array([s[f"s{k}"] / s["all"] - targets[k] for k in range(n)])
        if np.abs(off).max() < tolerance:
            break
        if len(moves) == steps:
            warnings.warn(f"domain totals miss their targets after {steps} steps, as shares of all tokens by {off.tolist()}", stacklevel=2)
            break
        moment = np.zeros((n, n))
        for j, k in pairs:
            moment[j, k] = moment[k, j] = (s[f"m{j}_{k}"] or 0.0) / s["all"]
        moves.append([float(x) for x in np.linalg.solve(moment + RIDGE * np.eye(n), off)])
    return moves


def mixed(
    docs: DataFrame,
    labelled: DataFrame,
    targets: Mapping[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """One row per document: id, tokens, p_<domain> for each domain, rate, copies.

    ``targets`` give each domain's share of the tokens and are scaled to sum to
    1. ``copies`` is the rate rounded to a whole number at random, by a hash of
    the id. A null or empty text has no tokens, the prior as its posterior and
    the rate that follows from it. Repeated rows are rated each; rows without
    label are only scored; without labels every posterior is the prior and all
    rates are equal. Other columns are ignored, and an empty table gives no rows.
    """
    domains = sorted(targets)
    rows = _posteriors(docs.select(id_col, text_col), labelled, targets, id_col, text_col, max_rows)
    rows = staged(rows.select("__mx_id", "__mx_tokens", "__mx_p"), "mix-members")
    r = rate(_fit(rows, targets), "__mx_p")
    return rows.select(
        F.col("__mx_id").alias(id_col),
        F.col("__mx_tokens").alias("tokens"),
        *[F.col("__mx_p")[k].alias(f"p_{d}") for k, d in enumerate(domains)],
        r.alias("rate"),
        copies(F.col("__mx_id"), r).alias("copies"),
    )


def copies(key: Column, r: Column) -> Column:
    """The rate rounded up with the probability of its fraction, by a hash of the key."""
    u = F.pmod(F.xxhash64(key, F.lit(20240101)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(r) + (u < r - F.floor(r)).cast("long")).cast("int")


def resample(
    docs: DataFrame,
    labelled: DataFrame,
    targets: Mapping[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
    keep: str | None = None,
) -> DataFrame:
    """The documents repeated ``copies`` times (0: dropped), all columns kept.

    ``keep`` names a domain whose documents are to stay: those likeliest of it
    get a rate of 1 at least. If it holds more of the tokens than wanted, its
    share then stays above its target instead of documents being dropped. The
    documents are written once with their posteriors, so texts are scored once;
    the fit reads the posteriors alone, and no text is shuffled.
    """
    rows = staged(_posteriors(docs, labelled, targets, id_col, text_col, max_rows), "mix-documents")
    rates = rate(_fit(rows, targets), "__mx_p")
    if keep is not None:
        k = sorted(targets).index(keep)
        rates = F.when(F.col("__mx_p")[k] == F.array_max("__mx_p"), F.greatest(rates, F.lit(1.0))).otherwise(rates)
    n = copies(F.col("__mx_id"), rates)
    rows = rows.select(*docs.columns, n.alias("__mx_copies")).where("__mx_copies > 0")
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__mx_copies"))).alias("__mx_copy")).drop("__mx_copy")
