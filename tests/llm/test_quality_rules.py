"""Counts of the quality rules against brute force, the robust estimates against numpy."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartcast.llm import quality_rules as qr
from helpers import ODD, make_docs

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    inside = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", t))
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(inside), failed


TEXTS = [
    "a a a a a a a a", "a a a a a a a a a", "a b c d e f g h a b c d e f g h", "a b c d e f g h\na b c d e f g H",
    "x y " * 30, "one\n\none\n \none\ntwo\r\ntwo\n", "#a *b $c %d &e |f <g >h !i", "é漢😀 \x0b\x0c\r\t ü\u00a0ü",
    " ".join(f"u{k}" for k in range(19)), " ".join(f"u{k}" for k in range(20)),
    " ".join([f"v{k}" for k in range(12)] * 2 + [f"z{k}" for k in range(56)]),  # 24 of 80 words: 30 %
    " ".join([f"v{k}" for k in range(12)] * 2 + [f"z{k}" for k in range(55)]),
    " ".join(f"r{k % 5000}" for k in range(12_000)),
]


def test_counts_of_odd_texts(spark):
    pairs = ODD + [(100 + k, t) for k, t in enumerate(TEXTS)]
    out = qr.quality_rules(make_docs(spark, pairs))
    got = [(r.doc_id, *[r[c] for c in COUNTS]) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(str((i, *counts(t))) for i, t in pairs)
    for df in (out, qr.document_statistics(make_docs(spark, pairs))):  # native
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    out = qr.quality_rules(make_docs(spark, []))
    assert out.collect() == []
    assert out.columns == ["doc_id", *COUNTS, "kept", "distance"]


def test_chi_squared():
    assert qr.chi2_quantile(0.5, 2) == pytest.approx(2 * np.log(2))
    assert qr.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert qr.chi2_quantile(0.999, 5) == pytest.approx(20.515006, abs=1e-5)
    assert qr.consistency(0.5) == pytest.approx(0.5 / qr.chi2_cdf(qr.chi2_quantile(0.5, qr.P), qr.P + 2))


def test_whitening_is_the_inverse_cholesky_factor(spark):
    a = np.random.default_rng(1).normal(size=(qr.P, 9))
    cov = a @ a.T
    row = {f"m{j}": 0.0 for j in range(qr.P)} | {f"c{j}{k}": float(cov[j, k]) for j, k in qr.PAIRS}
    out = qr._whitened(spark.createDataFrame([tuple(row.values())], list(row))).first()
    want = np.linalg.inv(np.linalg.cholesky(cov))
    assert out["white"] == pytest.approx([want[j, k] for j, k in qr.PAIRS], rel=1e-9)
    assert out["logdet"] == pytest.approx(np.linalg.slogdet(cov)[1])


def planted(n, bad, seed):
    """``n`` clean vectors and ``bad`` far ones in a cluster of their own, which classical estimates follow."""
    rng = np.random.default_rng(seed)
    mix = np.tril(rng.normal(size=(qr.P, qr.P))) + 2 * np.eye(qr.P)
    clean = rng.normal(size=(n, qr.P)) @ mix.T + 3
    return clean, rng.normal(size=(bad, qr.P)) * 0.3 + 40


def vectors(spark, groups, hot):
    rows = [(g, hot, [float(v) for v in x]) for g, xs in groups.items() for x in xs]
    return spark.createDataFrame(rows, f"{qr._G} string, {qr._HOT} boolean, x array<double>").repartition(4)


def log_det_of_half(xs, scale, starts=200):
    """Least log determinant that exact concentration from random starts finds, with the floors of a unit."""
    rng, h = np.random.default_rng(0), int(np.ceil(qr.HALF * (len(xs) + qr.P + 1)))
    z = (xs - np.median(xs, 0)) / scale
    floor = np.diag([(qr.FLOORS[s] / c) ** 2 for s, c in zip(qr.STATS, scale)])
    best = np.inf
    for _ in range(starts):
        own = rng.choice(len(z), qr.P + 1, replace=False)
        for _ in range(30):
            cov = qr.consistency(qr.HALF) * np.cov(z[own].T, bias=True) + floor
            off = z - z[own].mean(0)
            own = np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))[:h]
        best = min(best, np.linalg.slogdet(qr.consistency(qr.HALF) * np.cov(z[own].T, bias=True) + floor)[1])
    return best


@pytest.mark.parametrize("hot", [True, False])
def test_estimates_withstand_outliers(spark, hot):
    parts = {"a": planted(300, 130, 1), "b": planted(500, 0, 2), "c": planted(60, 20, 3)}
    model = {r[qr._G]: r for r in qr.estimates(vectors(spark, {g: np.vstack(p) for g, p in parts.items()}, hot)).collect()}
    for g, (clean, _) in parts.items():
        m = model[g]
        centre, scale = np.array(m["centre"]), np.array(m["scale"])
        mean = np.array(m["mean"]) * scale + centre
        spread = clean.std(0)
        assert np.all(np.abs(mean - clean.mean(0)) < 0.35 * spread), g
        white = np.zeros((qr.P, qr.P))
        for w, (j, k) in zip(m["white"], qr.PAIRS):
            white[j, k] = w
        cov = np.linalg.inv(white.T @ white) * np.outer(scale, scale)
        assert np.all(np.abs(np.log(np.diag(cov) / np.diag(np.cov(clean.T)))) < 0.7), g
        assert m["converged"]


def test_half_of_least_determinant(spark, monkeypatch):
    """The chosen half's determinant is within a few per cent of what 200 random starts find."""
    clean, bad = planted(120, 60, 4)
    xs = np.vstack([clean, bad])
    seen = []
    real = qr.staged
    monkeypatch.setattr(qr, "staged", lambda df, name: (seen.append((name, out := real(df, name))), out)[1])
    qr.estimates(vectors(spark, {"a": xs}, True))
    half = next(df for name, df in seen if name == "rules-half").first()
    want = log_det_of_half(xs, np.array(half["scale"]))
    assert half["logdet"] < want + 0.15 * qr.P


def text_of(rng, n, symbols=0.0):
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(n)]
    return " ".join(w + "###" if rng.random() < symbols else w for w in words)


def test_verdict_on_planted_documents(spark):
    """Symbol-ridden texts go, ordinary ones stay, per language and source; small groups are judged together."""
    rng = np.random.default_rng(9)
    rows, bad = [], set()
    for k in range(700):
        lang, source = ("en", "de", None)[k % 3], ("s", None, "t")[k % 7 % 3] if k % 50 else f"rare{k}"
        junk = k % 11 == 5
        bad |= {k} if junk else set()
        rows.append((k, text_of(rng, int(rng.integers(30, 400)), 0.9 if junk else 0.0), lang, source, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in qr.quality_rules(docs).collect()}
    assert {i for i, r in out.items() if not r.kept} == bad
    assert all(r.distance is not None for r in out.values())


def test_groups_fall_back_to_language_then_all(spark):
    rows = [("=en", "=a")] * 60 + [("=en", "=b")] * 30 + [("=en", "=c")] * 25 + [("=de", "=a")] * 10 + [("", "")] * 5
    stats = spark.createDataFrame(rows, "of_lang string, of_source string").withColumn("x", F.array(F.lit(0.0)))
    group = {(r.of_lang, r.of_source): r[qr._G] for r in qr.groups_of(stats).collect()}
    assert len(set(group.values())) == 3
    assert group["=en", "=b"] == group["=en", "=c"] != group["=en", "=a"]
    assert group["=de", "=a"] == group["", ""]
