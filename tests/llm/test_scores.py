"""Quality, toxicity, URL filter, mixing: held-out accuracy, formulas and odd rows."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartcast.llm import mixing, quality, toxicity, url_filter
from cartcast.llm.common import ship_package
from helpers import ODD, invented, make_docs, vocabulary


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship_package(spark)


LABELS = "doc_id long, quality int, toxic int, label int, domain string"


def make_labels(spark, rows):
    return spark.createDataFrame([(i, q, t, 9, "x") for i, q, t in rows], LABELS)


def corpus(n=700, seed=2):
    """Texts with labels: poor ones shout or repeat, toxic ones hold insults."""
    rng = random.Random(seed)
    words = vocabulary(rng, 500)
    pairs, labels = [], []
    for i in range(n):
        text, q, t = invented(rng, rng.randint(20, 120), words), 1, 0
        if i % 6 == 0:
            q, text = 0, " ".join(w.upper() + "!!" for w in text.split())
        elif i % 6 == 1:
            q, text = 0, " ".join(w for x in text.split()[:12] for w in [x] * 9)
        elif i % 6 == 2:
            t, w = 1, text.split()
            for _ in range(max(1, len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(["zzfool", "zzscum", "zzpest"])
            text = " ".join(w)
        pairs.append((i, text))
        labels.append((i, q, t))
    return pairs, labels


@pytest.fixture(scope="module")
def data(spark):
    pairs, labels = corpus()
    return make_docs(spark, pairs).cache(), make_labels(spark, labels).cache(), labels


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def accuracy(rows, truth):
    return np.mean([r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth])


def test_quality_learns_and_holds_out(spark, data):
    docs, labels, truth = data
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert accuracy(rows, {i: q for i, q, _ in truth}) > 0.97
    # held-out labels are never read: flipping them changes nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.quality_scores(docs, flipped).collect()} == {r.doc_id: r.score for r in rows}


def test_quality_filter_keeps_good_documents_and_columns(spark, data):
    docs, labels, truth = data
    kept = quality.keep_good(docs, docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good = {i for i, q, _ in truth if q}
    assert len(good - ids) <= 0.01 * len(good) and len(ids - good) <= 0.03 * len(truth)


def test_sparse_scores_equal_the_dense_definition(data):
    """Block scores are the dot products of the training rows' sparse features."""
    import pyarrow as pa

    from cartcast.llm.words import blocks

    texts = [t for _, t in ODD]
    weights = np.random.default_rng(1).normal(size=quality.BIAS + 1)
    rows = quality.sparse_rows(pa.array(texts))
    want = [1 / (1 + np.exp(-np.clip(weights[s] @ v, -500, 500))) for s, v in rows]
    got = np.concatenate([quality.score_block(b, weights) for b in blocks(pa.array(texts), 100)])
    assert np.allclose(got, want)


def test_ftrl_equals_its_update_rule():
    rows = [(np.array([0, 2, quality.BIAS]), np.array([1.0, 2.0, 1.0])), (np.array([1, 2, quality.BIAS]), np.array([0.5, 1.0, 1.0]))]
    y = np.array([1.0, 0.0])
    got = quality.ftrl(rows, y, epochs=3, seed=5)
    z, n = np.zeros(quality.BIAS + 1), np.zeros(quality.BIAS + 1)
    rng = np.random.default_rng(5)
    w = lambda k: 0.0 if abs(z[k]) <= quality.L1 else -(z[k] - np.sign(z[k]) * quality.L1) / ((quality.BETA + n[k] ** 0.5) / quality.ALPHA + quality.L2)
    for _ in range(3):
        for i in rng.permutation(2):
            p = 1 / (1 + np.exp(-sum(w(k) * x for k, x in zip(*rows[i]))))
            old = {k: w(k) for k in rows[i][0]}
            for k, x in zip(*rows[i]):
                g = (p - y[i]) * x
                sigma = ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / quality.ALPHA
                z[k] += g - sigma * old[k]
                n[k] += g * g
    assert np.allclose([got[k] for k in (0, 1, 2, quality.BIAS)], [w(k) for k in (0, 1, 2, quality.BIAS)])


def test_quality_learns_one_text_of_an_id(spark):
    """An id with thousands of texts brings one of them to its task."""
    docs = make_docs(spark, [(1, f"good words here {k}") for k in range(3000)] + [(2, "bad words there")])
    labels = spark.createDataFrame([(1, 1, 0, 1, "x"), (2, 0, 0, 1, "x"), (1, 1, 0, 1, "x")], LABELS)
    model = quality.fit(docs, labels, epochs=1)
    one = quality.fit(docs.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")), labels, epochs=1)
    assert np.array_equal(model, one) and model.any()


def test_toxicity_learns_and_holds_out(spark, data):
    docs, labels, truth = data
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == len(truth) and all(r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert accuracy(rows, {i: t for i, _, t in truth}) > 0.97
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in rows)


def test_toxic_pairs_are_counted_once_per_text(spark):
    rows = spark.createDataFrame([(1, "Aa bb aa bb"), (0, "aa BB."), (0, "bb"), (0, None)], "y long, text string")
    got = {(r.n1, r.n0) for r in toxicity.count_pairs(rows).collect()}
    counts = sorted((r.n1, r.n0) for r in toxicity.count_pairs(rows).collect())
    # aa-bb in both, bb-aa in one, bb at the end of three
    assert counts == [(1, 0), (1, 1), (1, 2)] and len(got) == 3


def test_toxic_words_keep_their_counts_whatever_the_size(spark, monkeypatch):
    """A word of two texts stays evidence however many tokens there are beside it (a share of them was asked)."""
    monkeypatch.setattr(toxicity, "SHARE", 1 << 5, raising=False)
    rng = random.Random(8)
    words = vocabulary(rng, 200)
    rows, docs, at = [], [], 0
    while len(rows) < 1500:
        at += 1
        text, toxic = invented(rng, 12, words), len(rows) < 60
        if fold(at, 5):
            text += f" rare{len(rows) // 4}" if toxic else ""
            rows.append((at, 1, int(toxic), 1, "x"))
        docs.append((at, text))
    docs += [(10**6 + k, f"{invented(rng, 5, words)} rare{k}") for k in range(15)]
    docs += [(2 * 10**6 + k, f"{invented(rng, 5, words)} new{k}") for k in range(15)]
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(make_docs(spark, docs), spark.createDataFrame(rows, LABELS)).collect()}
    # A few of the rare words were counted in one text only.
    assert sum(got[10**6 + k] > got[2 * 10**6 + k] for k in range(15)) >= 12


def kneser_ney_brute(rows):
    """Log ratios of words and pairs kept, by the formulas of the module's docstring, over (y, list of words)."""
    pairs, words, cont, types = {}, {}, {}, {}
    for y, text in rows:
        for v, w in set(zip(text, [*text[1:], None])):
            pairs.setdefault((v, w), [0, 0])[y] += 1
    for (v, w), n in pairs.items():
        mine = words.setdefault(v, [0, 0])
        mine[0] += n[0]
        mine[1] += n[1]
        if w is not None:
            cont[w], types[v] = cont.get(w, 0) + 1, types.get(v, 0) + 1
    total = [sum(n[c] for n in words.values()) for c in (0, 1)]
    kinds = [sum(n[c] > 0 for n in words.values()) for c in (0, 1)]
    share, d, all_cont = total[1] / sum(total), toxicity.DISCOUNT, sum(cont.values())

    def kept(n):
        return max(n) >= toxicity.LEAST and abs(n[1] - sum(n) * share) >= toxicity.Z * math.sqrt(sum(n) * share * (1 - share))

    def p(w, c):
        shared = (cont.get(w, 0) + 0.5) / (all_cont + 0.5 * len(words) + 0.5)
        n = words[w]
        return max(n[c] - d, 0) / total[c] + d * kinds[c] / total[c] * shared if kept(n) else shared

    def conditional(v, w, c):
        back = min(max(d * types.get(v, 0) / max(sum(words[v]), 1), 1e-3), 1.0)
        return max(pairs[v, w][c] - d, 0) / max(words[v][c], 1) + back * p(w, c)

    by_word = {w: math.log(p(w, 1) / p(w, 0)) for w, n in words.items() if kept(n)}
    by_pair = {
        (v, w): math.log(conditional(v, w, 1) / conditional(v, w, 0)) for (v, w), n in pairs.items() if w is not None and kept(n)
    }
    return by_word, by_pair


def test_toxic_evidence_equals_brute_force_whatever_is_looked_up(spark):
    """All expressions in the head, some of them, none: the ratios are those of the formulas."""
    rng = random.Random(4)
    common, bad = [f"w{k}" for k in range(40)], [f"bad{k}" for k in range(12)]
    rows = []
    for k in range(500):
        text = rng.choices(common, k=rng.randint(1, 25))
        if k % 5 == 0:
            for _ in range(4):
                text.insert(rng.randint(0, len(text)), " ".join(rng.choices(bad, weights=range(1, 13), k=2)))
        rows.append((int(k % 5 == 0), " ".join(text)))
    by_word, by_pair = kneser_ney_brute([(y, t.split()) for y, t in rows])
    assert len(by_word) > 10 and len(by_pair) > 5
    texts = [t for _, t in rows[:200]] + ["", None, "never seen", "bad11 bad11 bad11", "w1", " ".join(bad) + " new w3"]
    want = []
    for t in texts:
        w = (t or "").split()
        got = [by_pair.get((a, b), by_word.get(b, 0.0)) for a, b in zip([None, *w], w)]
        want.append((sum(got) / max(len(w), 1), sum(got) / math.sqrt(max(len(w), 1))))
    tables = toxicity.learn(spark.createDataFrame(rows, "y long, text string"))
    assert (tables.n_words, tables.n_pairs) == (len(by_word), len(by_pair))
    asked, joined = spark.createDataFrame(list(enumerate(texts)), "k long, text string"), []
    for most in (10**6, (len(by_word) + len(by_pair)) // 2, 0):
        model, rest = toxicity.split_head(tables, most)
        assert len(model.words) + len(model.pairs) <= most
        joined.append(rest.n_words + rest.n_pairs if rest else 0)
        found = {r.k: (r.a, r.b) for r in toxicity.scored(asked, spark.sparkContext.broadcast(model), rest).collect()}
        assert np.allclose([found[k] for k in range(len(texts))], want, atol=1e-9)
    assert joined[0] == 0 < joined[1] < joined[2]


def test_toxicity_joined_equals_broadcast(spark, data, monkeypatch):
    docs, labels, _ = data
    docs = docs.unionByName(make_docs(spark, ODD + [(-7, "tie " * 500), (None, "x")]).select(*docs.columns))
    want = sorted((str(r.doc_id), round(r.score, 9), r.held_out) for r in toxicity.toxicity_scores(docs, labels).collect())
    monkeypatch.setattr(toxicity, "SMALL_ROWS", 0)
    got = sorted((str(r.doc_id), round(r.score, 9), r.held_out) for r in toxicity.toxicity_scores(docs, labels).collect())
    assert len(got) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 and a[2] == b[2] for a, b in zip(got, want))


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_of_odd_rows_and_empty_tables(spark, data, scores):
    _, labels, _ = data
    odd = make_docs(spark, ODD)
    for given in (labels, labels.limit(0), make_labels(spark, [(None, 1, 1), (1, None, None), (2, 1, 0), (2, 0, 1)])):
        rows = scores(odd, given).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert not next(r for r in rows if r.doc_id is None).held_out
        empty = {round(r.score, 12) for r in rows if r.doc_id in (3, 4, 13)}
        assert len(empty) == 1  # empty, null and blank texts alike
    assert scores(make_docs(spark, []), labels).count() == 0


# url filter


URLS = [
    (1, "http://A.Example.NET/en/5"), (2, "https://a.example.net/de/5"), (3, "https://b.example.com/de/7?x=1"),
    (4, "http://q.org/fr/1"), (5, "http://org/fr/"), (6, "http://myorg/fr/1"), (7, "http://x.example.org"),
    (8, None), (9, "no scheme here"), (10, "ftp://h.example.com:80/p#/q"), (11, "http://x.net?/en"), (12, "http://"),
    (13, "http://example.net/en/"), (14, "http://notexample.net/en/9"), (14, "http://a.example.net/es/://b/c"), (None, "http://a.b/c/3.html"),
]


def url_brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:k], rest[k:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    k = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    path = path[:k]
    fits = [(len(r), r, v) for r, v in url_filter.RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules_equal_brute_force(spark, data):
    _, labels, _ = data
    pages = spark.createDataFrame([(i, u, "<html>", "h", 1.0) for i, u in URLS], "page_id long, url string, html string, host string, lower double")
    for given in (labels, labels.limit(0)):
        rows = url_filter.url_verdicts(pages, given).collect()
        assert all(r.verdict in ("allow", "block") for r in rows)
        got = sorted(str((r.page_id, r.host, r.path, r.rule)) for r in rows)
        assert got == sorted(str((i, *url_brute(u)[:3])) for i, u in URLS)
        for r in rows:
            if r.rule:
                assert r.verdict == dict(url_filter.RULES)[r.rule]
    assert url_filter.url_verdicts(pages.limit(0), labels).count() == 0


def test_reputation_shrinks_towards_the_domain(spark):
    good = [("big.good.com", 1)] * 200 + [("small.good.com", 0)] + [("big.bad.com", 0)] * 200 + [("a.bad.com", 1)]
    outcomes = spark.createDataFrame(good, "host string, good int")
    hosts = spark.createDataFrame([(h,) for h in ("big.good.com", "small.good.com", "new.good.com", "big.bad.com", "new.bad.com", "z.org", "")], "host string")
    r = {x.host: x for x in url_filter.reputations(outcomes, hosts).collect()}
    assert r["big.good.com"].mean > 0.95 > r["small.good.com"].mean
    assert r["new.good.com"].mean > 0.8 and r["new.good.com"].lower >= 0.5 > r["new.bad.com"].mean
    assert abs(r["z.org"].mean - 0.5) < 0.02 and abs(r[""].mean - r["z.org"].mean) < 1e-9
    assert all(0 <= x.lower <= x.mean <= 1 for x in r.values())


def test_bad_hosts_are_blocked(spark):
    pages = [(k, f"http://spam.bad.info/en/{k}") for k in range(60)] + [(k, f"http://fine.good.info/en/{k}") for k in range(60, 120)]
    labels = make_labels(spark, [(k, int(k >= 60), 0) for k in range(120) if k % 3])
    rows = url_filter.url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()
    assert {(r.host, r.verdict) for r in rows} == {("spam.bad.info", "block"), ("fine.good.info", "allow")}


# mixing


TARGETS = {"clean": 0.8, "poor": 0.1, "toxic": 0.1}


def rates_brute(tokens, p, target, steps):
    r = np.ones(len(tokens))
    for _ in range(steps):
        off = (tokens * r) @ p / tokens.sum() - target
        if np.abs(off).max() < mixing.TOLERANCE:
            break
        moment = (p * (tokens * (r > 0))[:, None]).T @ p / tokens.sum()
        r = np.maximum(0, r - p @ np.linalg.solve(moment + mixing.RIDGE * np.eye(len(target)), off))
    return r


def test_mixing_meets_its_targets(spark, data):
    docs, labels, truth = data
    rows = mixing.mixed(docs, mixing.domain_labels(labels), TARGETS).collect()
    tokens = np.array([r.tokens for r in rows], float)
    p = np.array([[r.p_clean, r.p_poor, r.p_toxic] for r in rows])
    rate = np.array([r.rate for r in rows])
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all()
    assert np.allclose((tokens * rate) @ p / tokens.sum(), [0.8, 0.1, 0.1], atol=1e-4)
    assert np.allclose(rate, rates_brute(tokens, p, np.array([0.8, 0.1, 0.1]), mixing.STEPS))
    domain = {i: "poor" if not q else "toxic" if t else "clean" for i, q, t in truth}
    names = ["clean", "poor", "toxic"]
    # A bag of words does not see that words repeat (every sixth text): judged on the others.
    assert np.mean([names[k] == domain[r.doc_id] for k, r in zip(p.argmax(1), rows) if r.doc_id % 6 != 1]) > 0.9
    assert all(np.floor(r.rate) <= r.copies <= np.floor(r.rate) + 1 for r in rows)
    assert abs(sum(r.copies for r in rows) - rate.sum()) < 5 * len(rows) ** 0.5


def test_resample_repeats_rows_as_told(spark, data):
    docs, labels, _ = data
    told = {r.doc_id: r.copies for r in mixing.mixed(docs, mixing.domain_labels(labels), TARGETS).collect()}
    out = mixing.resample(docs, mixing.domain_labels(labels), TARGETS)
    assert out.columns == docs.columns
    got = {r.doc_id: r["count"] for r in out.select("doc_id").groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in told.items() if c}


def test_a_kept_domain_stays_where_it_is_too_common(spark, data):
    docs, labels, _ = data
    mostly_clean = docs.where("doc_id % 6 > 2 OR doc_id % 60 < 3")
    given, wanted = mixing.domain_labels(labels), {"clean": 0.7, "poor": 0.15, "toxic": 0.15}
    told = {r.doc_id: r for r in mixing.mixed(mostly_clean, given, wanted).collect()}
    clean = {i for i, r in told.items() if r.p_clean == max(r.p_clean, r.p_poor, r.p_toxic)}
    assert any(told[i].rate < 1 for i in clean)  # the plain rates would drop some
    out = [r.doc_id for r in mixing.resample(mostly_clean, given, wanted, keep="clean").collect()]
    assert clean and clean <= set(out)
    plain = {i: r.copies for i, r in told.items() if i not in clean and r.copies}
    assert {i: out.count(i) for i in plain} == plain  # the others have the rates they had


def test_missed_targets_are_told(spark):
    members = spark.createDataFrame([(10**6, [1.0, 0.0]), (1, [0.0, 1.0])], "tokens long, p array<double>")
    with pytest.warns(UserWarning, match="miss their targets"):
        mixing.fit_rates(members, [0.9, 0.1], steps=3)


def test_mixing_is_native(spark, data):
    docs, labels, _ = data
    for out in (mixing.mixed(docs, mixing.domain_labels(labels), TARGETS), mixing.resample(docs, mixing.domain_labels(labels), TARGETS)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))


def test_mixing_of_odd_rows(spark, data):
    _, labels, _ = data
    odd = make_docs(spark, ODD)
    for given in (labels, labels.limit(0)):
        rows = mixing.mixed(odd, mixing.domain_labels(given), TARGETS).collect()
        assert len(rows) == len(ODD) and all(r.rate >= 0 and r.copies >= 0 for r in rows)
        assert {r.tokens for r in rows if r.doc_id in (3, 4, 13)} == {0}
    assert mixing.mixed(make_docs(spark, []), mixing.domain_labels(labels), TARGETS).count() == 0
    assert mixing.resample(make_docs(spark, []), mixing.domain_labels(labels), TARGETS).columns == odd.columns
