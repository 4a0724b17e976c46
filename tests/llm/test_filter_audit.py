"""Filter interaction audit against a loop over documents, orders and steps."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from cartcast.llm import filter_audit as fa
from helpers import CLASH, ODD, make_docs

LABELS = f"doc_id long, quality int, toxic int, {CLASH}"


def label_rows(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5, 2, 3, 4, "y", 5, 6, 7, "z", 8) for r in rows], LABELS)


def brute(docs, labels):
    """Rows of the audit from (id, text, lang) and (id, quality, toxic)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": i is not None and least[t] < i,
        }
        parts[lang or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part, all_docs in parts.items():
        shapley, rows = Counter(), []
        for order in permutations("ABCDE"):
            left, gone = all_docs, []
            for k, f in enumerate(order):
                removed = [d for d in left if f in d[0]]
                shapley[f] += len(removed)
                counts = (len(left) - len(removed), len(removed), sum(f in d[0] for d in gone))
                counts += (sum(d[0] == {f} for d in all_docs), sum(d[1] for d in removed), sum(d[2] for d in removed))
                rows.append((f, (part, "".join(order), k + 1, *counts)))
                gone = gone + removed
                left = [d for d in left if f not in d[0]]
        out += [(*r, shapley[f]) for f, r in rows]
    return sorted(out)


def run(spark, docs, labels):
    table = make_docs(spark, [(i, t) for i, t, _ in docs]).collect()
    rows = [r.asDict() | {"lang": lang} for r, (_, _, lang) in zip(table, docs)]
    schema = make_docs(spark, []).schema
    frame = spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)
    return sorted(tuple(r) for r in fa.filter_audit(frame, label_rows(spark, labels)).collect())


def test_odd_rows(spark):
    langs = ["en", None, "", "de", "en"]
    long = " ".join(f"w{k % 150}" for k in range(300))
    docs = [(i, t, langs[k % 5]) for k, (i, t) in enumerate(ODD)]
    docs += [(20, long, "en"), (19, long, "de"), (19, long, "en"), (21, long, None), (None, long, "en"), (22, long + " #", "en")]
    docs += [(30, "ABC def", "en"), (31, "A" + "x" * 32, "en"), (32, "A" + "x" * 33, "en")]  # just over and under 3 %
    docs += [(33, " ".join(["a"] * 200 + [f"b{k}" for k in range(199)]), "en")]
    docs += [(34, " ".join(["a"] * 100 + [f"b{k}" for k in range(100)]), "en")]  # exactly 101 of 200 distinct
    docs += [(35, "a\x0bb\x0cc\rd\te\nf g\u00a0h", "fr")]
    labels = [(19, 1, 0), (19, 0, 1), (20, 1, None), (None, 1, 1), (3, None, 1), (999, 1, 1), (30, 1, 0), (22, 1, 1), (1, 1, 0)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1)]) == []
    assert run(spark, [(1, "a b", "en")], []) == brute([(1, "a b", "en")], [])


def test_many_copies_of_one_text_over_parts(spark):
    docs = [(k, "same text", ("en", "de", None)[k % 3]) for k in range(600)] + [(None, "same text", "en")] * 50
    labels = [(k, k % 2, k % 5 == 0) for k in range(0, 600, 3)]
    assert run(spark, docs, [(i, q, int(t)) for i, q, t in labels]) == brute(docs, [(i, q, int(t)) for i, q, t in labels])


def test_potentials_are_the_recursion(spark):
    """P(S) = (v(S) + sum of P(S - i)) / |S|, kept exactly at 120 times its value."""
    counts = [("p", m, n, n // 2, n // 3) for m, n in [(0, 7), (1, 5), (3, 11), (8, 2), (21, 13), (31, 1), (16, 9)]]
    frame = spark.createDataFrame(counts, "part string, mask int, n long, good long, toxic long")
    row = fa.with_shapley(fa.coalition_values(frame)).first()
    v = [sum(n for _, m, n, _, _ in counts if m & s) for s in range(32)]
    assert list(row["n"]) == v and row["total"] == sum(c[2] for c in counts)
    p = [0.0] * 32
    for s in sorted(range(1, 32), key=int.bit_count):
        p[s] = (v[s] + sum(p[s & ~(1 << i)] for i in range(5) if s >> i & 1)) / s.bit_count()
    assert list(row["potential"]) == pytest.approx([120 * x for x in p], abs=1e-6)
    assert sum(row["shapley"]) == 120 * v[31]  # the values share out what all filters remove


def test_copies_are_counted_before_they_meet(spark):
    """No row per document after the labels are joined: partial aggregates below the window."""
    docs = make_docs(spark, [(1, "a")])
    plan = fa.failure_counts(docs, label_rows(spark, []))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.rindex("Aggregate")
    assert "Python" not in plan
