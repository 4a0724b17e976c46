"""Small tables and brute-force versions the operator tests share."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Columns that carry names the operators use inside.
CLASH = "digest string, node long, score double, rank long, length int, part int, words string, n int, p int, w long, host string, count long"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def doc_rows(pairs):
    """Rows of DOCS from (id, text)."""
    return [(i, t, "en", "s", len(t or ""), "x", 1, 0.5, 2, 3, 4, "y", 5, 6, 7, "z", 8) for i, t in pairs]


def make_docs(spark, pairs):
    return spark.createDataFrame(doc_rows(pairs), DOCS)


ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from here"),
    (2, "the QUICK brown fox jumps over the lazy dog and runs away from here"),
    (3, ""),
    (4, None),
    (5, "one"),
    (6, "one two"),
    (7, "ÀÉÎ été naïve ÉTÉ 漢字 😀 text"),
    (8, "àéî été naïve été 漢字 😀 text"),
    (None, "a row without an id that says something"),
    (9, "a row twice with one id and one text"),
    (9, "a row twice with one id and one text"),
    (10, " ".join(f"word{k % 997}x{k}" for k in range(30_000))),  # very long
    (11, "tie tie tie tie tie tie"),
    (12, "tie tie tie tie tie tie"),
    (13, "\t \n "),
]


def invented(rng: random.Random, n_words: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n_words))


def vocabulary(rng: random.Random, n: int) -> list[str]:
    parts = "an er in on th re st ou ti ha en ed nd to or ea hi is it".split()
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def components_of(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_brute(pairs, n=3, percent=90):
    sets = {i: shingles(t, n) for i, t in pairs}
    ids = [i for i in sets if sets[i]]
    links, edges = Counter(), []
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    comp = components_of(sets, edges)
    return {i: (len(s), comp[i], links[i]) for i, s in sets.items()}


def cosine_brute(vectors, threshold=0.95):
    import numpy as np

    ok = {i: np.array(v, float) for i, v in vectors.items() if usable(v)}
    ids, links, edges = sorted(ok), Counter(), []
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = ok[i], ok[j]
            if len(a) == len(b) and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    comp = components_of(vectors, edges)
    return {i: (links[i], comp[i], comp[i] == i) for i in vectors}


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def grouped(pairs):
    out = defaultdict(list)
    for i, t in pairs:
        out[(t or "").translate(FOLD)].append(i)
    return out
