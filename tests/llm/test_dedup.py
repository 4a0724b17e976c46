"""Exact, near and embedding dedup, and components, against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from cartcast.llm import embedding_dedup, ngram_join
from cartcast.llm.common import ship_package
from cartcast.llm.components import components
from cartcast.llm.exact_dedup import DigestIndex, drop_exact_duplicates, exact_duplicates
from helpers import FOLD, ODD, components_of, cosine_brute, grouped, invented, jaccard_brute, make_docs, vocabulary


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship_package(spark)


def best(ids):
    return max((i for i in ids if i is not None), default=None)


def test_exact_duplicates_of_odd_rows(spark):
    got = [tuple(r) for r in exact_duplicates(make_docs(spark, ODD)).collect()]
    groups = grouped(ODD)
    want = []
    for i, t in ODD:
        text = (t or "").translate(FOLD)
        ids = groups[text]
        want.append((i, best(ids), len(ids), i == best(ids), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_digest_index_persists_and_drops_known_texts(spark):
    index = DigestIndex(spark, buckets=4)
    first = make_docs(spark, [(1, "Alpha"), (2, "alpha"), (3, "beta")])
    second = make_docs(spark, [(9, "ALPHA"), (10, "gamma"), (11, "gamma"), (12, None)])
    assert sorted(r.doc_id for r in drop_exact_duplicates(first, index).collect()) == [2, 3]
    again = DigestIndex(spark, index.path, buckets=4)  # the same folder, opened anew
    out = {r.doc_id: (r.keep_id, r.kept) for r in exact_duplicates(second, again).collect()}
    assert out == {9: (2, False), 10: (11, False), 11: (11, True), 12: (12, True)}
    assert again.table().count() == 4
    exact_duplicates(second, again)  # a repeated batch adds nothing
    assert again.table().count() == 4


def test_index_join_needs_no_shuffle_of_the_index(spark):
    index = DigestIndex(spark, buckets=4)
    exact_duplicates(make_docs(spark, ODD), index)
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        table = index.table()
        new = table.limit(3).repartition(3)
        plan = new.hint("merge").join(table, table.columns[0], "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan


def test_drop_exact_duplicates_keeps_columns_and_one_row_each(spark):
    docs = make_docs(spark, ODD + [(100 + k, "hot text") for k in range(400)])
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "").translate(FOLD)) for r in out.collect()), key=str)
    want = sorted(((best(ids), t) for t, ids in grouped(ODD + [(100 + k, "hot text") for k in range(400)]).items()), key=str)
    assert got == want


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300) * 7 - 900, rng.randint(0, 300) * 7 - 900) for _ in range(200)]
    edges += [(10_000 + k, 10_001 + k) for k in range(30)] + [(20_000, 20_001 + k) for k in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components_of(set(got), edges)
    assert {n for e in edges for n in e} == set(got)
    assert {(got[a] == got[b], want[a] == want[b]) for a in got for b in list(got)[:40]} <= {(True, True), (False, False)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(seed, n=60):
    rng = random.Random(seed)
    words = vocabulary(rng, 400)
    pairs, passage = [], invented(rng, 60, words)
    for k in range(n):
        base = invented(rng, rng.randint(1, 120), words)
        pairs.append((10 * k, base))
        for c in range(rng.randint(0, 3)):
            w = base.split()
            w[rng.randrange(len(w))] = "changed"
            pairs.append((10 * k + 1 + c, " ".join(w)))
    pairs += [(5_000 + k, passage + " " + invented(rng, 4, words)) for k in range(40)]  # one large family
    pairs += [(6_000 + k, "Same TEXT in every row") for k in range(150)]
    return pairs


@pytest.mark.parametrize("shingle, percent, mass", [(3, 90, 1 << 20), (5, 80, 2000)])
def test_jaccard_links_equal_brute_force(spark, shingle, percent, mass):
    pairs = near_copies(shingle)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in
           ngram_join.jaccard_links(make_docs(spark, pairs), shingle, percent, mass=mass).collect()}
    assert got == jaccard_brute(pairs, shingle, percent)


def test_jaccard_with_salted_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET", 7)
    pairs = near_copies(8, 20)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.jaccard_links(make_docs(spark, pairs)).collect()}
    assert got == jaccard_brute(pairs)


def test_jaccard_of_odd_rows(spark):
    rows = ngram_join.jaccard_links(make_docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r for r in rows}
    want = jaccard_brute([(i, t) for i, t in dict((i, t) for i, t in ODD).items() if i is not None])
    for i, (n, comp, links) in want.items():
        assert (got[i].n_shingles, got[i].component_id) == (n, comp)
        assert got[i].n_links == links + (i == 9)  # the repeated row is a copy of itself
    assert got[None].component_id is None and got[None].n_links == 0


def test_one_session_joins_several_tables(spark):
    """Python workers are kept between jobs; nothing of one join's order of shingles may reach the next."""
    for seed in range(4):
        pairs = near_copies(20 + seed, 6)
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_links(make_docs(spark, pairs)).collect()}
        assert got == {i: c for i, (_, c, _) in jaccard_brute(pairs).items()}


def test_keys_give_their_hashes_back():
    rng = np.random.default_rng(8)
    for _ in range(3):
        order = rng.permutation(1 << ngram_join.GROUP_BITS).astype(np.uint32)
        h = rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        group = (h & np.uint64((1 << ngram_join.GROUP_BITS) - 1)).astype(np.int64)
        keys = order[group].astype(np.uint64) << np.uint64(64 - ngram_join.GROUP_BITS) | h >> np.uint64(ngram_join.GROUP_BITS)
        assert (ngram_join._unordered(keys, ngram_join.inverse_order(order)) == h).all()


def test_rtree_bounds_lose_no_link():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 62, rng.integers(5, 200)).astype(np.uint64)) for _ in range(70)]
    sets = base + [np.unique(np.append(s[1:], rng.integers(0, 1 << 62, 1).astype(np.uint64))) for s in base for _ in range(3)]
    tree = ngram_join.RTree.of_sets(sets, 32)
    found = {tuple(sorted(p)) for x, y in ngram_join.tree_links(tree, tree, 80) for p in zip(x.tolist(), y.tolist())}
    want = set()
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                want.add((i, j))
    assert found == want
    pairs = len(ngram_join.leaf_pairs(tree, tree, 80))
    leaves = len(tree.upper[0])
    assert pairs <= leaves * (leaves + 1) // 2


def test_keep_one_of_each(spark):
    docs = make_docs(spark, near_copies(4, 15) + [(None, "no id")])
    comp = jaccard_brute(near_copies(4, 15), 5, 80)
    kept = ngram_join.keep_one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([str(i) for i, c in comp.items() if c[1] == i] + ["None"])


def embedding_rows(seed=1, n=120, width=16):
    rng = np.random.default_rng(seed)
    rows = {}
    for k in range(n):
        v = rng.normal(size=width)
        rows[10 * k] = v.tolist()
        for c in range(int(rng.integers(0, 4))):
            rows[10 * k + 1 + c] = ((v + rng.normal(size=width) * 0.2) * rng.uniform(0.1, 9)).tolist()
    hub = rng.normal(size=width)
    rows |= {5000 + k: (hub + rng.normal(size=width) * 0.1).tolist() for k in range(60)}
    rows |= {6000 + k: hub.tolist() for k in range(40)}
    rows |= {9001: None, 9002: [], 9003: [0.0] * width, 9004: [float("nan")] + [1.0] * (width - 1),
             9005: [float("inf")] * width, 9006: [None] + [1.0] * (width - 1), 9007: [1.0, 2.0], 9008: [2.0, 4.0],
             9009: [1e-300] * width, 9010: [1e300] * width}
    return rows


@pytest.mark.parametrize("tile", [4096, 24])
def test_embedding_links_equal_brute_force(spark, tile):
    rows = embedding_rows()
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows.items()], "vec_id long, embedding array<double>, label int, node long, key string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, tile=tile).collect()}
    want = cosine_brute({i: v for i, v in rows.items() if i not in (9009, 9010)})
    for i, w in want.items():
        assert got[i] == w, i
    assert got[9009] == (1, 9009, True) and got[9010] == (1, 9009, False)  # squares that under- or overflow


def test_embeddings_null_ids_repeats_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=str)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("run", [exact_duplicates, drop_exact_duplicates, ngram_join.jaccard_links, ngram_join.keep_one_of_each])
def test_empty_tables(spark, run):
    assert run(make_docs(spark, [])).count() == 0


def test_tile_size_follows_the_table_and_memory():
    size = embedding_dedup.tile_size
    assert size(0, 64) == size(100_000, 64) == 4096  # small tables
    assert size(1_000_000, 64) == 15_625 and size(10**9, 64) == 32_768  # as many numbers as a task holds
    assert size(10**9, 2048) == 4096


def test_rows_that_link_with_nothing_meet_nobody(spark):
    """Null ids and unusable vectors get their own rows back, however many there are, and no join sees them."""
    rows = [(None, [1.0, 0.0])] * 50 + [(k, None) for k in range(50)] + [(100 + k, [0.0, 0.0]) for k in range(50)]
    rows += [(200 + k, [float("nan"), 1.0]) for k in range(5)] + [(300, [1.0, 0.0]), (301, [1.0, 0.0]), (302, [])]
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows)
    assert {r for r in got if r[1]} == {(300, 1, 300, True), (301, 1, 300, False)}
    assert all(r[2] == r[0] and r[3] for r in got if not r[1])
