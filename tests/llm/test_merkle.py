"""Merkle manifest against a rebuild in plain Python, its log against an enumeration."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from cartcast.llm import merkle
from cartcast.llm.common import ship_package
from helpers import CLASH, ODD

DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship_package(spark)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    out = ""
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        v = row[c]
        if v is not None:
            v = str(v + add if c == "n_chars" else v)
        out += "-" if v is None else f"{len(v.encode())}:{v}"
    return digest(out)


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def brute(rows):
    own = [leaf(r) for r in rows]
    langs = defaultdict(list)
    for k, r in enumerate(rows):
        langs[r["lang"]].append(k)
    for ks in langs.values():
        ks.sort(key=lambda k: (rows[k]["doc_id"] is not None, rows[k]["doc_id"] or 0, own[k]))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([own[k] for k in ks]) for x, ks in langs.items()}
    forest = levels([trees[x][-1][0] for x in order]) if order else []
    out = []
    for lang, ks in langs.items():
        for at, k in enumerate(ks):
            path = []
            for tree, i in ((trees[lang], at), (forest, order.index(lang))):
                for nodes in tree[:-1]:
                    path.append((i & 1, nodes[i ^ 1] if i ^ 1 < len(nodes) else None))
                    i >>= 1
            i = rows[k]["doc_id"]
            bad = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
            cur = leaf(rows[k], int(bad)) if rows[k]["n_chars"] is not None else own[k]
            for side, other in path:
                cur = digest(cur) if other is None else digest(other, cur) if side else digest(cur, other)
            root = forest[-1][0]
            proof = digest(*[s for _, s in path if s])
            out.append((i, own[k], trees[lang][-1][0], root, proof, cur, cur == root))
    return sorted(map(str, out))


def frame(spark, rows):
    names = ("doc_id", "text", "lang", "source", "n_chars")
    return spark.createDataFrame([(*[r[c] for c in names], "x", 1, 0.5, 2, 3, 4, "y", 5, 6, 7, "z", 8) for r in rows], DOCS)


def row(i, text, lang="en", source="s", n=1):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n}


def got(spark, rows, bits):
    return sorted(str(tuple(r)) for r in merkle.audited_manifest(frame(spark, rows), bits).collect())


def odd_rows():
    rows = [row(i, t, lang=["en", None, "", "de"][k % 4], n=None if k % 5 == 0 else len(t or "")) for k, (i, t) in enumerate(ODD)]
    rows += [row(7, "tie", source=None), row(7, "tie", source="-"), row(7, "tie", source=None), row(None, None, None, None, None)]
    rows += [row(100 + k, f"t{k}", lang="zz") for k in range(21)]  # 21 leaves: odd ones on three levels
    rows += [row(-5, "x", lang="é", n=2**63 - 1), row(1, "alone", lang="o")]
    return rows


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_of_odd_rows(spark, bits):
    rows = odd_rows()
    assert got(spark, rows, bits) == brute(rows)


def test_one_language_and_one_row(spark):
    """A forest of one tree adds no level, a tree of one leaf is the leaf."""
    for n in (1, 2, 5):
        rows = [row(k, f"t{k}") for k in range(n)]
        assert got(spark, rows, 1) == brute(rows)


def test_empty_table(spark):
    assert merkle.audited_manifest(frame(spark, [])).collect() == []
    assert merkle.build_manifest(frame(spark, [])).root is None


def test_tampering_is_found_and_only_that(spark):
    rows = [row(k, f"t{k}", lang="ab"[k % 2]) for k in range(300)]
    out = merkle.audited_manifest(frame(spark, rows), 3).collect()
    assert {r.doc_id for r in out if not r.verified} == {k for k in range(300) if zlib.crc32(str(k).encode()) % 7 == 0}


def test_proof_steps_lead_to_the_root(spark):
    rows = [row(k, f"t{k}", lang="abc"[k % 3]) for k in range(50)]
    out = merkle.build_manifest(frame(spark, rows), 2).proofs(siblings_too=True).collect()
    for r in out:
        cur = r.leaf
        for s in r.siblings:
            cur = digest(cur) if s.side == 2 else digest(s.digest, cur) if s.side == 0 else digest(cur, s.digest)
        assert cur == r.root
        assert r.proof_sha256 == digest(*[s.digest for s in r.siblings if s.side != 2])


def test_closed_form_positions():
    """position() is the place of every node in the order of completion, for every tree size."""
    for n in range(1, 70):
        top = merkle.height(n)
        log = merkle.postorder([bytes([k]) * 32 for k in range(n)], top)
        tree = [[bytes([k]) * 32 for k in range(n)]]
        while len(tree[-1]) > 1:
            tree.append([merkle.node(*tree[-1][k : k + 2]) for k in range(0, len(tree[-1]), 2)])
        seen = {}
        for level, nodes in enumerate(tree):
            for i, d in enumerate(nodes):
                at = int(merkle.position(level, i, n))
                assert log[at] == d
                seen[at] = (level, i)
        assert sorted(seen) == list(range(len(log)))


def test_log_is_gapless_and_in_order(spark):
    rng = random.Random(5)
    rows = [row(k, f"t{k}", lang=rng.choice(["a", "b", None])) for k in range(200)]
    m = merkle.build_manifest(frame(spark, rows), 3)
    logs = defaultdict(list)
    for r in m.log().collect():
        logs[r.lang, r.forest].append((r.position, r.level, r.digest))
    for (lang, forest), nodes in logs.items():
        nodes.sort()
        assert [p for p, _, _ in nodes] == list(range(len(nodes)))
        leaves = [bytes.fromhex(d) for _, level, d in nodes if level == 0]
        want = merkle.postorder(leaves, merkle.height(len(leaves)))
        assert [d for _, _, d in nodes] == [d.hex() for d in want]
        if forest:
            assert nodes[-1][2] == m.root
