"""The stages one after another, each held to what it promises of its own input."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from cartcast.llm import mixing
from cartcast.llm.queries import ORACLE_SQL, QUERIES
from cartcast.session import intermediates
from helpers import FOLD, jaccard_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Every stage's input and output on sf0.001, written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_quality_stage(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    wrong = [i for i, q in labels.items() if (i in kept) != bool(q)]
    assert kept and len(wrong) <= 0.05 * len(labels)


def test_exact_stage(steps):
    groups = {}
    for r in steps[1].collect():
        key = (r.text or "").translate(FOLD)
        groups[key] = max(groups.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(groups.values())


def test_near_stage(steps):
    comp = jaccard_brute([(r.doc_id, r.text) for r in steps[2].collect()], 5, 80)
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(i for i, c in comp.items() if c[1] == i)


def test_mixing_stage(spark, steps):
    labels = mixing.domain_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    told = {r.doc_id: r.copies for r in mixing.mixed(steps[3], labels, mixing.DOMAINS).collect()}
    got = {r.doc_id: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in told.items() if c}


def test_packing_stage(steps):
    pieces = {}
    for r in steps[5].collect():
        pieces.setdefault(r.doc_id, set()).add(r.piece)
    assert set(pieces) == {r.doc_id for r in steps[4].collect()}


def test_run_equals_the_stages(spark, steps):
    with intermediates(spark):
        rows = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    want = steps[5].select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want))


def test_every_operator_is_registered():
    names = set(E.queries())
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, rel = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    assert got == sorted(map(str, rel.select(*[f'"{c}"' for c in cols]).fetchall()))


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    import cartcast

    root = Path(cartcast.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "cartcast.llm" not in f.read_text(), f
