"""Session helpers: cluster sizing, the shared folder and what is written there."""

from __future__ import annotations

from pathlib import Path

from cartcast.session import cluster_conf, cut_lineage, ensure_checkpoint_dir, intermediates, shared_path, written


def test_cluster_conf_sizes_partitions():
    conf = cluster_conf(100 * 10**12, 8000)
    parts = int(conf["spark.sql.shuffle.partitions"])
    assert parts == 143052  # 30% of 100 TB in ~200 MB partitions
    assert int(cluster_conf(10**6, 64)["spark.sql.shuffle.partitions"]) == 128  # at least 2 per core
    assert conf["spark.sql.adaptive.coalescePartitions.parallelismFirst"] == "false"


def test_intermediates_are_removed_at_the_end_of_their_scope(spark):
    kept = cut_lineage(spark.range(3), "kept")
    with intermediates(spark):
        inner = cut_lineage(spark.range(5), "inner")
        assert inner.count() == 5
        path = Path(written()[-1].removeprefix("file:"))
        assert path.exists()
    assert not path.exists() and kept.count() == 3


def test_shared_folder_comes_from_the_session(spark):
    base = ensure_checkpoint_dir(spark)
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        assert base == configured
    a, b = shared_path(spark, "x"), shared_path(spark, "x")
    assert a != b and a.startswith(base.rstrip("/") + "/cartcast/x-")
    back = cut_lineage(spark.range(5), "t")
    assert back.count() == 5 and "cartcast/t-" in back.inputFiles()[0]
