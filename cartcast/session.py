"""Session helpers: a configured SparkSession and the shared scratch folder.

Written tables and checkpoints go under the folder the cluster names in
``spark.checkpoint.dir``; a folder of our own is set only when that is unset
and Spark runs in local mode (tests, the bench).
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on. AQE re-plans joins and
# coalesces shuffle partitions at run time; skew-join splitting covers the
# shuffled joins that are not salted explicitly.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(
    master: str | None = "local[*]", shuffle_partitions: int | None = 8, **conf
) -> SparkSession:
    """A session with ``SESSION_CONF``. ``master=None`` leaves the master to
    ``spark-submit``; ``shuffle_partitions=None`` leaves that setting alone."""
    builder = SparkSession.builder.appName("cartcast")
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(
    input_bytes: int,
    total_cores: int,
    shuffle_fraction: float = 0.3,
    split_bytes: int = 512 << 20,
    shuffle_partition_bytes: int = 200 << 20,
) -> dict[str, str]:
    """Settings for a cluster run over ``input_bytes`` of (compressed) log.

    Read splits of ``split_bytes`` keep the map-task count moderate. The first
    aggregate shuffles roughly ``shuffle_fraction`` of the input after its
    map-side combine; it gets partitions of about ``shuffle_partition_bytes``
    (at least two per core), and AQE coalesces the later, smaller shuffles
    towards the advisory size and splits skewed partitions of shuffled joins.
    """
    shuffle_bytes = input_bytes * shuffle_fraction
    partitions = max(2 * total_cores, math.ceil(shuffle_bytes / shuffle_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(shuffle_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * shuffle_partition_bytes),
    }


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder for checkpoints and written tables.

    Uses ``spark.checkpoint.dir`` from the session. Only in local mode, and only
    if nothing is configured, a fresh folder is made under the system temp dir.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a folder every executor shares"
            )
        base = tempfile.mkdtemp(prefix="cartcast-ckpt-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


# Paths handed out by ``shared_path`` and not yet removed, oldest first.
_written: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/cartcast/{name}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    return path


def cleanup(spark: SparkSession, since: int = 0) -> int:
    """Remove the intermediate tables written so far; returns how many.

    Results are lazy and read these tables, so call it when a result has been
    written or collected. ``since`` (a former ``len(written())``) leaves older
    ones alone.
    """
    paths, _written[since:] = _written[since:], []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        removed += bool(target.getFileSystem(conf).delete(target, True))
    return removed


def written() -> list[str]:
    """Paths of the intermediate tables that have not been removed."""
    return list(_written)


@contextmanager
def intermediates(spark: SparkSession):
    """Scope that removes, at its end, the intermediate tables written inside."""
    before = len(_written)
    try:
        yield
    finally:
        cleanup(spark, before)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    For a table several branches of one plan read: without it each branch
    recomputes it from the source (column pruning gives every branch its own
    variant, so shuffle reuse does not apply). The written copy survives
    executor loss, and Parquet keeps it compressed and columnar.
    """
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
