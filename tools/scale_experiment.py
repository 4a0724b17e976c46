"""Time ``ui_features`` on a log 100x the sf0.1 events, uniform and skewed.

    python tools/scale_experiment.py OUT_DIR [copies]

Derives, once, under OUT_DIR (which must not exist yet): ``big`` — ``copies``
copies of sf0.1 ``events`` made with ``explode``, user and item ids offset per
copy — and ``skew`` — the same rows with a third of them moved to one user.
Then runs ``ui_features`` on each with default skew settings and with hot
users salted (``rows_per_split=20000``), and prints wall time and the longest
task of each run (from Spark's event log, written under OUT_DIR).
"""

from __future__ import annotations

import glob
import io
import json
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from cartcast.operators.features import ui_features  # noqa: E402
from cartcast.operators.skew import SkewConfig  # noqa: E402
from cartcast.session import get_session  # noqa: E402
from cartcast.sources.events import log_from_events  # noqa: E402


def derive(spark, out: Path, copies: int):
    ev = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    k = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("k")
    item = F.get_json_object("props", "$.k").cast("bigint") + F.col("k") * 100
    props = F.concat(F.lit('{"k": '), item.cast("string"), F.lit("}"))
    big = ev.select("*", k).select(
        "event_id", "ts", (F.col("user_id") + F.col("k") * 100000).alias("user_id"), "event_type", "value",
        props.alias("props"),
    )
    big.repartition(32).write.parquet(str(out / "big" / "events.parquet"))
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id"))
    big.select("event_id", "ts", hot.alias("user_id"), "event_type", "value", "props").repartition(32).write.parquet(
        str(out / "skew" / "events.parquet")
    )


def longest_tasks(log_dir: Path) -> dict[str, int]:
    import zstandard

    path = glob.glob(str(log_dir / "*" / "events_*"))[0]
    raw = open(path, "rb")
    lines = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8") if path.endswith(".zstd") else raw
    stage_run, longest = {}, {}
    for line in lines:
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            for s in e["Stage IDs"]:
                stage_run[s] = e.get("Properties", {}).get("spark.job.description")
        elif e["Event"] == "SparkListenerTaskEnd":
            run = stage_run.get(e["Stage ID"])
            info = e["Task Info"]
            if run:
                longest[run] = max(longest.get(run, 0), info["Finish Time"] - info["Launch Time"])
    return longest


def main():
    out = Path(sys.argv[1])
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 100
    out.mkdir(parents=True)
    log_dir = out / "eventlog"
    log_dir.mkdir()
    conf = {"spark.driver.memory": "16g", "spark.eventLog.enabled": "true", "spark.eventLog.dir": str(log_dir),
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # as in bench.py
    spark = get_session("local[8]", 8, **conf)
    derive(spark, out, copies)
    for name in ("big", "skew"):
        for label, cfg in (("default", SkewConfig()), ("salted", SkewConfig(rows_per_split=20000))):
            log = log_from_events(spark.read.parquet(str(out / name / "events.parquet")))
            spark.sparkContext.setJobDescription(f"{name}-{label}")
            t0 = time.time()
            ui_features(log, "2024-01-30", "2024-01-01", skew=cfg).write.format("noop").mode("overwrite").save()
            print(f"{name:5s} {label:8s} {time.time() - t0:7.2f} s", flush=True)
    spark.stop()
    print("longest task (ms):", longest_tasks(log_dir))


if __name__ == "__main__":
    main()
