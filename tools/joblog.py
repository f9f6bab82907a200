"""Per-job timings of one registered query from Spark's event log.

Usage: python tools/joblog.py <query> [sf_dir]
The event log goes to a fresh scratch folder (no UI, no server); the second
(warm) run's jobs are listed with duration and stage count.
"""

from __future__ import annotations

import glob
import io
import json
import sys
import tempfile
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])


def main(argv):
    import zstandard
    from pyspark.sql import SparkSession

    from moodspark.plans.registry import queries

    name = argv[1]
    sf = argv[2] if len(argv) > 2 else "/root/testdata/sf0.1"
    logdir = tempfile.mkdtemp(prefix="moodspark-evlog-", dir="/tmp")
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", f"file://{logdir}").config("spark.sql.shuffle.partitions", "8")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    q = queries()[name]
    q(spark, sf).write.format("noop").mode("overwrite").save()
    t0 = time.time()
    q(spark, sf).write.format("noop").mode("overwrite").save()
    wall = time.time() - t0
    spark.stop()
    path = sorted(glob.glob(f"{logdir}/*/events*"))[-1]
    stream = zstandard.ZstdDecompressor().stream_reader(open(path, "rb")) if path.endswith(".zstd") else open(path, "rb")
    jobs: dict[int, list] = {}
    for line in io.TextIOWrapper(stream, encoding="utf-8"):
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart" and e["Submission Time"] / 1000 >= t0:
            jobs[e["Job ID"]] = [e["Submission Time"], None, len(e["Stage IDs"])]
        elif e["Event"] == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]][1] = e["Completion Time"]
    busy = sum(((c or s) - s) / 1000 for s, c, _ in jobs.values())
    print(f"{name}: wall {wall:.2f}s, {len(jobs)} jobs, {busy:.2f}s inside jobs")
    for j, (s, c, n) in sorted(jobs.items()):
        print(f"  job {j}: {((c or s) - s) / 1000:.2f}s, {n} stages")


if __name__ == "__main__":
    main(sys.argv)
