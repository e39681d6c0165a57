"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads. Each query is run once to warm up
and then three times, writing its whole result to a sink that drops it; the median counts. The
control, a plain scan with an aggregate whose code never changes, tells a slower machine from slower code.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "voting_balance", "interval_at", "fact_at", "excused_at", "same_context_window", "record_to_item", "group_tally", "claim_vote_join", "gate_agreement", "tally_reconcile",
    "topk_similar", "pair_enrich", "composite_score", "speech_metrics", "consistency_index", "state_tally", "to_facts", "upsert_latest", "lead_queue", "html_to_text",
)

CONTROL = "dataset_meta"


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    root = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = root + os.pathsep + os.environ.get("PYTHONPATH", "")
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

    from pyspark.sql import SparkSession

    from evidence.plans import catalog

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, times = catalog.queries(), {}
    for name in (*HEADLINE, CONTROL):
        taken = []
        for _ in range(4):  # the first run warms up
            began = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken[1:]), 3)
    control = times.pop(CONTROL)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "control": {CONTROL: control}, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
