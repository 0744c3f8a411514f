"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Every query runs to completion through the ``noop`` sink (all rows
produced, nothing collected to the driver).  One warm-up query runs first
so JVM start-up is not charged to the first headline query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "run_report", "node_metrics", "fleet_aggregate", "list_runs", "eval_cases", "fold_state",
    "reduce_append", "guard_trip", "retry_schedule", "merge_barrier", "answer_asof", "redact",
    "validate_schema", "normalize_trace", "word_fanout", "same_attribute_edges",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in sys.argv[1:] if q]
    os.environ["BENCH_CPUS"] = cpus
    from runlens.plans import registry
    from runlens.session import get_session

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    registry.load_all()
    # warm-up: JIT, class loading, first parquet footer reads
    registry.QUERIES["fleet_aggregate"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
