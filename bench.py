"""Benchmark: headline queries on the driver tables.

Runs each query to completion through the ``noop`` sink (full computation,
nothing collected to the driver) on ``local[$BENCH_CPUS]`` against
``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) and prints ONE JSON line.
Before the clock starts, the smallest tables warm the JVM up with queries that
cover the same expressions.  With ``BENCH_EVENTS`` naming a folder, Spark's
event log goes there and the line also gives stages and shuffled MB by query.
"""

from __future__ import annotations

import glob
import json
import os
import re
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "best_email_per_page", "best_phone_per_page", "contact_page_fallback", "business_verdict",
    "validated_businesses", "duplicate_pairs", "dedup_businesses", "enriched_emails",
    "enriched_phones", "url_intake_errors", "attempt_outcome", "redirect_targets",
    "fresh_lookup", "email_mentions", "phone_mentions", "custom_scrape_rows",
    "flagship_coverage", "listing_cards", "export_txt_blocks",
]
WARM_UP = ["best_email_per_page", "business_verdict", "dedup_businesses", "attempt_outcome"]


def _run(name, spark, sf_dir):
    from contactlake.plans.queries import REGISTRY
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def _from_events(folder: str, spans: list[tuple[str, float, float]]) -> dict:
    """Stages and shuffled MB by query, from the event log."""
    out = {name: Counter() for name, *_ in spans}
    for path in glob.glob(os.path.join(folder, "**", "*"), recursive=True):
        if not os.path.isfile(path):
            continue
        for line in open(path, errors="replace"):
            if '"SparkListenerStageCompleted"' not in line:
                continue
            info = json.loads(line)["Stage Info"]
            at = info.get("Submission Time", 0) / 1000
            name = next((n for n, a, b in spans if a <= at <= b), None)
            if name:
                out[name]["stages"] += 1
                out[name]["shuffle_mb"] += sum(float(a["Value"]) for a in info["Accumulables"]
                                               if a["Name"] == "internal.metrics.shuffle.write.bytesWritten") / 1e6
    return {n: {"stages": c["stages"], "shuffle_mb": round(c["shuffle_mb"], 2)} for n, c in out.items()}


def main() -> None:
    from contactlake import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    events = os.environ.get("BENCH_EVENTS")
    extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{events}", "spark.eventLog.compress": "false",
             "spark.eventLog.rolling.enabled": "false"} if events else {}
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), extra=extra)
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in WARM_UP:
            _run(name, spark, small)
    times, spans = {}, []
    for name in sys.argv[1:] or HEADLINE:
        t0 = time.time()
        _run(name, spark, sf_dir)
        times[name] = round(time.time() - t0, 3)
        spans.append((name, t0, time.time()))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    if events:
        spark.stop()
        out["work"] = _from_events(events, spans)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
