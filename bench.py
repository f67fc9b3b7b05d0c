"""Benchmark: wall time of the headline queries at one scale factor.

Runs on local[$BENCH_CPUS] over $BENCH_SF_DIR (default /root/testdata/sf0.1).
Each query is executed in full into Spark's no-op sink (every row computed,
nothing collected to the driver); the reported time per query is the best of
$BENCH_REPEATS runs (default 2) after a JVM warm-up. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "keyword_hits",          # #36 per-department hit counts (236 keywords)
    "score_tickets",         # #42 flagship rule-path scoring
    "score_tickets_model",   # #43 model-path scoring joined to probabilities
    "distributions",         # #62 five distributions in one pass
    "tfidf_weights",         # #76 exact TF-IDF over whole documents
    "correlation_matrix",    # #23 36 Pearson correlations
    "triage_replay",         # #61 action-log replay
    "word_frequency",        # #24 top-150 words over whole documents
]

# Queries whose work is on texts: the one row group of their table is spread over the cores first.
SPREAD = {"keyword_hits", "score_tickets", "score_tickets_model", "tfidf_weights", "word_frequency", "correlation_matrix"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    from deskflow.plans import queries
    from deskflow.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up
    times = {}
    for name in HEADLINE:
        best = None
        spark.conf.set("deskflow.read.partitions", cpus if name in SPREAD else "0")
        for _ in range(repeats):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "repeats": repeats}))


if __name__ == "__main__":
    main()
