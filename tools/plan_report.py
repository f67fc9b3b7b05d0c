"""Summarise the physical plans of the headline queries (markdown on stdout).

For each query: shuffles by partitioning type, broadcasts, Python evaluation
nodes, and the scans' read schemas and pushed filters (initial adaptive plan).
Usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NAMES = ["score_tickets", "keyword_hits", "score_tickets_model", "distributions", "kpi_cards", "triage_replay",
         "patch_tickets", "tfidf_weights", "word_frequency", "correlation_matrix", "clean_corpus",
         "stratified_split", "list_tickets", "confusion_matrix"]


def summarize(df) -> dict:
    qe = df._jdf.queryExecution()
    plan = qe.executedPlan().toString()
    ex = re.findall(r"Exchange (\w+)\(", plan)
    return {
        "shuffles": {k: ex.count(k) for k in sorted(set(ex))},
        "broadcast": plan.count("BroadcastExchange"),
        "python": any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF")),
        "scans": sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))),
        "pushed": sorted(set(p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if p)),
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from deskflow.plans import queries
    from deskflow.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    qs = queries()
    print("| query | shuffles (by partitioning) | broadcasts | Python | scan read schema | pushed filters |")
    print("|---|---|---|---|---|---|")
    for n in NAMES:
        df = qs[n](spark, sf_dir)
        s = summarize(df)
        sh = ", ".join(f"{k}×{v}" for k, v in s["shuffles"].items()) or "none"
        print(f"| `{n}` | {sh} | {s['broadcast']} | {'yes' if s['python'] else 'no'} | "
              f"{'; '.join(f'`{x}`' for x in s['scans'])} | {'; '.join(s['pushed']) or '-'} |")


if __name__ == "__main__":
    main(sys.argv)
