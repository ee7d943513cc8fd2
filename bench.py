"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8) and BENCH_QUERIES
(comma-separated names, or "all") choose what runs.  Each query is written to
the noop sink after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chartloom.plans import load  # noqa: E402
from chartloom.session import get_session  # noqa: E402

HEADLINE = [
    "g01_patient_upsert", "g10_edge_merge", "g12_patient_statistics", "g16_visit_timeline", "g17_cross_patient_patterns",
    "g19_interacting_pairs", "g21_patient_bundle", "e07_resolved_pattern_spans", "e30_entities",
    "c04_semantic_chunks", "c05_fixed_chunks", "t08_structured_documents", "v03_nearest_cosine", "v12_group_cohesion",
    "i01_treatment_progression", "i10_risk_confidence", "h06_current_treatments", "h15_reports", "j03_job_view",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries, _ = load()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = get_session(cpus, "chartloom-bench", partitions=int(cpus) if cpus.isdigit() else 8)
    queries["g14_graph_statistics"](spark, sf).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        try:
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        except Exception as error:  # noqa: BLE001
            print(f"{name}: {error}", file=sys.stderr)
            times[name] = -1.0
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(t for t in times.values() if t > 0), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
