"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set), BENCH_REPEAT (default 2).
The derived governance tables are first stored as parquet (untimed, as a
deployment keeps them); each query then runs in full into a ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from grantlens.plans import registry  # noqa: E402
from grantlens.session import local_session, scratch_path  # noqa: E402
from grantlens.sources.fixtures import FIXTURES, TableSet, materialize  # noqa: E402

HEADLINE = ["reconcile", "bindings_history_snapshot", "sheet_permission_history", "permission_matrix_status",
            "request_execution_latest", "expired_grants", "sheet_requests_review", "inventory_with_requests",
            "binding_first_seen", "bulk_review", "policy_diff_results", "resolve_ancestors"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus) * 2, app="grantlens-bench")
    stored = scratch_path(spark, f"bench-tables-{os.path.basename(sf_dir.rstrip('/'))}-{os.getpid()}")
    t0 = time.time()
    materialize(spark, sf_dir, stored, list(FIXTURES))
    prep = time.time() - t0
    tables = TableSet(spark, sf_dir, stored=stored)
    timings = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t = time.time()
            registry.run(name, tables).write.format("noop").mode("overwrite").save()
            dt = time.time() - t
            best = dt if best is None else min(best, dt)
        timings[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": sf, "prep_sec": round(prep, 3), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
