"""Times the headline queries; prints one JSON line. ``--duckdb`` adds DuckDB's times for the same SQL."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
#: One or two of each group: scalars, aggregates, joins, windows, folds, composite.
HEADLINE = (
    "flagship_manifest", "content_identity", "classify_source", "heading_demotion", "text_measures", "content_dedup", "status_counts", "queue_position",
    "queue_metrics", "claim_order", "dependency_antijoin", "latest_attempt", "kind_pivot", "fanin_full_outer", "event_sequence", "events_after_cursor",
    "job_state_fold", "merge_candidates", "segment_tokens", "ahash", "marker_contains", "hourly_events",
)


def timed(function) -> float:
    function()
    runs = []
    for _ in range(RUNS):
        began = time.perf_counter()
        function()
        runs.append(time.perf_counter() - began)
    return round(statistics.median(runs), 3)


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent))
    from docframe.plans import registry
    from docframe.session import local

    spark = local(CPUS, int(CPUS), os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    seconds = {name: timed(lambda q=queries[name]: q(spark, SF_DIR).write.format("noop").mode("overwrite").save()) for name in HEADLINE}
    out = {"metric": "headline queries, median of warm runs, summed", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(SF_DIR).name, "cpus": int(CPUS)}
    spark.stop()
    if "--duckdb" in sys.argv:
        import duckdb

        con = duckdb.connect(config={"threads": int(CPUS)})
        for path in Path(SF_DIR).iterdir():
            con.sql(f"create view {path.stem} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
        sql = registry.oracle_sql()
        out["duckdb"] = {name: timed(lambda s=sql[name]: con.sql(s).fetchall()) for name in HEADLINE if name in sql}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
