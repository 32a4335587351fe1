"""Seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line.

Every query is planned and run to the end (``noop`` sink) once to warm up and
``BENCH_RUNS`` times for the clock; the best run counts. Queries that train a
model run once, without warm-up. With BENCH_SQL
set, the same results are timed as SQL on DuckDB for comparison.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stallwise.plans.oracle import ORACLE  # noqa: E402
from stallwise.plans.workload import QUERIES  # noqa: E402
from stallwise.session import local_session  # noqa: E402

ONCE = (
    "eta_model_metrics", "cancel_model_metrics", "score_eta", "score_cancellation_risk", "score_validated",
    "model_round_trip", "model_registry",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = list(QUERIES)
    shared = tempfile.TemporaryDirectory(prefix="stallwise-bench-")
    settings = {"spark.driver.memory": "8g", "spark.checkpoint.dir": shared.name}
    spark = local_session(cpus, shuffle_partitions=int(cpus), **settings)

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        if name not in ONCE:
            once(name)
        seconds[name] = round(min(once(name) for _ in range(1 if name in ONCE else runs)), 3)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1],
        "cpus": cpus,
        "spark": spark.version,
    }
    if os.environ.get("BENCH_SQL"):
        line["sql_queries"] = _sql_seconds(sf_dir, [n for n in names if n in ORACLE], runs)
    spark.stop()
    shared.cleanup()
    print(json.dumps(line))


def _sql_seconds(sf_dir: str, names: list[str], runs: int) -> dict[str, float]:
    import duckdb

    db = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")

    def once(name: str) -> float:
        start = time.perf_counter()
        db.execute(f"CREATE OR REPLACE TEMP TABLE bench_result AS {ORACLE[name]}")
        return time.perf_counter() - start

    return {name: round(min(once(name) for _ in range(runs + 1)), 3) for name in names}


if __name__ == "__main__":
    main()
