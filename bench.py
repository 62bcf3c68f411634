"""Benchmark: every named query, and the whole chain from raw tables to study population.

Each query is timed alone, on the written tables that the chain materialises before it: the median
of up to BENCH_RUNS runs after one warm-up (no further run once they took ENOUGH seconds), drained
to Spark's noop sink. ``chain`` is the making of those tables, first thing in a fresh session, from
the raw tables to the study population. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kinspark.plans.queries import QUERIES  # noqa: E402
from kinspark.plans.study import FolderStudy  # noqa: E402
from kinspark.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
ENOUGH = 20.0
ONLY = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def chain(study: FolderStudy) -> dict[str, float]:
    """Seconds per written table, in order."""
    steps = {
        name: timed(lambda name=name: getattr(study, name))
        for name in (
            "census", "counties", "extract", "master", "adults", "slaveholders", "descent",
            "marriages", "residents", "lineage", "graph", "ids", "attributes", "base",
        )
    }
    steps["study_population"] = timed(lambda: study.stage.write("study", study.build_study_population()))
    return steps


def main() -> None:
    cores = int(CPUS) if CPUS.isdigit() else os.cpu_count()
    spark = local_session(cores=cores, shuffle_partitions=cores)
    names = ONLY or list(QUERIES)
    study = FolderStudy(spark, SF_DIR)
    steps = chain(study)
    seconds = {}
    for name in names:
        drain(QUERIES[name](study))
        runs: list[float] = []
        while len(runs) < RUNS and sum(runs) < ENOUGH:
            runs.append(timed(lambda name=name: drain(QUERIES[name](study))))
        seconds[name] = round(statistics.median(runs), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    study.stage.release()
    print(
        json.dumps(
            {
                "metric": "sum of the median seconds of all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": cores,
                "chain_sec": round(sum(steps.values()), 3),
                "chain": {name: round(s, 3) for name, s in steps.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
