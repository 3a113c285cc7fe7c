"""Times the headline queries: one warm-up, then the median of the timed runs, as one line of JSON.

BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8) and BENCH_RUNS (default 5) set the run; ``spread`` is the longest
run less the shortest. BENCH_MORE=1 adds the same plans on skewed keys and the movie workload, under ``more``.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from brindle.plans import job, movies, skew, tpch
from brindle.session import build_session
from brindle.tables import Database

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def timed(make) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(f"local[{CPUS}]", CPUS, spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    db = Database(spark, SF_DIR)
    seconds, spread = {}, {}
    more = skew.PLANS | movies.PLANS if os.environ.get("BENCH_MORE") == "1" else {}
    for name, plan in (tpch.PLANS | job.PLANS | more).items():
        timed(lambda plan=plan: plan(db))
        runs = [timed(lambda plan=plan: plan(db)) for _ in range(RUNS)]
        seconds[name], spread[name] = round(median(runs), 4), round(max(runs) - min(runs), 4)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    headline = {n: s for n, s in seconds.items() if n not in more}
    out = {"metric": "total_query_time", "value": round(sum(headline.values()), 4), "unit": "sec", "queries": headline, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "spread": spread}
    if more:
        out["more"] = {n: seconds[n] for n in more}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
