"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up, then the best of three runs each."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plinth.plans import registry  # noqa: E402
from plinth.session import session  # noqa: E402

HEADLINE = [f"q{i:02}" for i in range(1, 23)]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus})
    times, all_queries = {}, registry.queries()
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            begin = time.time()
            all_queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - begin)
        times[name] = round(min(runs[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "tpch_like_22_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
