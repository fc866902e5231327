"""Time the registered queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` set the data and the cores;
names on the command line choose queries.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from suite import ALL  # noqa: E402
from tablewright.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    chosen = set(sys.argv[1:]) or {q.name for q in ALL}
    spark = local_session("bench", cores, partitions=int(cores) if cores.isdigit() else 8)
    # Start the JVM's compiler and the Python workers before anything is timed.
    for q in ALL:
        if q.name in ("dedupe_normalized", "remove_accents", "fillna_auto"):
            q.run(spark, sf_dir.replace("sf0.1", "sf0.01")).write.format("noop").mode("overwrite").save()
    took = {}
    for q in ALL:
        if q.name in chosen:
            start = time.perf_counter()
            q.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[q.name] = round(time.perf_counter() - start, 3)
            spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
