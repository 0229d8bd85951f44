"""Times the headline queries and prints one JSON line.

Reads $BENCH_SF_DIR on local[$BENCH_CPUS].  Deriving samples and abundance from
the given tables is timed once per data set; every query then starts from those
two tables, with nothing else shared between queries.
"""

from __future__ import annotations

import json
import os
import time

from cohortloom.plans import basket, catalogue, registry
from cohortloom.session import local_session

HEADLINE = (
    "feature_landscape", "association_screen", "mannwhitney_screen", "dl_random_effects", "loco_screen",
    "loco_rescreen", "covariate_screen", "variance_partition_sequential", "permutation_pseudo_f",
    "prevalence_matched_panels", "loso_elastic_net")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session(cores)
    catalogue.QUERIES["pseudocount"](spark, folder).collect()  # start the workers before the clock
    basket.forget()
    times = {}
    for data in ("fine", "coarse"):
        start = time.perf_counter()
        basket.baskets(spark, folder, data)
        times[f"derive_{data}"] = round(time.perf_counter() - start, 3)
    for name in only:
        registry.forget_analyses()
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).collect()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
