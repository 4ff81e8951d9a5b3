"""Wall-clock seconds of the headline queries, as one JSON line."""

import json
import os
import sys
import time

from loomspan.plans.catalog import QUERIES
from loomspan.session import local_session

HEADLINE = [
    "interval_resolved", "interval_overlap_summary", "interval_union", "interval_coverage", "interval_gaps", "interval_overlap_join",
    "interval_resolved_sequential", "summary_by_group", "summary_rollup", "diversity_by_group", "box_statistics", "local_extrema",
    "pattern_subset_check", "taxonomy", "windows_by_midpoint", "windows_jumping", "family_linkage", "copy_numbers", "ortholog_links",
    "cigar_totals", "cigar_histogram",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    took = {}
    QUERIES["taxonomy"](spark, folder).count()  # starts the session's workers and compilers
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
