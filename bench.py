"""Wall time of the headline queries; prints one JSON line.

Each query runs once to warm up (reported as cold) and once more for the reported figure. Results go
to the no-op sink, so that every column of every row is computed. BENCH_SF_DIR and BENCH_CPUS choose
the data and the cores; names given on the command line replace the headline set.
"""

from __future__ import annotations

import json
import os
import sys
import time

from contractspark.plans.queries import QUERIES
from contractspark.session import local_session

HEADLINE = (
    "metrics_by_type", "parse_outputs", "align_predictions", "clean_examples", "cleaning_report", "cleaning_summary",
    "validate_candidates", "first_valid_attempt", "qa_to_contracts", "merge_chunks", "chunk_pages", "doc_text",
    "normalize_text", "length_audit", "split_eval", "carve_payload",
)


def seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    names = sys.argv[1:] or HEADLINE
    cold = {name: seconds(spark, name, sf_dir) for name in names}
    warm = {name: seconds(spark, name, sf_dir) for name in names}
    print(json.dumps({
        "metric": "total warm wall time of the headline queries",
        "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
