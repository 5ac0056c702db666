"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES
(comma-separated names or ``all``). Each query runs once to warm up and once
for the time; results are written to Spark's ``noop`` sink, so every row is
computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from strandcheck.plans.registry import all_queries
from strandcheck.session import build_session

HEADLINE = (
    "per_reference_qc", "dedup_records", "flag_counts", "region_counts", "mapq_histogram", "record_medians",
    "tag_presence", "barcode_rank", "barcode_metrics", "barcode_knee", "barcode_shape", "unique_molecules",
    "top_genes", "assay_label", "qc_flags", "convergence_checkpoints", "price_quartiles", "fai_n50",
    "reference_fingerprint", "fastq_read_totals", "fastq_per_cycle", "fastq_integrity", "text_motifs",
    "dataset_resolution", "index_totals", "index_status", "seek_points_stratified", "bam_scan", "bai_scan",
    "fastq_scan", "fastq_gzip_scan",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = all_queries()
    names = list(queries) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times: dict[str, float] = {}
    for name in names:
        cold = run(name)
        times[name] = round(run(name), 3)
        print(f"{name}: {cold:.2f} cold, {times[name]:.2f} warm", file=sys.stderr, flush=True)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
