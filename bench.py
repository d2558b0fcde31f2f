"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm up its plan on the smallest data, then once for the record; every
row of the result is produced, none is collected.
"""

from __future__ import annotations

import json
import os
import time

from ledgerloom.plans.catalog import QUERIES
from ledgerloom.session import local_session

HEADLINES = [
    "category_summary", "channel_summary", "top_merchants", "monthly_trend", "totals", "report_cube",
    "classify_heuristic", "merchant", "normalize_text", "hybrid", "apply_overrides", "search",
    "audit_rows", "audit_anomalies", "statement_totals", "balance_health", "audit_identity",
    "clean_amount", "parse_date", "assemble_rows", "infer_direction", "ledger_lines", "section_lines",
    "boxes_to_lines", "detect_issuer", "holder", "doc_typing", "tfidf", "csv_projection",
    "sheet_transactions", "stream_ingest",
]
WARM_UP = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")


def run(spark, name: str, sf_dir: str) -> float:
    started = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("OFF")
    if os.path.isdir(WARM_UP):
        for name in HEADLINES:
            run(spark, name, WARM_UP)
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in HEADLINES}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
