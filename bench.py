"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from colflow.session import local_session  # noqa: E402
from colflow.workload.registry import QUERIES  # noqa: E402

# the first lineage query also analyzes every template's plan
HEADLINE = [
    "data_order_lines", "data_two_roles", "data_composite_join", "data_one_to_one",
    "statement_fingerprint", "column_origins", "lineage_join_multiway", "lineage_window_agg", "lineage_union",
    "extract_attr_edges", "resolve_columns_ci", "nest_response", "response_json", "render_text", "source_columns",
    "focus_column", "error_body", "column_usage", "top_columns", "lineage_diff", "upstream_closure",
    "downstream_impact", "verify_direct", "stream_lineage",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "colflow-bench")
    # start the executors and the parquet reader before timing
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
