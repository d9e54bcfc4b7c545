"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import logtide.registry  # noqa: E402,F401
from logtide.plans.session import local_session  # noqa: E402
from logtide.registry.queries import QUERIES  # noqa: E402

HEADLINES = [
    "segment_records", "build_records", "mask_variables", "exact_templates", "mine_templates",
    "template_summary", "clean_text", "ts_iso", "component_tags", "signal_spread", "tumbling_windows",
    "merge_windows", "anomaly_items", "window_preview", "signal_timeline", "temporal_evolution",
    "template_series", "granger_pairs", "log_store_templates", "log_store_entries", "explore_facets",
    "explore_page", "json_records", "escape_tags",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(
        cpus, int(cpus), **{"spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"}
    )
    QUERIES["tumbling_windows"](spark, sf_dir).count()  # start the workers
    times = {}
    for name in HEADLINES:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
