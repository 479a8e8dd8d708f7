"""Time the headline queries: one JSON line on stdout.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, optional).
"""
from __future__ import annotations

import json
import os
import time

from panelyard.registry import load_all
from panelyard.session import get_spark

HEADLINE = [
    "flagship_attribution",        # panel -> z -> weights -> net returns -> attribution
    "P3_normalised_panel",         # normalise all variables
    "P1_unified_view",             # build the daily and monthly panels
    "F3_next_day_factor_returns",  # daily factor returns
    "W7_prior_window_z",
    "W19_rolling_mad_winsor",
    "A12_benchmarks",
    "J4_asof_backward",
    "J8_day_offset_join",
    "G2_network_features",         # graph rebuild
    "G10_fundamental_twins",
    "H6_backtest_daily_tranches",
    "H13_H15_evaluate_sweep",      # signal sweep
    "D4_cross_asset",
    "E8_mark_theses",
    "R5_event_paths",
    "A6_entity_day",
    "A20_global_composites",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = get_spark("bench", f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    for n in ("S1_panel_scan", "W2_cross_z_sample"):  # JVM warm-up, not timed
        registry[n](spark, path).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        registry[n](spark, path).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(path.rstrip("/"))}))


if __name__ == "__main__":
    main()
