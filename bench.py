"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelwright.catalog import QUERIES  # noqa: E402
from panelwright.session import local_session  # noqa: E402

HEADLINE = (
    "E0_momentum_backtest", "F0_build_features", "F0_all_blocks_metals", "F3_rank_ic", "C4_panel_align", "J3_asof_join",
    "I8_rolling_z_wide", "G1_confidence_whole", "L5_perf", "L9_sweep", "R3_rotation_ledger",
    "X3_screen", "X5_basis_risk", "M4_walk_forward", "M14_ensemble", "V3_oof_validation", "T3_headline_dedup",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, max(8, int(cpus)))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
