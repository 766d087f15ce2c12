"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores.
Every query runs to the end into a no-op sink, so no column is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "g01_piotroski", "g02_altman", "g03_beneish", "g04_excess_cash_flow", "g05_dividend_sustainability", "g07_breakout_score",
    "g08_technical_breakouts", "g09_risk_metrics", "g10_kelly", "g12_insider_signals", "g13_institutional_signals",
    "g16_master_composite", "g17_select_holdings", "g23_portfolio_scores", "g24_select_portfolio", "g28_sector_momentum",
    "g33_forward_returns", "g35_strategy_returns", "g38_walk_forward", "g40_brinson", "g46_ml_features", "g58_cost_basis",
    "j07_as_of_join", "k01_merge_latest", "w08_rsi",
)


def main(names: list[str]) -> None:
    from equiloom.plans import catalog
    from equiloom.session import local_session

    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "equiloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.run("w04_daily_returns", spark, directory).limit(1).count()  # starts the executors
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.run(name, spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = directory.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main(sys.argv[1:] or list(HEADLINE))
