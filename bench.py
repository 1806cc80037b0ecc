"""Time the headline queries once each and print one JSON line.

BENCH_SF_DIR names the folder of the test tables, BENCH_CPUS the local cores.
Every result is produced in full, into a sink that discards it.  The queries of a session
share one campaign, so the tables it stages are made by the first query that needs them.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from offerscope.plans import catalog
from offerscope.session import build_session

HEADLINE = (
    "event_log",
    "opportunities",
    "informational_success",
    "funnel_by_type",
    "funnel_by_offer",
    "completion_by_channel",
    "spend_by_user_group",
    "send_rank",
    "numeric_summary",
    "history_features",
    "context_features",
    "design_matrix",
    "arm_posterior_step",
    "thompson_choice",
    "policy_summary",
    "recommend",
    "replay_running",
    "policy_regret",
    "calibration",
    "replay_thompson",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # class loading and first-use compilation, not part of any query
    catalog.queries()["events_by_type"](spark, sf_dir).collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    catalog.release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
