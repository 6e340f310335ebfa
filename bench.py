"""Time the headline work at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; print one JSON line.

``etl`` runs the whole load from the raw tables once. The figures named like the published
baseline (KPI summary, scorecard, page, report, training) run on the stored shipments it wrote.
The other queries run once each from the raw tables. ``train_forest_<n>`` fits ``n`` trees
(``$BENCH_TREES``). Progress goes to stderr.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from haulmark.operators import reporting
from haulmark.operators.forest import train_model
from haulmark.plans import jobs, serving
from haulmark.plans.catalog import REGISTRY
from haulmark.session import build_session
from haulmark.sources import star

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TREES = int(os.environ.get("BENCH_TREES", "40"))
FROM_RAW = [
    "shipments_enriched",
    "kpi_summary",
    "weekly_otif_trend",
    "seller_scorecard",
    "seller_profile",
    "flagged_shipments",
]


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    took = round(time.perf_counter() - start, 3)
    print(f"{took:8.3f}s", file=sys.stderr, flush=True)
    return took


def main() -> None:
    spark = build_session(
        "haulmark-bench",
        master=f"local[{CPUS}]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sources = star.StarSources(spark, FOLDER)
    seconds = {"etl": timed(lambda: jobs.run_etl(spark, sources, star.ORDINAL, root, "2024-01-01 00:00:00"))}

    shipments = jobs.shipments_table(spark, root).read()
    stored = {
        "stored_kpi_summary": lambda: noop(serving.kpi_summary(spark, root)),
        "stored_seller_scorecard": lambda: noop(serving.seller_scorecard(spark, root)),
        "stored_shipments_page": lambda: noop(serving.shipments_page(spark, root)),
        "stored_delay_by_category": lambda: noop(serving.delay_by_category(spark, root)),
        "stored_week_flagged": lambda: noop(reporting.late_of_week(shipments, "1995-07-19")),
        "stored_weekly_report": lambda: jobs.run_report(spark, root, "1995-07-19"),
    }
    for name, work in stored.items():
        work()
        seconds[name] = timed(work)
    for name in FROM_RAW:
        seconds[name] = timed(lambda name=name: noop(REGISTRY[name](spark, FOLDER)))
    seconds[f"train_forest_{TREES}"] = timed(lambda: train_model(shipments, numTrees=TREES))

    found = re.search(r"sf([0-9.]+)", FOLDER)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
