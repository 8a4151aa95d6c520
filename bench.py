"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each query is planned and run from the table files on every repetition (the
group facts and profiles it needs are part of its time); the figure is the
median of $BENCH_RUNS runs (2) after one that warms up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", "/tmp/checkpoints")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = session()
    import datetime as dt

    from catalogue.fixture import ledger_raw
    from tallymark import (Options, profile, read_ordered, run_ledger, run_universal,
                           status_pivot, top_clients, tune)
    from tallymark.functions import text
    from tallymark.operators.schema import map_columns
    from tallymark.plans.ledger import flag_rows_locally, scrub

    tune(spark)
    day = dt.date(2000, 6, 30)

    # Each test table is one file with one row group, hence one task; a table of
    # many row groups needs no such spreading.
    def table(name):
        return spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(int(CPUS))

    def opts(key):
        return Options(order_by=key, as_of=day)

    def sink(df):
        df.write.format("noop").mode("overwrite").save()

    lineitem = read_ordered(spark, f"{SF_DIR}/lineitem.parquet").repartition(int(CPUS))
    dirty = ledger_raw(spark, SF_DIR).repartition(int(CPUS))
    queries = {
        "ledger_run_lineitem": lambda: sink(run_ledger(lineitem, opts("row_order")).clean),
        "ledger_run_dirty": lambda: sink(run_ledger(dirty, opts("row_id")).clean),
        "ledger_local_rules_dirty": lambda: sink(flag_rows_locally(dirty, opts("row_id"))),
        "clean_text_dirty": lambda: sink(scrub(map_columns(dirty, None, "row_id").df,
                                               opts("row_id"))),
        "status_pivot_lineitem": lambda: status_pivot(run_ledger(
            lineitem, opts("row_order")).clean).collect(),
        "run_metrics_lineitem": lambda: run_ledger(lineitem, opts("row_order")).metrics().collect(),
        "top_clients_lineitem": lambda: top_clients(run_ledger(
            lineitem, opts("row_order")).clean).collect(),
        "top_clients_dirty": lambda: top_clients(run_ledger(dirty, opts("row_id")).clean).collect(),
        "profile_orders": lambda: profile(table("orders"), opts("o_orderkey")).table().collect(),
        "universal_run_orders": lambda: sink(run_universal(table("orders"),
                                                           opts("o_orderkey")).clean),
        "universal_run_events": lambda: sink(run_universal(table("events"),
                                                           opts("event_id")).clean),
        "universal_run_documents": lambda: sink(run_universal(table("documents"),
                                                              opts("doc_id")).clean),
        "proper_names_part": lambda: sink(table("part").select(
            text.proper_name(F.col("p_name")).alias("n"))),
    }
    times = {}
    for name, fn in queries.items():
        fn()
        seconds = []
        for _ in range(RUNS):
            start = time.perf_counter()
            fn()
            seconds.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seconds), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR)}))
    spark.stop()


if __name__ == "__main__":
    main()
