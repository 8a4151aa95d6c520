"""Exports and the run history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.ledger import LedgerRun

HISTORY = ("Run", "Source File", "Mode", "Rows In", "Rows Out", "Columns", "Flagged", "Health %",
           "Numeric Total", "Seconds")


def export_clean(run, path: str, fmt: str = "parquet", **options) -> None:
    """The clean table without helper columns."""
    run.display.write.format(fmt).mode("overwrite").options(**options).save(path)


def report_tables(run) -> dict[str, DataFrame]:
    """The workbook's sheets as named tables."""
    if isinstance(run, LedgerRun):
        sums = run.summary()
        return {"cleaned_data": run.display, "status_pivot": sums.status_pivot(True),
                "run_metrics": run.metrics(), "flag_breakdown": sums.flag_breakdown()}
    p = run.profile
    return {"cleaned_dataset": run.display, "overview": run.metrics(), "column_types": p.table(),
            "numeric_statistics": p.numeric(), "categorical_statistics": p.categorical(),
            "datetime_coverage": p.datetime(), "quality_audit": run.audit.findings}


def export_report(run, path: str) -> dict[str, str]:
    """Write every report table to ``<path>/<table>``; returns where. The rows
    are cleaned once: the other tables read what that wrote."""
    run = run.settled()
    places = {}
    for name, df in report_tables(run).items():
        places[name] = f"{path.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(places[name])
    return places


def history_row(run, source: str, seconds: float = 0.0,
                at: dt.datetime | None = None) -> DataFrame:
    """One row about a run."""
    stamp = (at or dt.datetime.now()).strftime("%Y-%m-%d %H:%M:%S")
    tenth = F.rint(F.col("health") * 10) / 10
    total = F.rint(F.col("numeric_total") * 100) / 100
    return run.metrics().select(
        F.lit(stamp).alias("Run"), F.lit(source).alias("Source File"),
        F.initcap("mode").alias("Mode"), F.col("rows_in").alias("Rows In"),
        F.col("rows_out").alias("Rows Out"), F.col("columns").alias("Columns"),
        F.col("flagged").alias("Flagged"), tenth.alias("Health %"),
        total.alias("Numeric Total"), F.lit(round(float(seconds), 2)).alias("Seconds"))


def append_history(run, path: str, source: str, seconds: float = 0.0,
                   at: dt.datetime | None = None) -> None:
    row = history_row(run, source, seconds, at).withColumn("run_date", F.to_date("Run"))
    row.write.mode("append").partitionBy("run_date").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Newest run first."""
    return spark.read.parquet(path).select(*HISTORY).orderBy(F.desc("Run"))


def export_history(spark: SparkSession, path: str, out: str) -> None:
    read_history(spark, path).write.mode("overwrite").csv(out, header=True)
