"""Source, sink and streaming queries: files written from the given tables,
read back by the operator under test."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tallymark.functions.text import quoted
from tallymark.operators import report
from tallymark.operators.staging import FILE_ROWS, discard, shared_folder
from tallymark.plans.ledger import run_ledger
from tallymark.sources import delimited, dirty, sinks
from tallymark.streaming.ingest import flag_stream, ingest_stream, ingested

from . import sqltext as q
from .fixture import HEADERS, LEDGER_CTE, LEDGER_RAW, ledger_raw, table
from .ledger import (OPTIONS, PUBLISHED, QUERIES, SQL, clean, flat, ledger_run,  # noqa: F401
                     ledger_sql, query)
from .universal import EVENTS, profile_sql, universal

STAMP = dt.datetime(2001, 8, 1, 12, 0, 0)


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/catalogue/{name}-{uuid.uuid4().hex}"


_NA = q.words(("#N/A", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", ""))
_csv_cells = ", ".join(f'CASE WHEN "{h}" NOT IN {_NA} THEN "{h}" END AS "{h}"' for h in HEADERS)


@query("csv_scan", f"WITH {LEDGER_CTE} SELECT CAST(row_id AS VARCHAR) AS row_id, {_csv_cells} "
                   "FROM ledger_raw")
def _(spark, sf):
    path = scratch(spark, "csv")
    (ledger_raw(spark, sf).write.option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path, header=True, sep=";"))
    return delimited.read_delimited(spark, path)


@query("export_roundtrip", ledger_sql(
    "SELECT " + PUBLISHED.split(", Flagged")[0] + " FROM judged"))
def _(spark, sf):
    path = scratch(spark, "clean")
    sinks.export_clean(ledger_run(spark, sf), path)
    return spark.read.parquet(path)


@query("report_export", ledger_sql("""SELECT 'cleaned_data' AS name, count(*) AS rows FROM judged
  UNION ALL SELECT 'flag_breakdown', count(DISTINCT f) FROM (SELECT unnest(flag_list) AS f
    FROM judged) u
  UNION ALL SELECT 'run_metrics', 1
  UNION ALL SELECT 'status_pivot', count(DISTINCT Status) + 1 FROM judged"""))
def _(spark, sf):
    places = sinks.export_report(ledger_run(spark, sf), scratch(spark, "report"))
    counts = [spark.read.parquet(p).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"))
              for n, p in places.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("report_export_universal", profile_sql(EVENTS, """
  SELECT 'cleaned_dataset' AS name, count(*) AS rows FROM base
  UNION ALL SELECT 'overview', 1 UNION ALL SELECT 'column_types', count(*) FROM types
  UNION ALL SELECT 'numeric_statistics', count(*) FROM types WHERE type = 'Numeric'
  UNION ALL SELECT 'categorical_statistics', count(*) FROM types
    WHERE type IN ('Categorical', 'Text / ID')
  UNION ALL SELECT 'datetime_coverage', count(*) FROM types WHERE type = 'Datetime'
  UNION ALL SELECT 'quality_audit', count(*) FROM findings"""))
def _(spark, sf):
    places = sinks.export_report(universal(spark, sf, EVENTS), scratch(spark, "report"))
    counts = [spark.read.parquet(p).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"))
              for n, p in places.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("report_export_pivot", SQL["pivot_grand_total"])
def _(spark, sf):
    places = sinks.export_report(ledger_run(spark, sf), scratch(spark, "report"))
    return spark.read.parquet(places["status_pivot"])


@query("report_export_breakdown", SQL["flag_breakdown"])
def _(spark, sf):
    places = sinks.export_report(ledger_run(spark, sf), scratch(spark, "report"))
    return spark.read.parquet(places["flag_breakdown"])


@query("report_export_rows", SQL["export_roundtrip"])
def _(spark, sf):
    places = sinks.export_report(ledger_run(spark, sf), scratch(spark, "report"))
    return spark.read.parquet(places["cleaned_data"])


@query("report_export_audit", SQL["audit_table_events"])
def _(spark, sf):
    places = sinks.export_report(universal(spark, sf, EVENTS), scratch(spark, "report"))
    return spark.read.parquet(places["quality_audit"])


def _history(spark, sf):
    path = scratch(spark, "history")
    sinks.append_history(ledger_run(spark, sf).settled(), path, "ledger_raw", 1.25, STAMP)
    sinks.append_history(universal(spark, sf, EVENTS), path, "events", 0.5,
                         STAMP + dt.timedelta(days=1))
    return sinks.read_history(spark, path)


_sales_row = f"""SELECT '2001-08-01 12:00:00' AS "Run", 'ledger_raw' AS "Source File",
  'Sales' AS "Mode", (SELECT count(*) FROM ledger_raw) AS "Rows In", count(*) AS "Rows Out",
  CAST(17 AS BIGINT) AS "Columns", count(*) FILTER (Flagged) AS "Flagged",
  round_even(count(*) FILTER (NOT Flagged) * 100.0 / count(*) * 10, 0) / 10 AS "Health %",
  {q.cents("sum(CASE WHEN Status <> 'CANCELLED' THEN Amount ELSE 0.0 END)")} AS "Numeric Total",
  CAST(1.25 AS DOUBLE) AS "Seconds" FROM judged"""
_events_row = profile_sql(EVENTS, """SELECT '2001-08-02 12:00:00' AS "Run",
  'events' AS "Source File", 'Universal' AS "Mode", count(*) AS "Rows In",
  count(*) AS "Rows Out", CAST(5 AS BIGINT) AS "Columns",
  count(*) FILTER (len(issues) > 0) AS "Flagged",
  round_even(count(*) FILTER (len(issues) = 0) * 100.0 / count(*) * 10, 0) / 10 AS "Health %",
  round_even((SELECT sum(total) FROM stats) * 100, 0) / 100 AS "Numeric Total",
  CAST(0.5 AS DOUBLE) AS "Seconds" FROM issues""")
_history_sql = f"SELECT * FROM ({ledger_sql(_sales_row)}) a UNION ALL SELECT * FROM ({_events_row}) b"


@query("history", _history_sql)
def _(spark, sf):
    return _history(spark, sf)


@query("history_metrics", f"""SELECT count(*) AS runs, CAST(sum("Rows Out") AS BIGINT)
  AS rows_processed, CAST(sum("Flagged") AS BIGINT) AS errors_caught,
  round_even(avg("Health %") * 10, 0) / 10 AS mean_health,
  {q.cents('avg("Seconds")')} AS mean_seconds FROM ({_history_sql}) h""")
def _(spark, sf):
    return report.history_metrics(_history(spark, sf))


@query("source_meta", "SELECT 'lineitem' AS name, count(*) AS rows, true AS sized, CAST(11 AS BIGINT) AS cols "
                      "FROM lineitem")
def _(spark, sf):
    meta = delimited.source_metadata(table(spark, sf, "lineitem"), "lineitem")
    size = sum(f["length"] for f in table(spark, sf, "lineitem").select(
        F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("length"))
        .distinct().collect())
    return meta.select("name", "rows", (F.col("size_bytes") == size).alias("sized"), "cols")


@query("file_row_order", "SELECT CAST(row_number() OVER () - 1 AS BIGINT) AS row, l_orderkey, "
                         "l_linenumber FROM lineitem")
def _(spark, sf):
    ordered = delimited.read_ordered(spark, f"{sf}/lineitem.parquet")
    return ordered.select("row_order.row", "l_orderkey", "l_linenumber")


_note = "o_orderstatus || chr(10) || '\"' || o_orderpriority || '\", ' || chr(10)"


#: Splits of numbered files at most, but for the last of each file: the driver holds something of every task.
SPLITS = 1000


def split_bytes(spark, path: str, least: int = 64 << 10) -> int:
    """The size of a split: ``least``, until the folder's files would have more than SPLITS of them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return max(least, -(-whole // SPLITS))


@query("csv_line_numbers", f"""SELECT CAST(o_orderkey AS VARCHAR) AS number, {_note} AS note,
  CAST(o_orderkey % 3 AS VARCHAR) AS file,
  row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) - 1 AS row FROM orders""")
def _(spark, sf):
    """Files with line breaks in quotes, read in many splits each."""
    path, out = scratch(spark, "numbered"), scratch(spark, "staged")
    orders = table(spark, sf, "orders").selectExpr("o_orderkey AS number", f"{_note} AS note".replace('\'"', "'\\\""))
    for m in range(3):
        (orders.filter(f"number % 3 = {m}").coalesce(1).sortWithinPartitions("number")
         .write.option("escape", '"').option("ignoreTrailingWhiteSpace", False).option("lineSep", "\n")
         .csv(f"{path}/m{m}", header=True))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes(spark, path)))
    try:
        rows = delimited.stage_delimited(spark, f"{path}/*", out, sep=",", encoding="UTF-8",
                                         multiline=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    return rows.select("number", "note", F.regexp_extract("row_order.file", "/m(.)/", 1).alias("file"),
                       "row_order.row")


# The generator's dirt rules over the orders, so that its size follows the data.
_branches = "['NORTH', 'SOUTH', 'EAST', 'WEST', 'HUB'][i % 5 + 1]"
_dirty_sql = f"""
WITH base AS (SELECT o_orderkey AS i, day(o_orderdate) AS d, o_totalprice AS a,
  o_custkey AS c, o_orderkey % 10 AS s, 100000 + o_orderkey AS ref FROM orders),
amounts AS (SELECT *, CASE WHEN i % 31 = 0 THEN -abs(CASE WHEN i % 29 = 0 THEN 0.0 ELSE a END)
  WHEN i % 29 = 0 THEN 0.0 ELSE a END AS m FROM base),
rows_ AS (SELECT i, i * 10 AS row_id,
  CASE WHEN i % 41 = 0 THEN 'not a date'
       WHEN i % 13 = 0 THEN lpad(CAST(d AS VARCHAR), 2, '0') || '-09-2025'
       ELSE '2025/09/' || lpad(CAST(d AS VARCHAR), 2, '0') END AS "  Date ",
  '  ' || CASE WHEN i % 17 = 0 THEN '' ELSE 'AC-' || {_branches} || '-' || c END || '  '
    AS "Client ID",
  CASE WHEN i % 23 = 0 THEN '' ELSE 'EFT' || ref END AS "Bank Ref",
  ['received', ' Closed', 'OPEN', 'awaiting', 'Arrears', 'voided', 'Cleared ', 'outstanding', '',
   'past-due'][s + 1] AS "Status",
  CASE WHEN i % 7 = 0 THEN 'R ' || format('{{:,.2f}}', m) ELSE CAST(m AS VARCHAR) END
    AS "Amount (ZAR)",
  CASE WHEN i % 5 = 0 THEN '' ELSE 'standing order' END AS "Remarks",
  {_branches} AS "Branch" FROM amounts)
SELECT * EXCLUDE (i) FROM rows_
UNION ALL SELECT * EXCLUDE (i) REPLACE (row_id + 1 AS row_id) FROM rows_ WHERE i % 37 = 0
UNION ALL SELECT row_id + 2, '', '', '', '', '', '', '' FROM rows_ WHERE i % 53 = 0"""


@query("dirty_ledger", _dirty_sql)
def _(spark, sf):
    base = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("i"), F.dayofmonth("o_orderdate").alias("day"),
        F.col("o_totalprice").alias("amount"), F.col("o_custkey").alias("client"),
        (F.col("o_orderkey") % 10).alias("status_no"), (F.col("o_orderkey") + 100000).alias("ref"))
    return dirty.make_dirty(base)


# --- streaming ---------------------------------------------------------------
def write_drops(rows, part, parts: int, path: str) -> int:
    """Each part of the rows (``part`` numbers them) as a drop of files in one folder, one drop after the other;
    returns the files of a drop. Each has as many, so that ``maxFilesPerTrigger`` takes whole drops, and no
    task writes or reads a whole drop."""
    counts = dict(rows.groupBy(part.cast("int").alias("part")).count().collect())
    files = max(1, max(counts.values(), default=0) // FILE_ROWS)
    # Where a drop has too few rows for its share of files, every drop is one file.
    files = files if all(counts.get(i, 0) >= FILE_ROWS // 10 * files for i in range(parts)) else 1
    for i in range(parts):
        drop = rows.filter(part == i)
        (drop.repartition(files) if files > 1 else drop.coalesce(1)).write.mode("append").parquet(path)
    found = len(rows.sparkSession.read.schema(rows.schema).parquet(path).inputFiles())
    if files > 1 and found != files * parts:
        raise ValueError(f"{parts} drops of {files} files each were written as {found} files")
    return files


def _drop(spark, sf) -> tuple[str, object, int]:
    """The dirty ledger as a folder of files, as they would arrive: one drop after
    the other, in the order of their keys; and the files of a drop."""
    path = scratch(spark, "drop")
    rows = ledger_raw(spark, sf)
    last = rows.agg(F.max("row_id")).first()[0]
    files = write_drops(rows, F.floor(F.col("row_id") * 4 / (last + 1)), 4, path)
    return path, rows.schema, files


@query("stream_ingest", ledger_sql("""SELECT row_id, Date, Client_ID, Status, Amount, flags
  FROM judged"""))
def _(spark, sf):
    """One drop a batch: what compares rows is judged over all batches."""
    path, schema, files = _drop(spark, sf)
    out = scratch(spark, "ingest")
    ingest_stream(spark, path, schema, out, scratch(spark, "progress"), OPTIONS,
                  maxFilesPerTrigger=files).awaitTermination()
    rows, _ = ingested(spark, out, OPTIONS)
    return flat(rows).select("row_id", "Date", "Client_ID", "Status", "Amount", "flags")


_again = 1_000_000_000
_list = ", ".join(f'"{h}"' for h in HEADERS)


@query("stream_restarting_keys", ledger_sql(f"""SELECT row_id // {_again} AS batch, row_id % {_again} AS row_id,
  Date, Client_ID, Status, Amount, flags FROM judged""").replace(
      f"ledger_raw AS ({LEDGER_RAW})", f"""once AS ({LEDGER_RAW}), ledger_raw AS (SELECT * FROM once
      UNION ALL SELECT row_id + {_again}, {_list} FROM once)"""))
def _(spark, sf):
    """Two drops of the same rows under the same keys: the second is all copies."""
    path, out, mark = (scratch(spark, n) for n in ("drop", "ingest", "progress"))
    rows = ledger_raw(spark, sf)
    for _ in range(2):
        rows.write.mode("append").parquet(path)
        ingest_stream(spark, path, rows.schema, out, mark, OPTIONS).awaitTermination()
        discard(spark, [path])      # its rows are stored
    return flat(ingested(spark, out, OPTIONS).clean).select(
        "batch", "row_id", "Date", "Client_ID", "Status", "Amount", "flags")


@query("stream_history", ledger_sql("""SELECT 'Sales' AS "Mode", (SELECT count(*) FROM ledger_raw)
  AS "Rows In", count(*) AS "Rows Out", count(*) FILTER (Flagged) AS "Flagged" FROM judged"""))
def _(spark, sf):
    path, schema, _ = _drop(spark, sf)
    out = scratch(spark, "ingest")
    ingest_stream(spark, path, schema, out, scratch(spark, "progress"),
                  OPTIONS).awaitTermination()
    return ingested(spark, out, OPTIONS).history.select("Mode", "Rows In", "Rows Out", "Flagged")


_cross = ("DUPLICATE ENTRY", "CREDIT LIMIT BREACH", "SAME-DAY DUPLICATE")


@query("stream_flags", ledger_sql(f"""SELECT row_id, array_to_string(list_filter(flag_list,
  lambda x: x NOT IN {q.words(_cross)}), '|') AS flags FROM judged"""))
def _(spark, sf):
    """Row-local rules directly on a stream, written to a file sink."""
    path, schema, _ = _drop(spark, sf)
    out = scratch(spark, "flags")
    stream = spark.readStream.schema(schema).parquet(path)
    (flag_stream(stream, OPTIONS).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True)
     .start().awaitTermination())
    return flat(spark.read.parquet(out)).select("row_id", "flags")
