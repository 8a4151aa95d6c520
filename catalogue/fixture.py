"""The dirty ledger derived from orders and customer, and access to the tables.

``LEDGER_RAW`` runs on Spark and on DuckDB as it stands; only the identifier
quote differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymark.operators.staging import FILE_ROWS, settle

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_ROWS = """
SELECT o_orderkey AS k, c_custkey AS c, substr(CAST(o_orderdate AS STRING), 1, 10) AS d,
       o_orderstatus AS s, o_orderpriority AS p, c_mktsegment AS seg, c_acctbal AS bal,
       CASE WHEN o_orderkey % 29 = 0 THEN 0.0
            WHEN o_orderkey % 31 = 0 THEN -o_totalprice ELSE o_totalprice END AS a
FROM orders JOIN customer ON o_custkey = c_custkey"""

_DIRTY = """
SELECT k * 10 AS row_id, k,
  CASE WHEN k % 41 = 0 THEN 'not a date'
       WHEN k % 13 = 0 THEN substr(d, 9, 2) || '-' || substr(d, 6, 2) || '-' || substr(d, 1, 4)
       ELSE replace(d, '-', '/') END AS "  Date ",
  CASE WHEN k % 17 = 0 THEN '    '
       ELSE '  ac - ' || CASE c % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'WEST' ELSE 'Hub' END
            || '_' || CAST(c AS STRING) || ' ' END AS "Client ID",
  CASE WHEN k % 23 = 0 THEN '' ELSE 'eft' || CAST(100000 + k AS STRING) END AS "Bank Ref",
  CASE k % 11 WHEN 0 THEN 'Paid' WHEN 1 THEN 'paid ' WHEN 2 THEN 'PENDING'
       WHEN 3 THEN 'in progress' WHEN 4 THEN 'overdue' WHEN 5 THEN 'Cancelled'
       WHEN 6 THEN 'past-due' WHEN 7 THEN 'Wholesale' WHEN 8 THEN '' WHEN 9 THEN 'N/A'
       ELSE s END AS "Status",
  CASE WHEN k % 43 = 0 THEN 'n.a.'
       WHEN k % 7 = 0 AND a > 0 THEN 'R ' || CAST(CAST(floor(a / 1000) AS BIGINT) AS STRING)
            || ' ' || lpad(CAST(CAST(floor(a) AS BIGINT) % 1000 AS STRING), 3, '0') || ','
            || lpad(CAST(CAST(floor(a * 100) AS BIGINT) % 100 AS STRING), 2, '0')
       WHEN k % 31 = 0 AND a < 0 THEN '(' || CAST(-a AS STRING) || ')'
       ELSE CAST(a AS STRING) END AS "Amount (ZAR)",
  CASE WHEN k % 5 = 0 THEN '' WHEN k % 19 = 0 THEN 'URGENT: customer query'
       ELSE 'standing  order' END AS "Remarks",
  CASE WHEN k % 47 = 0 THEN '12-34' WHEN k % 3 = 0 THEN ''
       ELSE '4' || lpad(CAST(c AS STRING), 9, '0') END AS "VAT No",
  CASE WHEN bal > 0 THEN CAST(CAST(floor(bal * 100) AS BIGINT) AS STRING) ELSE '' END
       AS "Credit Limit",
  CASE WHEN c % 8 = 0 THEN '' ELSE ' User' || CAST(c AS STRING) || '@Example.COM' END AS "E-mail",
  CASE c % 6 WHEN 0 THEN '' WHEN 1 THEN '27 82 ' || lpad(CAST(c AS STRING), 7, '0')
       ELSE '(082) ' || lpad(CAST(c AS STRING), 7, '0') END AS "Phone",
  'o''hara  ' || lower(seg) || ' pty ltd' AS "Client Name",
  CASE WHEN k % 37 = 1 THEN '12' ELSE lpad(CAST(c % 10000 AS STRING), 4, '0') END AS "Postcode",
  CASE WHEN k % 53 = 1 THEN 'Town' ELSE CAST(c AS STRING) || ' Main Road, ' || p END
       AS "Delivery Address",
  CASE c % 3 WHEN 0 THEN 'NORTH' WHEN 1 THEN 'WEST' ELSE 'HUB' END AS "Branch"
FROM source_rows"""

HEADERS = ("  Date ", "Client ID", "Bank Ref", "Status", "Amount (ZAR)", "Remarks", "VAT No",
           "Credit Limit", "E-mail", "Phone", "Client Name", "Postcode", "Delivery Address",
           "Branch")
_LIST = ", ".join(f'"{h}"' for h in HEADERS)
_EMPTY = ", ".join(f"'' AS \"{h}\"" for h in HEADERS)

# A copy of each 37th row follows it, an empty row each 53rd.
LEDGER_RAW = f"""
SELECT row_id, {_LIST} FROM dirty_rows
UNION ALL SELECT row_id + 1, {_LIST} FROM dirty_rows WHERE k % 37 = 0
UNION ALL SELECT row_id + 2, {_EMPTY} FROM dirty_rows WHERE k % 53 = 0"""

LEDGER_CTE = (f"source_rows AS ({_ROWS}), dirty_rows AS ({_DIRTY}), "
              f"ledger_raw AS ({LEDGER_RAW})")


_CELLS = ", ".join(f"CASE WHEN copy = 2 THEN '' ELSE \"{h}\" END AS \"{h}\"" for h in HEADERS)

# The same rows from one pass: each source row is laid out as itself, its copy and its empty row.
_ONE_PASS = f"""
WITH source_rows AS (SELECT *, explode(concat(array(0), if(k % 37 = 0, array(1), array()),
                                              if(k % 53 = 0, array(2), array()))) AS copy FROM spread_rows),
dirty_rows AS ({_DIRTY.replace("AS row_id, k,", "AS row_id, k, copy,", 1)})
SELECT row_id + copy AS row_id, {_CELLS} FROM dirty_rows"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STAGED: dict[tuple[str, str], DataFrame] = {}


def ledger_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty ledger, derived once per session and folder."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _STAGED:
        for name in ("orders", "customer"):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        rows = spark.sql(_ROWS)
        files = -(-table(spark, sf_dir, "orders").count() // FILE_ROWS)
        if files > 1:
            # Costly expressions over a table of few files would run in few tasks.
            rows = rows.repartition(files, "k", "c", "d", "a")
        rows.createOrReplaceTempView("spread_rows")
        _STAGED[at] = settle(spark.sql(_ONE_PASS.replace('"', "`"))).df
    return _STAGED[at]
