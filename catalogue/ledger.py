"""Ledger queries: each operator over the whole dirty ledger, orders or
lineitem, with the equivalent SQL."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.constants import CANONICAL, CRITICAL_FLAGS, FLAG_ORDER, KNOWN_FLAGS, RULES, Options
from tallymark.functions import dates, numbers, text
from tallymark.functions.text import quoted
from tallymark.operators import explore, report, rules
from tallymark.operators.schema import map_columns, route_table, schema_report
from tallymark.plans.ledger import LedgerRun, not_blank, run_ledger, scrub
from tallymark.plans.router import run
from tallymark.session import tune

from . import sqltext as q
from .fixture import HEADERS, LEDGER_CTE, TABLES, ledger_raw, table

# Options under which every rule finds something in the dirty ledger.
AS_OF = dt.date(2000, 6, 30)
OPTIONS = Options(order_by="row_id", as_of=AS_OF, min_amount=50000.0,
                  blacklist="ac-north-330; AC-WEST-769,\n AC-HUB-605 ,")
DROPPING = Options(order_by="row_id", as_of=AS_OF, drop_duplicates=True)

MAPPING = {"Date": "  Date ", "Client_ID": "Client ID", "Reference": "Bank Ref",
           "Status": "Status", "Amount": "Amount (ZAR)", "Notes": "Remarks",
           "VAT_Number": "VAT No", "Credit_Limit": "Credit Limit", "Email": "E-mail",
           "Phone": "Phone", "Company": "Client Name", "Postal_Code": "Postcode",
           "Address": "Delivery Address", "EXTRA_Branch": "Branch"}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_RUNS: dict[tuple, LedgerRun] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def call(spark, sf_dir):
            local = spark.sparkContext.master.startswith("local[")
            tune(spark, "/tmp/checkpoints" if local and not spark.sparkContext.getCheckpointDir()
                 else None).conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        QUERIES[name] = call
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def ledger_run(spark, sf_dir, options=OPTIONS) -> LedgerRun:
    """One planned run per session, folder and options."""
    at = (spark.sparkContext.applicationId, sf_dir, repr(options))
    if at not in _RUNS:
        _RUNS[at] = run_ledger(ledger_raw(spark, sf_dir), options)
    return _RUNS[at]


def clean(spark, sf_dir) -> DataFrame:
    return ledger_run(spark, sf_dir).clean


# --- the same run as SQL -----------------------------------------------------
def _d(days: int = 0) -> str:
    return f"DATE '{AS_OF + dt.timedelta(days=days)}'"


def ledger_sql(final: str, drop: bool = False) -> str:
    """``final`` may read ledger_raw, mapped, scrubbed, filled, repaired, judged."""
    mapped = ", ".join(f'"{h}" AS {c}' for c, h in MAPPING.items())
    scrubbed = ", ".join(f"{q.clean(c)} AS {c}" if c != "Amount" else c for c in MAPPING)
    filled = " AND ".join(q.blank(c) for c in ["Amount", *[c for c in MAPPING if c != "Amount"]])
    o = OPTIONS
    blocked = q.words(o.blocked_ids())
    vat = "regexp_replace(VAT_Number, '[\\s\\-]', '', 'g')"
    post = "regexp_replace(Postal_Code, '\\s', '', 'g')"
    conditions = {
        "INVALID DATE": "_date IS NULL", "MISSING ID": "coalesce(Client_ID, '') = ''",
        "UNASSIGNED": "_status_blank", "INVALID AMOUNT": "_amount IS NULL",
        "NEGATIVE AMOUNT": "Amount < 0", "ZERO AMOUNT": "Amount = 0",
        "BELOW THRESHOLD": None if drop else f"Amount > 0 AND Amount < {o.min_amount}",
        "RECON MISMATCH": "Status = 'PAID' AND Amount <= 0",
        "DUPLICATE ENTRY": None if drop else "_copy > 1",
        "INVALID VAT NUMBER": f"coalesce({vat}, '') <> '' "
                              f"AND NOT regexp_matches({vat}, '^\\d{{9,15}}$')",
        "APPROVAL REQUIRED": "Amount > 250000",
        "CREDIT LIMIT BREACH": "_limit > 0 AND _exposure > _limit",
        "SAME-DAY DUPLICATE": "_day_copy > 1",
        "NO CONTACT DETAILS": "coalesce(Email, '') = '' AND coalesce(Phone, '') = ''",
        "RESTRICTED ENTITY": None if drop else f"Client_ID IN {blocked}",
        "INCOMPLETE ADDRESS": f"NOT coalesce(regexp_matches({post}, '^\\d{{4,10}}$'), false) "
                              "OR length(trim(coalesce(Address, ''))) < 8",
        "FUTURE DATE": f"_date > {_d()}", "STALE DATE": f"_date < {_d(-1095)}",
    }
    slots = ", ".join(f"CASE WHEN {c} THEN '{label}' END" for label, c in conditions.items() if c)
    keep = "WHERE _copy = 1" if drop else ""
    plain = [c for c in MAPPING if c not in ("Date", "Client_ID", "Reference", "Status", "Amount",
                                             "Notes", "Email", "Phone", "Company")]
    return f"""
WITH {LEDGER_CTE},
mapped AS (SELECT row_id, {mapped} FROM ledger_raw),
scrubbed AS (SELECT row_id, {scrubbed} FROM mapped),
filled AS (SELECT * FROM scrubbed WHERE NOT ({filled})),
parsed AS (SELECT *, {q.date('Date')} AS _date, {q.amount('Amount')} AS _amount,
  {q.amount('Credit_Limit')} AS _limit FROM filled),
repaired AS (SELECT row_id, _date, _amount, _limit, Status AS _status, Email AS _email,
  Phone AS _phone, Company AS _company, Notes AS _source_notes,
  coalesce({q.strip('Status')}, '') = '' AS _status_blank,
  strftime(_date, '%Y-%m-%d') AS Date, {q.client('Client_ID')} AS Client_ID,
  {q.strip('upper(Reference)')} AS Reference, {q.status('Status')} AS Status,
  {q.cents('coalesce(_amount, 0.0)')} AS Amount, coalesce(Notes, '') AS Notes,
  {q.email('Email')} AS Email, {q.phone('Phone')} AS Phone, {q.proper('Company')} AS Company,
  {", ".join(plain)} FROM parsed),
taxed AS (SELECT *, {q.cents('Amount * 0.15')} AS VAT_15 FROM repaired),
totalled AS (SELECT *, {q.cents('Amount + VAT_15')} AS Total_Inc_VAT,
  CASE WHEN coalesce(Reference, '') = '' THEN 'Unreconciled' ELSE 'Reconciled' END
    AS Recon_Status,
  row_number() OVER (PARTITION BY Date, Client_ID, Amount, Reference ORDER BY row_id) AS _copy
  FROM taxed),
kept AS (SELECT * FROM totalled {keep}),
grouped AS (SELECT *,
  {q.cents("sum(Amount) OVER (PARTITION BY coalesce(Client_ID, ''))")} AS _exposure,
  row_number() OVER (PARTITION BY _date, coalesce(Client_ID, ''), Amount ORDER BY row_id)
    AS _day_copy FROM kept),
flagged AS (SELECT *, list_filter([{slots}], lambda x: x IS NOT NULL) AS flags FROM grouped),
judged AS (SELECT row_id, coalesce(Date, '') AS Date, coalesce(Client_ID, '') AS Client_ID,
  coalesce(Reference, '') AS Reference, Recon_Status, Status, Amount, VAT_15, Total_Inc_VAT,
  concat_ws(' | ', CASE WHEN len(flags) > 0 THEN array_to_string(flags, ' | ') END,
            CASE WHEN Notes <> '' THEN Notes END) AS Notes,
  VAT_Number, Credit_Limit, Email, Phone, Company, Postal_Code, Address, EXTRA_Branch,
  len(flags) > 0 AS Flagged, CAST(len(flags) AS INTEGER) AS Flag_Count,
  {q.review('Status', 'Notes')} AS Needs_Review,
  list_has_any(flags, [{", ".join(f"'{f}'" for f in CRITICAL_FLAGS)}]) AS Blocked,
  flags AS flag_list, array_to_string(flags, '|') AS flags, Notes AS _source_notes, _date, _amount, _status,
  _status_blank, _email, _phone, _company, _limit
  FROM flagged)
{final}"""


PUBLISHED = ("Date, Client_ID, Reference, Recon_Status, Status, Amount, VAT_15, Total_Inc_VAT, "
             "Notes, VAT_Number, Credit_Limit, Email, Phone, Company, Postal_Code, Address, "
             "EXTRA_Branch, Flagged, Flag_Count, Needs_Review, Blocked, flags, row_id")


def flat(df: DataFrame) -> DataFrame:
    """Label arrays as text, so both engines compare the same values."""
    return df.withColumn("flags", F.array_join("flags", "|"))


# --- headers and routing -----------------------------------------------------
@query("ledger_map_columns", ledger_sql("SELECT * FROM mapped"))
def _(spark, sf):
    return map_columns(ledger_raw(spark, sf), None, "row_id").df


_filled = {c: f"SELECT count(*) FROM mapped WHERE NOT {q.blank(c)}" for c in MAPPING}


@query("schema_report", ledger_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS \"Canonical Column\", '{MAPPING[c]}' AS \"Source Header\", "
    f"'{'Extra' if c.startswith('EXTRA') else 'Mapped'}' AS \"Status\", ({_filled[c]}) AS \"Filled\""
    for c in [*CANONICAL, "EXTRA_Branch"])))
def _(spark, sf):
    return schema_report(ledger_raw(spark, sf), None, "row_id")


# table -> (mode, mapped headers), read off the header rules
ROUTES = {"region": ("universal", 0), "nation": ("universal", 0), "customer": ("universal", 1),
          "supplier": ("universal", 0), "part": ("universal", 2), "orders": ("sales", 3),
          "lineitem": ("sales", 3), "events": ("universal", 2), "documents": ("universal", 0),
          "embeddings": ("universal", 0), "pages": ("universal", 0),
          "benchmark": ("universal", 0), "labels": ("universal", 0),
          "conversations": ("universal", 0)}


@query("route_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{m}' AS mode, CAST({n} AS BIGINT) AS mapped, "
    f"count(*) AS rows FROM {t}" for t, (m, n) in ROUTES.items()))
def _(spark, sf):
    parts = [route_table(t, table(spark, sf, t)) for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- cleaning ----------------------------------------------------------------
def mapped(spark, sf):
    return map_columns(ledger_raw(spark, sf), None, "row_id")


@query("clean_text", ledger_sql("SELECT * FROM scrubbed"))
def _(spark, sf):
    return scrub(mapped(spark, sf).df, OPTIONS)


@query("blank_rows", ledger_sql("SELECT row_id FROM filled"))
def _(spark, sf):
    return not_blank(mapped(spark, sf).df, OPTIONS).select("row_id")


@query("blank_test", ledger_sql(
    "SELECT row_id, " + ", ".join(f"{q.blank(c)} AS {c}" for c in MAPPING) + " FROM mapped"))
def _(spark, sf):
    df = mapped(spark, sf).df
    return df.select("row_id", *[text.is_blank(F.col(c)).alias(c) for c in MAPPING])


@query("parse_dates", ledger_sql("SELECT row_id, CAST(_date AS VARCHAR) AS parsed FROM parsed"))
def _(spark, sf):
    df = ledger_run(spark, sf).filled
    parsed = dates.parse_date(F.col("Date"), dayfirst=True, this_year=AS_OF.year)
    return df.select("row_id", parsed.cast("string").alias("parsed"))


@query("date_standardise", ledger_sql(
    "SELECT row_id, coalesce(strftime(_date, '%Y-%m-%d'), '') AS Date FROM parsed"))
def _(spark, sf):
    return clean(spark, sf).select("row_id", "Date")


@query("parse_amount", ledger_sql("SELECT row_id, _amount AS amount FROM parsed"))
def _(spark, sf):
    df = ledger_run(spark, sf).filled
    return df.select("row_id", numbers.parse_amount(F.col("Amount")).alias("amount"))


@query("amount_finalise", ledger_sql("SELECT row_id, Amount FROM repaired"))
def _(spark, sf):
    return clean(spark, sf).select("row_id", "Amount")


@query("vat", f"""SELECT l_orderkey, l_linenumber, l_extendedprice AS amount, vat,
  {q.cents('l_extendedprice + vat')} AS total FROM (SELECT *,
  {q.cents(q.cents('l_extendedprice') + ' * 0.15')} AS vat FROM lineitem) t""")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    amount = numbers.cents(numbers.parse_amount(F.col("l_extendedprice"),
                                                df.schema["l_extendedprice"].dataType))
    taxed = df.select("l_orderkey", "l_linenumber", amount.alias("amount"),
                      numbers.cents(amount * 0.15).alias("vat"))
    return taxed.withColumn("total", numbers.cents(F.col("amount") + F.col("vat")))


@query("client_ref_normalise", ledger_sql("SELECT row_id, Client_ID, Reference FROM judged"))
def _(spark, sf):
    return clean(spark, sf).select("row_id", "Client_ID", "Reference")


@query("status_fold", ledger_sql("SELECT row_id, _status, Status FROM repaired"))
def _(spark, sf):
    return ledger_run(spark, sf).work.select("row_id", "_status", "Status")


@query("status_fold_orders", f"""SELECT o_orderstatus AS raw, {q.status('o_orderstatus')} AS status,
  count(*) AS n FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    raw = F.col("o_orderstatus")
    return (table(spark, sf, "orders").groupBy(raw.alias("raw"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("raw", text.status(F.col("raw")).alias("status"), "n"))


@query("contact_normalise", ledger_sql("SELECT row_id, Email, Phone FROM repaired"))
def _(spark, sf):
    return clean(spark, sf).select("row_id", "Email", "Phone")


@query("proper_case", ledger_sql("SELECT row_id, Company FROM repaired"))
def _(spark, sf):
    return clean(spark, sf).select("row_id", "Company")


@query("proper_case_parts", f"SELECT p_partkey, {q.proper('p_name')} AS name, "
                            f"{q.proper('p_type')} AS kind FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.proper_name(F.col("p_name")).alias("name"),
                                           text.proper_name(F.col("p_type")).alias("kind"))


_gated = ("Date", "Client_ID", "Amount", "VAT_Number", "Credit_Limit", "Phone", "Postal_Code")


@query("numeric_gate", ledger_sql("SELECT row_id, " + ", ".join(
    f"coalesce({q.gate(c)}, false) AS {c}" for c in _gated) + " FROM filled"))
def _(spark, sf):
    df = ledger_run(spark, sf).filled
    return df.select("row_id", *[numbers.looks_numeric(F.col(c)).alias(c) for c in _gated])


@query("money_text", ledger_sql(
    "SELECT row_id, 'R ' || format('{:,.2f}', Total_Inc_VAT) AS shown FROM judged"))
def _(spark, sf):
    return clean(spark, sf).select("row_id", numbers.money_text(F.col("Total_Inc_VAT"), "R", 2)
                                   .alias("shown"))


# --- verdicts ----------------------------------------------------------------
@query("compose_notes", ledger_sql("SELECT row_id, Notes FROM judged"))
def _(spark, sf):
    return clean(spark, sf).select("row_id", "Notes")


@query("row_verdicts", ledger_sql("SELECT row_id, Flagged, Flag_Count, Blocked FROM judged"))
def _(spark, sf):
    return clean(spark, sf).select("row_id", "Flagged", "Flag_Count", "Blocked")


@query("needs_review", ledger_sql("SELECT row_id, Needs_Review FROM judged"))
def _(spark, sf):
    return clean(spark, sf).select("row_id", "Needs_Review")


@query("highlight", ledger_sql("SELECT row_id, Flagged OR Needs_Review AS lit FROM judged"))
def _(spark, sf):
    df = clean(spark, sf)
    return df.select("row_id", explore.highlight(df).alias("lit"))


_known = q.words(KNOWN_FLAGS)


@query("note_tokens", ledger_sql(f"""
SELECT row_id, coalesce(string_agg(t, '|' ORDER BY i) FILTER (t IN {_known}), '') AS known,
  coalesce(string_agg(t, '|' ORDER BY i) FILTER (t NOT IN {_known}), '') AS free FROM (
  SELECT row_id, t, min(i) AS i FROM (
    SELECT row_id, trim(unnest(string_split(Notes, '|'))) AS t,
           generate_subscripts(string_split(Notes, '|'), 1) AS i FROM judged) s
  GROUP BY row_id, t) u GROUP BY row_id"""))
def _(spark, sf):
    shown = explore.note_view(clean(spark, sf))
    return shown.select("row_id", F.array_join("Known_Flags", "|").alias("known"),
                        F.array_join("Free_Text", "|").alias("free"))


@query("row_badges", ledger_sql(f"""SELECT row_id,
  CASE WHEN Flagged THEN 'FLAGGED' WHEN Needs_Review THEN 'NEEDS REVIEW' ELSE 'CLEAN' END
    AS Badge,
  CASE WHEN {q.review('Status')} THEN 'REVIEW'
       WHEN Status IN ('PAID', 'PENDING', 'OVERDUE', 'CANCELLED', 'UNASSIGNED') THEN Status
       ELSE 'CUSTOM' END AS Status_Badge FROM judged"""))
def _(spark, sf):
    return explore.note_view(clean(spark, sf)).select("row_id", "Badge", "Status_Badge")


# --- one query per flag ------------------------------------------------------
def _flag_query(label: str) -> None:
    name = "flag_" + label.lower().replace(" ", "_").replace("-", "_")

    @query(name, ledger_sql("SELECT row_id, Date, Client_ID, Amount FROM judged "
                            f"WHERE list_contains(flag_list, '{label}')"))
    def _(spark, sf):
        return (clean(spark, sf).filter(F.array_contains("flags", label))
                .select("row_id", "Date", "Client_ID", "Amount"))


for _label in FLAG_ORDER:
    _flag_query(_label)


@query("flag_restricted_table", ledger_sql("""SELECT row_id, Client_ID FROM judged
  WHERE Client_ID IN (SELECT 'AC-' || CASE c_custkey % 3 WHEN 0 THEN 'NORTH' WHEN 1 THEN 'WEST'
    ELSE 'HUB' END || '-' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0)"""))
def _(spark, sf):
    place = (F.when(F.col("c_custkey") % 3 == 0, "north").when(F.col("c_custkey") % 3 == 1, "west")
             .otherwise("hub"))
    listed = table(spark, sf, "customer").filter("c_acctbal < 0").select(
        F.concat(F.lit(" ac-"), place, F.lit("-"), F.col("c_custkey").cast("string")).alias("id"))
    blanks = spark.createDataFrame([(" ",), (None,)], "id string")
    listing = dataclasses.replace(OPTIONS, blacklist="", blocklist=listed.union(blanks))
    found = run_ledger(ledger_raw(spark, sf), listing).clean
    return (found.filter(F.array_contains("flags", "RESTRICTED ENTITY") & F.col("Blocked"))
            .select("row_id", "Client_ID"))


_SHAPES = ("date_format(d, 'dd/MM/yyyy hh:mm a')", "date_format(d, 'yyyy-MM-dd') || ' 10:00 AM'",
           "date_format(d, 'E d MMM yyyy')", "date_format(d, 'd') || 'th ' || date_format(d, 'MMM yyyy')",
           "date_format(d, 'yyyy-MM-dd') || 'T10:00:00Z'", "date_format(d, 'MMMM d, yyyy')",
           "date_format(d, 'd-MMM-yy')", "date_format(d, 'yyyy/MM/dd')")


@query("parse_date_shapes", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed FROM orders")
def _(spark, sf):
    cases = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_SHAPES))
    written = table(spark, sf, "orders").selectExpr("o_orderkey", "CAST(o_orderdate AS TIMESTAMP) AS d")
    written = written.selectExpr("o_orderkey", f"CASE o_orderkey % {len(_SHAPES)} {cases} END AS t")
    parsed = dates.parse_date(F.col("t"), this_year=AS_OF.year)
    return written.select("o_orderkey", parsed.cast("string").alias("parsed"))


@query("recon_status", ledger_sql("SELECT row_id, Recon_Status FROM judged"))
def _(spark, sf):
    return clean(spark, sf).select("row_id", "Recon_Status")


@query("dup_drop", ledger_sql(f"SELECT {PUBLISHED} FROM judged", drop=True))
def _(spark, sf):
    return flat(ledger_run(spark, sf, DROPPING).clean)


@query("ledger_run", ledger_sql(f"SELECT {PUBLISHED} FROM judged"))
def _(spark, sf):
    return flat(clean(spark, sf))


# --- reports -----------------------------------------------------------------
_money = "sum(CASE WHEN Status <> 'CANCELLED' THEN {} ELSE 0.0 END)"


@query("revenue_totals", ledger_sql("SELECT " + ", ".join(
    f"{q.cents(_money.format(c))} AS {n}" for c, n in
    (("Amount", "revenue"), ("VAT_15", "vat_total"), ("Total_Inc_VAT", "inc_vat_total")))
    + " FROM judged"))
def _(spark, sf):
    return report.revenue_totals(clean(spark, sf))


_pivot = f"""SELECT Status, count(*) AS Transactions, {q.cents('sum(Amount)')} AS Revenue_Excl_VAT,
  {q.cents('sum(VAT_15)')} AS VAT_15, {q.cents('sum(Total_Inc_VAT)')} AS Total_Inc_VAT,
  count(*) FILTER (Flagged) AS Flagged_Rows FROM judged GROUP BY Status"""


@query("status_pivot", ledger_sql(_pivot))
def _(spark, sf):
    return report.status_pivot(clean(spark, sf))


@query("pivot_grand_total", ledger_sql(f"""SELECT * FROM ({_pivot}) p UNION ALL
  SELECT 'GRAND TOTAL', CAST(sum(Transactions) AS BIGINT), {q.cents('sum(Revenue_Excl_VAT)')},
  {q.cents('sum(VAT_15)')}, {q.cents('sum(Total_Inc_VAT)')}, CAST(sum(Flagged_Rows) AS BIGINT)
  FROM ({_pivot}) p"""))
def _(spark, sf):
    return report.status_pivot(clean(spark, sf), total=True)


_sums = "count(*) AS n, " + ", ".join(
    f"{q.cents(f'coalesce(sum({c}), 0)')} AS {m}" for m, c in
    (("amount", "Amount"), ("vat", "VAT_15"), ("inc", "Total_Inc_VAT"))
) + ", count(*) FILTER (Flagged) AS flagged"


@query("report_summary", ledger_sql(" UNION ALL ".join(
    f"""SELECT '{group}' AS "group", {c} AS key, {_sums} FROM judged GROUP BY {c}"""
    for group, c in (("status", "Status"), ("client", "Client_ID"), ("date", "Date")))
    + f""" UNION ALL SELECT 'flag', f, {_sums} FROM (SELECT unnest(flag_list) AS f, Amount, VAT_15,
  Total_Inc_VAT, Flagged FROM judged) x GROUP BY f"""))
def _(spark, sf):
    return ledger_run(spark, sf).summary().table()


_orders = Options(order_by="o_orderkey", as_of=AS_OF)


def orders_run(spark, sf) -> LedgerRun:
    return run_ledger(table(spark, sf, "orders"), _orders)


_orders_sql = f"""
WITH amounts AS (SELECT *, {q.cents('o_totalprice')} AS Amount,
  CAST(o_orderdate AS DATE) AS d, {q.status('o_orderstatus')} AS Status FROM orders),
taxed AS (SELECT *, {q.cents('Amount * 0.15')} AS VAT_15 FROM amounts),
judged AS (SELECT *, {q.cents('Amount + VAT_15')} AS Total_Inc_VAT,
  row_number() OVER (PARTITION BY d, Amount ORDER BY o_orderkey) AS rn FROM taxed)
SELECT Status, count(*) AS Transactions, {q.cents('sum(Amount)')} AS Revenue_Excl_VAT,
  {q.cents('sum(VAT_15)')} AS VAT_15, {q.cents('sum(Total_Inc_VAT)')} AS Total_Inc_VAT,
  count(*) FILTER (WHERE true) AS Flagged_Rows FROM judged GROUP BY Status"""


@query("status_pivot_orders", _orders_sql)
def _(spark, sf):
    """Orders carry no client, so every row is flagged MISSING ID."""
    return report.status_pivot(orders_run(spark, sf).clean)


@query("flag_breakdown", ledger_sql('SELECT unnest(flag_list) AS "Exception", count(*) AS "Rows" '
                                    "FROM judged GROUP BY 1"))
def _(spark, sf):
    return ledger_run(spark, sf).breakdown()


@query("breakdown_share", ledger_sql(
    'SELECT "Exception", "Rows", round_even("Rows" * 1000.0 / (SELECT count(*) FROM judged), 0) '
    '/ 10 AS "% of File" FROM (SELECT unnest(flag_list) AS "Exception", count(*) AS "Rows" '
    "FROM judged GROUP BY 1) b"))
def _(spark, sf):
    return report.breakdown_share(clean(spark, sf))


_cells = " + ".join(f"CASE WHEN {q.blank(c)} THEN 1 ELSE 0 END" for c in
                    [x.strip() for x in PUBLISHED.split(",")][:17]
                    if c not in ("Amount", "VAT_15", "Total_Inc_VAT"))


def _metrics_sql(drop: bool, rule_count: int) -> str:
    return ledger_sql(f"""SELECT 'sales' AS mode, (SELECT count(*) FROM ledger_raw) AS rows_in,
  count(*) AS rows_out,
  (SELECT count(*) FROM ledger_raw) - (SELECT count(*) FROM filled) AS blank_dropped,
  (SELECT count(*) FROM filled) - count(*) AS dup_dropped, count(*) FILTER (Flagged) AS flagged,
  count(*) FILTER (Blocked) AS blocked, count(*) FILTER (Needs_Review) AS needs_review,
  count(*) FILTER (NOT Flagged) AS clean,
  count(*) FILTER (NOT Flagged) * 100.0 / greatest(count(*), 1) AS health,
  {q.cents(_money.format('Amount'))} AS revenue, {q.cents(_money.format('VAT_15'))} AS vat_total,
  {q.cents(_money.format('Total_Inc_VAT'))} AS inc_vat_total,
  {q.cents(_money.format('Amount'))} AS numeric_total, CAST(0.15 AS DOUBLE) AS vat_rate,
  CAST({rule_count} AS BIGINT) AS rule_count, CAST(17 AS BIGINT) AS columns,
  count(*) * 17 AS total_cells, CAST(sum({_cells}) AS BIGINT) AS missing_cells FROM judged""",
                      drop=drop)


@query("run_metrics", _metrics_sql(False, 22))
def _(spark, sf):
    return ledger_run(spark, sf).metrics()


@query("run_metrics_dropping", _metrics_sql(True, 21))
def _(spark, sf):
    return ledger_run(spark, sf, DROPPING).metrics()


@query("health", ledger_sql("""SELECT *, CASE WHEN "Health" >= 90 THEN 'good'
  WHEN "Health" >= 70 THEN 'fair' ELSE 'poor' END AS "Band" FROM (SELECT count(*) AS "Rows",
  count(*) FILTER (Flagged) AS "Flagged",
  round_even(count(*) FILTER (NOT Flagged) * 100.0 / greatest(count(*), 1) * 10000, 0) / 10000
  AS "Health" FROM judged) h"""))
def _(spark, sf):
    return report.health(clean(spark, sf))


@query("daily_trend", ledger_sql(f"SELECT Date, {q.cents('sum(Amount)')} AS Revenue FROM judged "
                                 "WHERE length(Date) = 10 GROUP BY Date"))
def _(spark, sf):
    return report.daily_trend(clean(spark, sf))


@query("generic_trend", f"""SELECT strftime(ts, '%Y-%m-%d') AS day, {q.cents('sum(value)')}
  AS total FROM events GROUP BY 1""")
def _(spark, sf):
    df = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    return report.trend(df, "day", "value")


@query("top_clients", ledger_sql(f"""SELECT Client_ID, count(*) AS Transactions,
  {q.cents('sum(Amount)')} AS Revenue, {q.cents('sum(VAT_15)')} AS VAT,
  count(*) FILTER (Flagged) AS Flagged FROM judged WHERE Client_ID <> '' GROUP BY Client_ID
  ORDER BY Revenue DESC, Client_ID LIMIT 15"""))
def _(spark, sf):
    return report.top_clients(clean(spark, sf))


_lineitem_numbers = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("column_totals", " UNION ALL ".join(
    f"SELECT '{c}' AS \"Column\", {q.cents(f'sum({c})')} AS \"Total\" FROM lineitem"
    for c in _lineitem_numbers))
def _(spark, sf):
    return report.column_totals(table(spark, sf, "lineitem"), list(_lineitem_numbers))


_changed = "count(*) FILTER (coalesce({}, '') <> coalesce({}, ''))"
_counters = {
    "status_mapped": f"count(*) FILTER ({q.known_status('_status')} IS NOT NULL)",
    "status_preserved_rows": f"count(*) FILTER ({q.known_status('_status')} IS NULL "
                             "AND NOT _status_blank)",
    "reconciled": "count(*) FILTER (Recon_Status = 'Reconciled')",
    "unreconciled": "count(*) FILTER (Recon_Status = 'Unreconciled')",
    "emails_rewritten": _changed.format("_email", "Email"),
    "phones_rewritten": _changed.format("_phone", "Phone"),
    "names_rewritten": _changed.format("_company", "Company"),
    **{f"hits: {x}": f"count(*) FILTER (list_contains(flag_list, '{x}'))" for x in FLAG_ORDER},
}


@query("rule_counters", ledger_sql(" UNION ALL ".join(
    f"SELECT '{n}' AS counter, {x} AS value FROM judged" for n, x in _counters.items())))
def _(spark, sf):
    return ledger_run(spark, sf).counters()


@query("preserved_statuses", ledger_sql(f"""SELECT count(*) AS preserved,
  array_to_string(list_sort(list(Status))[1:6], '|') AS examples FROM (
  SELECT DISTINCT Status FROM judged WHERE {q.known_status('_status')} IS NULL
  AND NOT _status_blank) s"""))
def _(spark, sf):
    return report.preserved_statuses(ledger_run(spark, sf).work).withColumn(
        "examples", F.array_join("examples", "|"))


def _rules_sql(where: str = "true") -> str:
    rows = []
    for r in RULES:
        labels = report.RULE_FLAGS.get(r.code, ())
        hits = " + ".join(f"count(*) FILTER (list_contains(flag_list, '{x}'))" for x in labels)
        rows.append(f"SELECT '{r.code}' AS \"Code\", {q.lit(r.name)} AS \"Rule\", "
                    f"'{r.category}' AS \"Category\", '{r.severity.split(' (')[0]}' AS \"Severity\", "
                    f"true AS \"Enabled\", true AS \"Applicable\", true AS \"Applied\", "
                    f"CAST({hits or 'count(*) * 0'} AS BIGINT) AS \"Flags_Raised\" FROM judged")
    return f"SELECT * FROM ({' UNION ALL '.join(rows)}) r WHERE {where}"


def _rules(spark, sf):
    run_ = ledger_run(spark, sf)
    return report.rules_applied(run_.clean, run_.rules_applied(), None, run_.context.mapped)


@query("rules_applied", ledger_sql(_rules_sql()))
def _(spark, sf):
    return _rules(spark, sf)


@query("rule_catalogue", ledger_sql(_rules_sql(
    "\"Category\" = 'Data Integrity' AND \"Severity\" = 'Warning' AND "
    "(lower(\"Rule\") LIKE '%flag%' OR lower(\"Code\") LIKE '%flag%')")))
def _(spark, sf):
    return explore.rule_catalogue(_rules(spark, sf), "Data Integrity", "Warning (Flag Only)",
                                  "enabled", " FLAG ")


@query("catalogue_tally", ledger_sql(
    'SELECT count(*) FILTER ("Severity" = \'Critical\') AS shown, '
    'count(*) FILTER ("Enabled") AS enabled, count(*) FILTER (NOT "Enabled") AS disabled '
    f"FROM ({_rules_sql()}) t"))
def _(spark, sf):
    listed = _rules(spark, sf)
    return explore.catalogue_tally(listed, explore.rule_catalogue(listed, severity="Critical"))


# --- filters and previews ----------------------------------------------------
@query("filter_category", ledger_sql("SELECT row_id, Status, Amount FROM judged "
                                     "WHERE Status = 'OVERDUE'"))
def _(spark, sf):
    return explore.filter_category(clean(spark, sf), "Status", "OVERDUE").select(
        "row_id", "Status", "Amount")


@query("filter_choices", ledger_sql("SELECT DISTINCT Status AS value FROM judged"))
def _(spark, sf):
    return explore.filter_choices(clean(spark, sf), "Status")


@query("filter_view", ledger_sql("SELECT row_id, Amount FROM judged WHERE NOT Flagged"))
def _(spark, sf):
    return explore.filter_view(clean(spark, sf), "clean").select("row_id", "Amount")


@query("search_any", ledger_sql("""SELECT row_id FROM judged WHERE contains(lower(concat_ws(chr(1),
  Date, Client_ID, Status, Recon_Status, Notes, Reference)), 'north-33')"""))
def _(spark, sf):
    return explore.search(clean(spark, sf), " NORTH-33 ").select("row_id")


@query("preview", ledger_sql("SELECT Date, Client_ID, Status, Recon_Status, Amount, Notes "
                             "FROM judged ORDER BY row_id LIMIT 250"))
def _(spark, sf):
    return explore.preview(clean(spark, sf), "row_id")


_quoted = ", ".join(f'"{h}"' for h in HEADERS)


@query("raw_preview", f"WITH {LEDGER_CTE} SELECT row_id, {_quoted} FROM ledger_raw "
                      "ORDER BY row_id LIMIT 200")
def _(spark, sf):
    return explore.raw_preview(ledger_raw(spark, sf), "row_id")


@query("auto_run", ledger_sql(
    "SELECT (SELECT count(*) FROM ledger_raw) AS ledger_rows, 'sales' AS ledger_mode, "
    "(SELECT count(*) FROM judged WHERE Flagged) AS ledger_flagged"))
def _(spark, sf):
    routed = run(ledger_raw(spark, sf), OPTIONS)
    return routed.metrics().select(F.col("rows_in").alias("ledger_rows"),
                                   F.col("mode").alias("ledger_mode"),
                                   F.col("flagged").alias("ledger_flagged"))
