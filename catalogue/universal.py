"""Profile, audit and universal-run queries with their SQL twins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallymark.constants import Options
from tallymark.functions.text import quoted
from tallymark.operators import explore, report
from tallymark.operators.profile import Profile, profile, standardise
from tallymark.operators.quantiles import exact_quantiles
from tallymark.operators.schema import clean_headers
from tallymark.plans.universal import UniversalRun, run_universal, sanitise

from . import sqltext as q
from .fixture import HEADERS, LEDGER_CTE, ledger_raw, table
from .ledger import AS_OF, QUERIES, SQL, ledger_run, ledger_sql, query  # noqa: F401


@dataclass(frozen=True)
class Source:
    """A table to profile: its order key and columns as (name, text|num|ts)."""

    name: str
    key: str
    columns: tuple[tuple[str, str], ...]
    base: str            # SQL of the sanitised table
    detected: tuple[tuple[str, str], ...] = ()   # types found in its texts

    @property
    def options(self) -> Options:
        return Options(order_by=self.key, as_of=AS_OF)

    def read(self, spark, sf) -> DataFrame:
        if self.name == "ledger_raw":
            return ledger_raw(spark, sf)
        if self.name == "sparse":
            table(spark, sf, "customer").createOrReplaceTempView("customer")
            return spark.sql(_SPARSE)
        return table(spark, sf, self.name)


def _base(name: str, key: str, columns) -> str:
    cells = ", ".join(f'{q.clean(chr(34) + c + chr(34))} AS "{c}"' if k == "text" else f'"{c}"'
                      for c, k in columns)
    return f"SELECT {key}, {cells} FROM {name}"


def _plain(name: str, key: str, **columns) -> Source:
    cols = tuple(columns.items())
    return Source(name, key, cols, _base(name, key, cols))


# A customer table with an empty and a constant column.
_SPARSE = """SELECT c_custkey, c_name AS name, CASE WHEN c_custkey < 0 THEN c_name ELSE ' ' END
 AS region, 'web' AS source, CAST(c_acctbal AS STRING) AS spend,
 CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment
 FROM customer"""

_ledger_columns = tuple((h.strip(), "text") for h in HEADERS)
_ledger_cells = ", ".join(f'{q.clean(chr(34) + h + chr(34))} AS "{h.strip()}"' for h in HEADERS)
_ledger_blank = " AND ".join(q.blank(f'"{h.strip()}"') for h in HEADERS)
LEDGER = Source("ledger_raw", "row_id", _ledger_columns,
                f"SELECT * FROM (SELECT row_id, {_ledger_cells} FROM ledger_raw) c "
                f"WHERE NOT ({_ledger_blank})")
ORDERS = _plain("orders", "o_orderkey", o_custkey="num", o_orderstatus="text",
                o_totalprice="num", o_orderdate="ts", o_orderpriority="text")
EVENTS = _plain("events", "event_id", ts="ts", user_id="num", event_type="text", value="num",
                props="text")
CUSTOMER = _plain("customer", "c_custkey", c_name="text", c_nationkey="num", c_acctbal="num",
                  c_mktsegment="text")
DOCUMENTS = _plain("documents", "doc_id", text="text", lang="text", source="text", n_chars="num")
_sparse_columns = (("name", "text"), ("region", "text"), ("source", "text"), ("spend", "text"),
                   ("segment", "text"))
SPARSE = Source("sparse", "c_custkey", _sparse_columns, _base("sparse", "c_custkey",
                                                             _sparse_columns))


def profile_sql(s: Source, final: str) -> str:
    """``final`` may read base, cells, types, stats, top, findings."""
    parts = []
    for i, (c, kind) in enumerate(s.columns):
        x = f'"{c}"'
        text, num, day = "NULL", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DATE)"
        if kind == "text":
            text = f"CASE WHEN NOT {q.blank(x)} THEN {x} END"
        elif kind == "num":
            num = f"CAST({x} AS DOUBLE)"
        else:
            text, day = f"CAST({x} AS VARCHAR)", f"CAST({x} AS DATE)"
        parts.append(f"SELECT {i} AS ord, '{c}' AS col, '{kind}' AS decl, "
                     f"CAST({text} AS VARCHAR) AS v, {num} AS num0, {day} AS day0 FROM base")
    ledger = f"{LEDGER_CTE}, " if s.name == "ledger_raw" else ""
    sparse = (f"sparse AS ({_SPARSE.replace('AS STRING', 'AS VARCHAR')}), "
              if s.name == "sparse" else "")
    spread = "q3 - q1"
    outlier = (f"(({spread}) > 0 AND (num < q1 - 3 * ({spread}) OR num > q3 + 3 * ({spread}))) "
               "OR (std > 0 AND abs(num - mean) > 3.0 * std)")
    pct = "round_even({} * 1000.0 / greatest(n_rows, 1), 0) / 10"
    return f"""
WITH {ledger}{sparse}base AS ({s.base}),
cells0 AS ({" UNION ALL ".join(parts)}),
cells AS (SELECT *, v AS key,
  v IS NOT NULL OR num0 IS NOT NULL AS filled,
  decl = 'text' AND coalesce({q.gate('v')}, false) AS gated,
  decl = 'text' AND coalesce({q.datelike('v')}, false) AS dateish,
  CASE WHEN decl = 'num' THEN num0 WHEN decl = 'text' AND {q.gate('v')} THEN {q.amount('v')} END
    AS num,
  CASE WHEN decl = 'ts' THEN day0 WHEN decl = 'text' THEN {q.date('v')} END AS day FROM cells0),
census AS (SELECT ord, col, decl, count(*) AS n_rows, count(*) FILTER (filled) AS filled,
  count(*) FILTER (gated) AS gated, count(num) AS nums, count(*) FILTER (dateish) AS dateish,
  count(day) AS days, count(DISTINCT coalesce(v, CAST(num AS VARCHAR))) AS uniq,
  count(DISTINCT lower(v)) AS folded, min(day) AS lo, max(day) AS hi
  FROM cells GROUP BY ord, col, decl),
types AS (SELECT *, n_rows - filled AS nulls, CASE WHEN filled = 0 THEN 'Empty'
  WHEN decl = 'num' THEN 'Numeric' WHEN decl = 'ts' THEN 'Datetime'
  WHEN gated >= 0.8 * filled AND nums >= 0.8 * gated THEN 'Numeric'
  WHEN dateish >= 0.8 * filled AND days >= 0.8 * filled THEN 'Datetime'
  WHEN uniq <= 0.5 * filled OR uniq <= 12 THEN 'Categorical' ELSE 'Text / ID' END AS type
  FROM census),
unparsed AS (SELECT *, CASE type WHEN 'Numeric' THEN filled - nums WHEN 'Datetime'
  THEN filled - days ELSE 0 END AS bad FROM types),
stats AS (SELECT c.col, sum(num) AS total, avg(num) AS mean, quantile_cont(num, 0.25) AS q1,
  quantile_cont(num, 0.5) AS median, quantile_cont(num, 0.75) AS q3, min(num) AS lo,
  max(num) AS hi, coalesce(stddev_samp(num), 0) AS std, count(num) AS n
  FROM cells c JOIN types t USING (col) WHERE type = 'Numeric' GROUP BY c.col),
counted AS (SELECT c.col, key, any_value(v) AS v, count(*) AS n FROM cells c JOIN types t
  USING (col) WHERE type IN ('Categorical', 'Text / ID') AND v IS NOT NULL GROUP BY c.col, key),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, key) AS rank
  FROM counted) r WHERE rank <= 8),
tops AS (SELECT col, string_agg(v || ' (' || n || ')', ', ' ORDER BY rank) FILTER (rank <= 3)
  AS top3, string_agg(v || ' (' || n || ')', ', ' ORDER BY rank) FILTER (rank <= 5) AS top5,
  max(v) FILTER (rank = 1) AS mode, max(n) FILTER (rank = 1) AS freq FROM top GROUP BY col),
outliers AS (SELECT c.col, count(*) FILTER ({outlier}) AS n FROM cells c JOIN stats s USING (col)
  WHERE s.n >= 8 GROUP BY c.col),
valued AS (SELECT base.*, {", ".join(_value(c, k, s) for c, k in s.columns)} FROM base),
copies AS (SELECT *, row_number() OVER (PARTITION BY {", ".join(f'"std {c}"' for c, _ in s.columns)}
  ORDER BY {s.key}) AS copy FROM valued),
found AS (
  SELECT ord, col, type, 1 AS step, 'Missing values' AS issue, nulls AS n, {pct.format('nulls')}
    AS pct, CASE WHEN nulls > 0.2 * n_rows THEN 'High' WHEN nulls > 0.05 * n_rows THEN 'Medium'
    ELSE 'Low' END AS sev FROM types WHERE nulls > 0
  UNION ALL SELECT ord, col, type, 2, 'Column is entirely empty', n_rows, 100.0, 'High'
    FROM types WHERE type = 'Empty'
  UNION ALL SELECT ord, t.col, type, 3, 'Constant value (''' || coalesce(mode, '') || ''')',
    filled, {pct.format('filled')}, 'Low' FROM types t LEFT JOIN tops USING (col)
    WHERE uniq = 1 AND filled > 1
  UNION ALL SELECT ord, col, type, 4, CASE type WHEN 'Datetime' THEN 'Inconsistent date strings'
    ELSE 'Non-numeric values in a numeric column' END, bad, {pct.format('bad')}, 'High'
    FROM unparsed WHERE bad > 0
  UNION ALL SELECT ord, col, type, 5, 'Severe numeric outliers (>3 SD or 3x IQR)', o.n,
    {pct.format('o.n')}, 'Medium' FROM types JOIN outliers o USING (col) WHERE o.n > 0
  UNION ALL SELECT ord, col, type, 6, 'Inconsistent casing / spacing in labels', uniq - folded,
    {pct.format('(uniq - folded)')}, 'Medium' FROM types
    WHERE type IN ('Categorical', 'Text / ID') AND uniq > folded
  UNION ALL SELECT 999, '(whole row)', '-', 7, 'Duplicate rows', n,
    round_even(n * 1000.0 / (SELECT max(n_rows) FROM types), 0) / 10, 'High'
    FROM (SELECT count(*) FILTER (copy > 1) AS n FROM copies) d WHERE n > 0),
findings AS (SELECT col AS "Column", type AS "Type", issue AS "Issue", n AS "Rows",
  pct AS "% of File", sev AS "Severity" FROM found),
{_issues_sql(s)}
{final}"""


# Types found in the profiled tables; the infer_types queries check them.
DETECTED = {"Date": "Datetime", "Amount (ZAR)": "Numeric", "VAT No": "Numeric",
            "Credit Limit": "Numeric", "Postcode": "Numeric", "spend": "Numeric"}


def _kind(c: str, declared: str, s: Source) -> str:
    found = dict(s.detected) or DETECTED
    return {"num": "Numeric", "ts": "Datetime"}.get(declared, found.get(c, "text"))


def _value(c: str, declared: str, s: Source) -> str:
    """The parsed and the standardised cell of a column."""
    x = f'"{c}"'
    kind = _kind(c, declared, s)
    if declared == "num":
        return f'CAST({x} AS DOUBLE) AS "val {c}", {x} AS "std {c}"'
    if declared == "ts":
        return f'CAST({x} AS DATE) AS "val {c}", strftime({x}, \'%Y-%m-%d\') AS "std {c}"'
    if kind == "Numeric":
        v = f"CASE WHEN {q.gate(x)} THEN {q.amount(x)} END"
        return f'{v} AS "val {c}", {v} AS "std {c}"'
    if kind == "Datetime":
        v = q.date(x)
        return f'{v} AS "val {c}", coalesce(strftime({v}, \'%Y-%m-%d\'), \'\') AS "std {c}"'
    return f'{x} AS "val {c}", {x} AS "std {c}"'


def _issues_sql(s: Source) -> str:
    slots = []
    for c, declared in s.columns:
        kind = _kind(c, declared, s)
        blank = q.blank(f'"{c}"') if declared == "text" else f'"{c}" IS NULL'
        if c != "region":
            slots.append(f"CASE WHEN {blank} THEN 'NULL: {c}' END")
        if kind in ("Numeric", "Datetime") and declared == "text":
            word = "DATE" if kind == "Datetime" else "NUMBER"
            slots.append(f"CASE WHEN NOT {blank} AND \"val {c}\" IS NULL "
                         f"THEN 'BAD {word}: {c}' END")
        if kind == "Numeric":
            slots.append(f"CASE WHEN EXISTS (SELECT 1 FROM stats s WHERE s.col = '{c}' "
                         f"AND s.n >= 8 AND ((s.q3 - s.q1 > 0 AND (\"val {c}\" < s.q1 - 3 * (s.q3 - "
                         f"s.q1) OR \"val {c}\" > s.q3 + 3 * (s.q3 - s.q1))) OR (s.std > 0 AND "
                         f"abs(\"val {c}\" - s.mean) > 3.0 * s.std))) THEN 'OUTLIER: {c}' END")
    slots.append("CASE WHEN copy > 1 THEN 'DUPLICATE ROW' END")
    return (f"issues AS (SELECT *, list_filter([{', '.join(slots)}], lambda x: x IS NOT NULL) "
            "AS issues FROM copies)")


_PROFILES: dict[tuple, Profile] = {}
_RUNS: dict[tuple, UniversalRun] = {}


def profiled(spark, sf, s: Source) -> Profile:
    at = (spark.sparkContext.applicationId, sf, s.name)
    if at not in _PROFILES:
        _PROFILES[at] = profile(sanitise(s.read(spark, sf), s.options), s.options)
    return _PROFILES[at]


def universal(spark, sf, s: Source) -> UniversalRun:
    at = (spark.sparkContext.applicationId, sf, s.name)
    if at not in _RUNS:
        _RUNS[at] = run_universal(s.read(spark, sf), s.options)
        _PROFILES[at] = _RUNS[at].profile
    return _RUNS[at]


_table = """SELECT t.col AS "Column", type AS "Detected Type", filled AS "Non-Null",
  nulls AS "Missing", round_even(nulls * 1000.0 / greatest(n_rows, 1), 0) / 10 AS "Missing %",
  uniq AS "Unique", CASE type WHEN 'Numeric' THEN 'min ' || format('{:,.2f}', s.lo) || ' | mean '
  || format('{:,.2f}', s.mean) || ' | max ' || format('{:,.2f}', s.hi)
  WHEN 'Datetime' THEN strftime(t.lo, '%Y-%m-%d') || ' to ' || strftime(t.hi, '%Y-%m-%d')
  ELSE coalesce(top3, '') END AS "Detail"
  FROM types t LEFT JOIN stats s USING (col) LEFT JOIN tops USING (col)"""
_types = 'SELECT col AS "Column", type AS "Detected Type" FROM types'
_numeric = ('SELECT s.col AS "Column", filled AS "Count", ' + ", ".join(
    f'{q.cents("s." + c)} AS "{n}"' for c, n in
    (("total", "Sum"), ("mean", "Mean"), ("median", "Median"), ("lo", "Min"), ("hi", "Max"),
     ("std", "Std Dev"))) + ', nulls AS "Missing" FROM stats s JOIN types t USING (col)')
_categorical = """SELECT col AS "Column", type AS "Type", uniq AS "Unique", mode AS "Most Common",
  freq AS "Frequency", round_even(freq * 1000.0 / filled, 0) / 10 AS "Share %",
  top5 AS "Top Values", nulls AS "Missing" FROM types JOIN tops USING (col)"""
_datetime = """SELECT col AS "Column", strftime(lo, '%Y-%m-%d') AS "Earliest",
  strftime(hi, '%Y-%m-%d') AS "Latest", uniq AS "Distinct Dates", bad AS "Unparseable",
  nulls AS "Missing" FROM unparsed WHERE type = 'Datetime'"""

for _s in (LEDGER, ORDERS, EVENTS, CUSTOMER, DOCUMENTS):
    _suffix = "" if _s is LEDGER else "_" + _s.name

    @query("infer_types" + _suffix, profile_sql(_s, _types))
    def _(spark, sf, s=_s):
        return profiled(spark, sf, s).type_table()

    @query("profile_table" + _suffix, profile_sql(_s, _table))
    def _(spark, sf, s=_s):
        return profiled(spark, sf, s).table()

for _s in (LEDGER, EVENTS):
    _suffix = "" if _s is LEDGER else "_" + _s.name

    @query("numeric_stats" + _suffix, profile_sql(_s, _numeric))
    def _(spark, sf, s=_s):
        return profiled(spark, sf, s).numeric()

    @query("categorical_stats" + _suffix, profile_sql(_s, _categorical))
    def _(spark, sf, s=_s):
        return profiled(spark, sf, s).categorical()

    @query("datetime_stats" + _suffix, profile_sql(_s, _datetime))
    def _(spark, sf, s=_s):
        return profiled(spark, sf, s).datetime()

    @query("audit_table" + _suffix, profile_sql(_s, "SELECT * FROM findings"))
    def _(spark, sf, s=_s):
        return universal(spark, sf, s).audit.findings


@query("top_values", profile_sql(LEDGER, 'SELECT col AS "Column", CAST(rank AS INTEGER) AS "Rank", '
                                         'v AS "Value", n AS "Rows" FROM top'))
def _(spark, sf):
    return profiled(spark, sf, LEDGER).top_values()


_scored = """SELECT col, total, CASE WHEN regexp_matches(lower(col), '_id$') THEN 0
  WHEN regexp_matches(lower(col), 'amount|total|value|revenue|sales|price|cost|net|gross|sum|spend|'
  || 'balance|qty|quantity|units|count') THEN 2 ELSE 1 END AS score,
  (SELECT ord FROM types t WHERE t.col = s.col) AS ord FROM stats s"""


@query("key_numeric", profile_sql(LEDGER, f"""SELECT CAST(row_number() OVER (ORDER BY score DESC,
  abs(total) DESC, ord) AS INTEGER) AS "Rank", col AS "Column", {q.cents('total')} AS "Sum"
  FROM ({_scored}) k ORDER BY score DESC, abs(total) DESC, ord LIMIT 3"""))
def _(spark, sf):
    return profiled(spark, sf, LEDGER).key_numeric_table()


@query("type_census", profile_sql(LEDGER, 'SELECT type AS "Detected Type", count(*) AS "Columns" '
                                          "FROM types GROUP BY type"))
def _(spark, sf):
    return profiled(spark, sf, LEDGER).type_census()


@query("value_share", """SELECT event_type AS "Value", count(*) AS "Rows",
  round_even(count(*) * 1000.0 / (SELECT count(*) FROM events), 0) / 10 AS "Share %"
  FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def _(spark, sf):
    return report.value_share(table(spark, sf, "events"), "event_type")


_standard = ", ".join(f'"std {c}" AS "{c}"' for c, _ in LEDGER.columns)


@query("standardise_types", profile_sql(LEDGER, f"SELECT row_id, {_standard} FROM valued"))
def _(spark, sf):
    rows = sanitise(ledger_raw(spark, sf), LEDGER.options)
    return standardise(rows, profiled(spark, sf, LEDGER).types, LEDGER.options)


@query("generic_headers", profile_sql(LEDGER, "SELECT count(*) AS n, " + ", ".join(
    f'max("{h}") AS "{h.strip()}"' for h in HEADERS) + " FROM ledger_raw"))
def _(spark, sf):
    df = clean_headers(ledger_raw(spark, sf))
    return df.agg(F.count(F.lit(1)).alias("n"),
                  *[F.max(quoted(c)).alias(c) for c in df.columns if c != "row_id"])


# --- audit -------------------------------------------------------------------
_FINDINGS = {
    "audit_missing": (LEDGER, "Missing values"),
    "audit_empty_column": (SPARSE, "Column is entirely empty"),
    "audit_constant": (SPARSE, "Constant value"),
    "audit_bad_dates": (LEDGER, "Inconsistent date strings"),
    "audit_bad_numbers": (LEDGER, "Non-numeric values in a numeric column"),
    "audit_outliers": (EVENTS, "Severe numeric outliers"),
    "audit_casing": (SPARSE, "Inconsistent casing / spacing in labels"),
    "audit_duplicates": (LEDGER, "Duplicate rows"),
}

for _name, (_s, _issue) in _FINDINGS.items():
    @query(_name, profile_sql(_s, f"SELECT * FROM findings WHERE starts_with(\"Issue\", '{_issue}')"))
    def _(spark, sf, s=_s, issue=_issue):
        return universal(spark, sf, s).audit.findings.filter(F.col("Issue").startswith(issue))


@query("severity_census", profile_sql(LEDGER, 'SELECT "Severity", count(*) AS "Findings" '
                                              "FROM findings GROUP BY 1"))
def _(spark, sf):
    return report.severity_census(universal(spark, sf, LEDGER).audit.findings)


_width = len(LEDGER.columns)


@query("audit_totals", profile_sql(LEDGER, f"""SELECT count(*) AS rows,
  CAST({_width} AS BIGINT) AS columns, (SELECT count(*) FROM findings) AS issue_count,
  count(*) FILTER (len(issues) > 0) AS rows_affected,
  count(*) FILTER (len(issues) = 0) AS rows_clean,
  count(*) FILTER (len(issues) = 0) / count(*) * 100 AS health,
  count(*) FILTER (copy > 1) AS duplicate_rows, count(*) * {_width} AS total_cells,
  CAST((SELECT sum(nulls) FROM types) AS BIGINT) AS missing_cells FROM issues"""))
def _(spark, sf):
    return universal(spark, sf, LEDGER).audit.totals


for _s in (LEDGER, EVENTS, CUSTOMER):
    _suffix = "" if _s is LEDGER else "_" + _s.name

    @query("row_issues" + _suffix, profile_sql(_s, f"""SELECT {_s.key},
  array_to_string(issues, ' | ') AS "Notes", len(issues) > 0 AS "Flagged",
  CAST(len(issues) AS INTEGER) AS "Flag_Count" FROM issues"""))
    def _(spark, sf, s=_s):
        return universal(spark, sf, s).clean.select(s.key, "Notes", "Flagged", "Flag_Count")


@query("issue_breakdown", profile_sql(LEDGER, 'SELECT unnest(issues) AS "Exception", count(*) AS '
                                              '"Rows" FROM issues GROUP BY 1'))
def _(spark, sf):
    return universal(spark, sf, LEDGER).breakdown()


_texts = [f'"{c}"' for c in ("Status",)]


@query("universal_run", profile_sql(LEDGER, f"""SELECT {_standard},
  array_to_string(issues, ' | ') AS "Notes", len(issues) > 0 AS "Flagged",
  CAST(len(issues) AS INTEGER) AS "Flag_Count", {q.review(*_texts)} AS "Needs_Review",
  array_to_string(issues, '|') AS issues, row_id FROM issues"""))
def _(spark, sf):
    run = universal(spark, sf, LEDGER)
    return run.clean.withColumn("issues", F.array_join("issues", "|"))


@query("universal_run_documents", profile_sql(DOCUMENTS, f"""SELECT doc_id, text, lang, source,
  "std n_chars" AS n_chars, array_to_string(issues, ' | ') AS "Notes",
  {q.review('text', 'lang', 'source')} AS "Needs_Review" FROM issues"""))
def _(spark, sf):
    return universal(spark, sf, DOCUMENTS).clean.select(
        "doc_id", "text", "lang", "source", "n_chars", "Notes", "Needs_Review")


@query("universal_metrics", profile_sql(EVENTS, """SELECT 'universal' AS mode, count(*) AS rows_in,
  count(*) AS rows_out, CAST(0 AS BIGINT) AS blank_dropped, CAST(0 AS BIGINT) AS dup_dropped,
  count(*) FILTER (len(issues) > 0) AS flagged, count(*) FILTER (len(issues) = 0) AS clean,
  count(*) FILTER (len(issues) = 0) / count(*) * 100 AS health, CAST(5 AS BIGINT) AS columns,
  count(*) * 5 AS total_cells, CAST((SELECT sum(nulls) FROM types) AS BIGINT) AS missing_cells,
  count(*) FILTER (copy > 1) AS duplicate_rows,
  round_even((SELECT sum(total) FROM stats) * 100, 0) / 100 AS numeric_total,
  (SELECT count(*) FROM findings) AS rule_count, CAST(0.15 AS DOUBLE) AS vat_rate FROM issues"""))
def _(spark, sf):
    row = universal(spark, sf, EVENTS).metrics()
    return row.withColumn("numeric_total", F.rint(F.col("numeric_total") * 100) / 100)


@query("filter_first_category", profile_sql(EVENTS, "SELECT event_id, event_type FROM base "
                                                    "WHERE event_type = 'click'"))
def _(spark, sf):
    run = universal(spark, sf, EVENTS)
    column = explore.category_column(run.clean, run.profile.types)
    return explore.filter_category(run.clean, column, "click").select("event_id", column)


@query("search_universal", profile_sql(EVENTS, """SELECT event_id, event_type FROM issues
  WHERE contains(lower(concat_ws(chr(1), event_type, props, array_to_string(issues, ' | '))),
    'click')"""))
def _(spark, sf):
    return universal(spark, sf, EVENTS).search("click").select("event_id", "event_type")


for _s in (EVENTS, DOCUMENTS):
    _shown = ", ".join(f'"std {c}" AS "{c}"' for c, _ in _s.columns)

    @query("preview_universal_" + _s.name, profile_sql(_s, f"""SELECT {_shown},
  array_to_string(issues, ' | ') AS "Notes" FROM issues ORDER BY {_s.key} LIMIT 250"""))
    def _(spark, sf, s=_s):
        return universal(spark, sf, s).preview()


# Texts of every length, and dates padded beyond any of them.
_MIXED = """SELECT doc_id, text, rpad(concat('2001-02-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2,
  '0')), CAST(10 + doc_id % 3 * 120 AS INT), ' ') AS padded FROM documents"""
MIXED = Source("mixed", "doc_id", (("text", "text"), ("padded", "text")), "SELECT * FROM mixed",
               (("padded", "Datetime"),))


@query("profile_mixed_lengths", profile_sql(MIXED, _table).replace(
    "WITH base", f"WITH mixed AS ({_MIXED.replace('AS STRING', 'AS VARCHAR')}), base", 1))
def _(spark, sf):
    table(spark, sf, "documents").createOrReplaceTempView("documents")
    return profile(spark.sql(_MIXED), MIXED.options).table()


@query("quantiles_wide", """SELECT quantile_cont(l_extendedprice, 0.25) AS q1,
  quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3
  FROM lineitem""")
def _(spark, sf):
    values = table(spark, sf, "lineitem").groupBy(F.col("l_extendedprice").alias("num")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("column", F.lit("price"))
    total = values.agg(F.sum("n")).first()[0]
    q = exact_quantiles(values, {"price": total}, [0.25, 0.5, 0.75])["price"]
    return spark.createDataFrame([(q[0.25], q[0.5], q[0.75])], "q1 double, q2 double, q3 double")


_BIG = 2 ** 53


@query("large_ids", f"""SELECT o_orderkey, o_orderkey + {_BIG} AS big, false AS "Flagged",
  (SELECT count(*) FROM orders) AS uniq FROM orders""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") + _BIG).alias("big"))
    r = run_universal(rows, Options(order_by="o_orderkey", as_of=AS_OF))
    return r.clean.select("o_orderkey", "big", "Flagged",
                          F.lit(r.profile["big"].unique).cast("bigint").alias("uniq"))


# --- the ledger's own audit ------------------------------------------------------
_audited = ("Date", "Client_ID", "Reference", "Recon_Status", "Status", "Amount", "VAT_15",
            "Total_Inc_VAT", "Notes", "VAT_Number", "Credit_Limit", "Email", "Phone", "Company",
            "Postal_Code", "Address", "EXTRA_Branch")
_cells = ", ".join("_source_notes AS Notes" if c == "Notes" else c for c in _audited)
AUDITED = Source(
    "audited", "row_id",
    tuple((c, "num" if c in ("Amount", "VAT_15", "Total_Inc_VAT") else "text") for c in _audited),
    "SELECT * FROM (" + ledger_sql(f"SELECT row_id, {_cells} FROM judged") + ")",
    (("Date", "Datetime"), ("VAT_Number", "Numeric"), ("Credit_Limit", "Numeric"),
     ("Phone", "Numeric"), ("Postal_Code", "Numeric")))


def _audit(spark, sf):
    at = (spark.sparkContext.applicationId, sf, "audited")
    if at not in _AUDITS:
        _AUDITS[at] = ledger_run(spark, sf).audit()
    return _AUDITS[at]


_AUDITS: dict = {}


@query("ledger_audit", profile_sql(AUDITED, "SELECT * FROM findings"))
def _(spark, sf):
    return _audit(spark, sf).findings


@query("ledger_audit_totals", profile_sql(AUDITED, """SELECT count(*) AS rows,
  (SELECT count(*) FROM findings) AS issue_count, count(*) FILTER (len(issues) > 0)
  AS rows_affected, count(*) FILTER (copy > 1) AS duplicate_rows FROM issues"""))
def _(spark, sf):
    return _audit(spark, sf).totals.select("rows", "issue_count", "rows_affected", "duplicate_rows")


@query("run_metrics_full", profile_sql(AUDITED, f"""SELECT 'sales' AS mode, count(*) AS rows_out,
  (SELECT count(*) FROM ({ledger_sql("SELECT * FROM judged WHERE Flagged")})) AS flagged,
  count(*) FILTER (copy > 1) AS duplicate_rows FROM issues"""))
def _(spark, sf):
    return ledger_run(spark, sf).full_metrics(1.5).select("mode", "rows_out", "flagged",
                                                          "duplicate_rows")
