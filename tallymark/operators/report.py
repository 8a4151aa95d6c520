"""Summary tables over a clean table. All lazy; every group-by is partial
before its shuffle, every total is one row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..constants import FLAG_ORDER, RULES, TOP_CLIENTS, TOP_VALUES, Options
from ..functions.numbers import cents, share
from ..functions.text import as_text, is_blank, is_blank_tidy, quoted, status_rank

MONEY = ("Amount", "VAT_15", "Total_Inc_VAT")


def _rows() -> Column:
    return F.count(F.lit(1))


def _one_row(*parts: DataFrame) -> DataFrame:
    """Several one-row tables with different columns, side by side."""
    names = [c for p in parts for c in p.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(quoted(c)).alias(c) for c in names])


def money(value: Column) -> Column:
    """The sum of amounts that are whole cents: exact, whatever the order."""
    exact = F.sum(F.rint(value * 100).try_cast("decimal(38,0)"))
    return F.coalesce(exact.cast("double") / 100, F.lit(0.0))


def _total(value: Column, dtype: T.DataType) -> Column:
    """A sum to cents; exact for whole numbers and decimals."""
    if isinstance(dtype, T.IntegralType):
        value = value.cast("decimal(38,0)")
    total = F.sum(value if isinstance(dtype, T.NumericType) else value.cast("double"))
    return cents(F.coalesce(total.cast("double"), F.lit(0.0)))


def revenue_totals(clean: DataFrame, exclude_cancelled: bool = True) -> DataFrame:
    """Sums over the rows that count as revenue."""
    counts = F.col("Status") != "CANCELLED" if exclude_cancelled else F.lit(True)
    names = ("revenue", "vat_total", "inc_vat_total")
    return clean.agg(*[money(F.when(counts, F.col(c))).alias(n)
                       for c, n in zip(MONEY, names)])


def status_pivot(clean: DataFrame, total: bool = False) -> DataFrame:
    """Per status: rows, three sums, flagged rows; cancelled rows included.
    ``total`` adds the sums of the rounded groups as a last row."""
    pivot = clean.groupBy("Status").agg(
        _rows().alias("Transactions"),
        money(F.col("Amount")).alias("Revenue_Excl_VAT"),
        money(F.col("VAT_15")).alias("VAT_15"),
        money(F.col("Total_Inc_VAT")).alias("Total_Inc_VAT"),
        F.count_if("Flagged").alias("Flagged_Rows"))
    if not total:
        return pivot.orderBy(status_rank(F.col("Status")), "Status")
    sums = [F.sum("Transactions").alias("Transactions")]
    sums += [money(F.col(c)).alias(c)
             for c in ("Revenue_Excl_VAT", "VAT_15", "Total_Inc_VAT")]
    sums.append(F.sum("Flagged_Rows").alias("Flagged_Rows"))
    grand = pivot.agg(*sums).select(F.lit("GRAND TOTAL").alias("Status"), "*")
    both = pivot.withColumn("_last", F.lit(0)).unionByName(grand.withColumn("_last", F.lit(1)))
    return both.orderBy("_last", status_rank(F.col("Status")), "Status").drop("_last")


def flag_breakdown(rows: DataFrame, labels: str = "flags") -> DataFrame:
    """Rows per label, most frequent first."""
    return (rows.select(F.explode(labels).alias("Exception"))
            .groupBy("Exception").agg(_rows().alias("Rows"))
            .orderBy(F.desc("Rows"), "Exception"))


def breakdown_share(rows: DataFrame, labels: str = "flags") -> DataFrame:
    """The breakdown with each label's percent of all rows. A marker label
    counts the rows in the same pass; it cannot occur among the labels."""
    marked = rows.select(F.explode(F.concat(F.col(labels), F.array(F.lit("\u0000rows"))))
                         .alias("Exception"))
    counts = marked.groupBy("Exception").agg(_rows().alias("Rows"))
    # one row per label from here on: a window over all of them is small
    everything = Window.partitionBy(F.lit(1))
    whole = F.max(F.when(F.col("Exception") == "\u0000rows", F.col("Rows"))).over(everything)
    return (counts.withColumn("_all", whole).filter(F.col("Exception") != "\u0000rows")
            .select("Exception", "Rows", share(F.col("Rows"), F.col("_all")).alias("% of File"))
            .orderBy(F.desc("Rows"), "Exception"))


def health(clean: DataFrame) -> DataFrame:
    """Percent of rows without a flag, and its band."""
    pct = (F.count_if(~F.col("Flagged")) * 100.0 / F.greatest(_rows(), F.lit(1)))
    band = (F.when(F.col("Health") >= 90, "good").when(F.col("Health") >= 70, "fair")
            .otherwise("poor"))
    return clean.agg(_rows().alias("Rows"), F.count_if("Flagged").alias("Flagged"),
                     pct.alias("Health")).select(
        "Rows", "Flagged", F.rint(F.col("Health") * 10000).alias("h"), band.alias("Band")
    ).select("Rows", "Flagged", (F.col("h") / 10000).alias("Health"), "Band")


def ledger_metrics(raw: DataFrame, filled: DataFrame, clean: DataFrame, o: Options,
                   rule_count: int, filled_rows: int | None = None) -> DataFrame:
    """The run's numbers as one row. Without a duplicate drop the rows that
    are not blank are the rows that come out, and are counted once; with one
    ``filled_rows`` is their number, if it is known already."""
    parts = [raw.agg(_rows().alias("rows_in"))]
    if o.drop_duplicates:
        if filled_rows is None:
            parts.append(filled.agg(_rows().alias("_filled")))
        else:
            parts[0] = parts[0].withColumn("_filled", F.lit(filled_rows).cast("bigint"))
    counts = F.col("Status") != "CANCELLED" if o.exclude_cancelled else F.lit(True)
    sums = [money(F.when(counts, F.col(c))).alias(n)
            for c, n in zip(MONEY, ("revenue", "vat_total", "inc_vat_total"))]
    bookkeeping = ["flags", "Flagged", "Flag_Count", "Needs_Review", "Blocked"]
    bookkeeping += [o.order_by] if o.order_by else []
    shown = [f for f in clean.schema.fields if f.name not in bookkeeping]
    blank = is_blank_tidy if o.on("R01") else is_blank
    missing = reduce(lambda a, b: a + b, [
        F.when(blank(quoted(f.name), f.dataType), 1).otherwise(0) for f in shown])
    parts.append(clean.agg(
        _rows().alias("rows_out"), F.count_if("Flagged").alias("flagged"),
        F.count_if("Blocked").alias("blocked"), F.count_if("Needs_Review").alias("needs_review"),
        *sums, F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells")))
    row = _one_row(*parts)
    kept = F.col("_filled") if o.drop_duplicates else F.col("rows_out")
    return row.select(
        F.lit("sales").alias("mode"), "rows_in", "rows_out",
        (F.col("rows_in") - kept).alias("blank_dropped"),
        (kept - F.col("rows_out")).alias("dup_dropped"),
        "flagged", "blocked", "needs_review",
        (F.col("rows_out") - F.col("flagged")).alias("clean"),
        ((F.col("rows_out") - F.col("flagged")) * 100.0
         / F.greatest("rows_out", F.lit(1))).alias("health"),
        "revenue", "vat_total", "inc_vat_total", F.col("revenue").alias("numeric_total"),
        F.lit(float(o.vat_rate)).alias("vat_rate"),
        F.lit(rule_count).cast("bigint").alias("rule_count"),
        F.lit(len(shown)).cast("bigint").alias("columns"),
        (F.col("rows_out") * len(shown)).alias("total_cells"), "missing_cells")


def trend(df: DataFrame, date_col: str, value_col: str, name: str = "total",
          total: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sum of a numeric column per ISO date; other texts are left out."""
    total = total or (lambda v: _total(v, df.schema[value_col].dataType))
    return (df.filter(F.length(quoted(date_col).cast("string")) == 10)
            .groupBy(quoted(date_col).alias(date_col))
            .agg(total(quoted(value_col)).alias(name))
            .orderBy(quoted(date_col)))


def daily_trend(clean: DataFrame) -> DataFrame:
    return trend(clean, "Date", "Amount", "Revenue", money)


def top_clients(clean: DataFrame, n: int = TOP_CLIENTS) -> DataFrame:
    """The ``n`` identifiable clients with the most revenue."""
    return (clean.filter(F.col("Client_ID") != "").groupBy("Client_ID")
            .agg(_rows().alias("Transactions"), money(F.col("Amount")).alias("Revenue"),
                 money(F.col("VAT_15")).alias("VAT"), F.count_if("Flagged").alias("Flagged"))
            .orderBy(F.desc("Revenue"), "Client_ID").limit(n))


def column_totals(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per numeric column: its sum."""
    names = columns or [f.name for f in df.schema.fields
                        if isinstance(f.dataType, T.NumericType)]
    sums = df.agg(*[_total(quoted(c), df.schema[c].dataType).alias(f"s{i}")
                    for i, c in enumerate(names)])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("Column"), F.col(f"s{i}").alias("Total"))
        for i, c in enumerate(names)])))


def value_share(df: DataFrame, column: str, n: int = TOP_VALUES) -> DataFrame:
    """The ``n`` most frequent values of a column with their percent of rows."""
    dtype = df.schema[column].dataType
    text = as_text(quoted(column), dtype)
    counts = df.groupBy(F.when(~is_blank(quoted(column), dtype), text).alias("Value")
                        ).agg(_rows().alias("Rows"))
    top = (counts.filter(F.col("Value").isNotNull())
           .orderBy(F.desc("Rows"), "Value").limit(n))
    # n rows at most, next to the one-row total
    whole = counts.agg(F.sum("Rows").alias("_all"))
    listed = _one_row(whole, top.agg(F.collect_list(F.struct("Value", "Rows")).alias("_top")))
    return (listed.select("_all", F.inline("_top"))
            .select("Value", "Rows", share(F.col("Rows"), F.col("_all")).alias("Share %"))
            .orderBy(F.desc("Rows"), "Value"))


def rule_counters(work: DataFrame, ctx) -> DataFrame:
    """Per-rule counters: (counter, value). Counted after any duplicate drop."""
    from ..functions.text import is_missing, known_status

    def changed(before, after):
        return F.count_if(F.coalesce(F.col(before), F.lit(""))
                          != F.coalesce(F.col(after), F.lit("")))

    known = known_status(F.col("_status"))
    counters = {
        "status_mapped": F.count_if(known.isNotNull()),
        "status_preserved_rows": F.count_if(known.isNull() & ~F.col("_status_blank")),
        "reconciled": F.count_if(F.col("Recon_Status") == "Reconciled"),
        "unreconciled": F.count_if(F.col("Recon_Status") == "Unreconciled"),
        "emails_rewritten": changed("_email", "Email"),
        "phones_rewritten": changed("_phone", "Phone"),
        "names_rewritten": changed("_company", "Company"),
    }
    counters |= {f"hits: {label}": F.count_if(F.array_contains("flags", label))
                 for label in FLAG_ORDER}
    one = work.agg(*[c.alias(f"c{i}") for i, c in enumerate(counters.values())])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("counter"), F.col(f"c{i}").alias("value"))
        for i, name in enumerate(counters)])))


def preserved_statuses(work: DataFrame, n: int = 6) -> DataFrame:
    """One row: how many custom statuses were kept, and the first ``n`` A-Z."""
    from ..functions.text import known_status

    custom = (work.filter(known_status(F.col("_status")).isNull() & ~F.col("_status_blank"))
              .groupBy("Status").agg(_rows().alias("_rows")))
    first = custom.orderBy("Status").limit(n).agg(
        F.array_sort(F.collect_list("Status")).alias("examples"))
    return _one_row(custom.agg(_rows().alias("preserved")), first)


# Flag labels raised by each rule, to show a rule's hits next to it.
RULE_FLAGS = {
    "R04": ("INVALID DATE",), "R06": ("MISSING ID",), "R08": ("UNASSIGNED",),
    "R09": ("INVALID AMOUNT",), "R10": ("NEGATIVE AMOUNT", "ZERO AMOUNT", "BELOW THRESHOLD"),
    "R12": ("RECON MISMATCH", "DUPLICATE ENTRY"), "R13": ("INVALID VAT NUMBER",),
    "R14": ("APPROVAL REQUIRED",), "R15": ("CREDIT LIMIT BREACH",),
    "R17": ("SAME-DAY DUPLICATE",), "R19": ("NO CONTACT DETAILS",),
    "R20": ("RESTRICTED ENTITY",), "R21": ("INCOMPLETE ADDRESS",),
    "R22": ("FUTURE DATE", "STALE DATE"),
}


def rules_applied(clean: DataFrame, applied: list[str], enabled=None,
                  mapped=None) -> DataFrame:
    """The rule catalogue against a run: applied or not, and flags raised."""
    hits = clean.agg(*[F.count_if(F.array_contains("flags", label)).alias(label)
                       for label in FLAG_ORDER])
    enabled = enabled or {}
    rows = []
    for r in RULES:
        raised = reduce(lambda a, b: a + b, [quoted(x) for x in RULE_FLAGS.get(r.code, ())],
                        F.lit(0).cast("bigint"))
        rows.append(F.struct(
            F.lit(r.code).alias("Code"), F.lit(r.name).alias("Rule"),
            F.lit(r.category).alias("Category"), F.lit(r.severity.split(" (")[0]).alias("Severity"),
            F.lit(enabled.get(r.code, r.default)).alias("Enabled"),
            F.lit(True if mapped is None else r.applies(mapped)).alias("Applicable"),
            F.lit(r.code in applied).alias("Applied"), raised.alias("Flags_Raised")))
    return hits.select(F.inline(F.array(*rows)))


def severity_census(findings: DataFrame) -> DataFrame:
    return findings.groupBy("Severity").agg(_rows().alias("Findings"))


def history_metrics(history: DataFrame) -> DataFrame:
    """Runs, rows, errors and means over the run history."""
    return history.agg(
        _rows().alias("runs"), F.sum("Rows Out").alias("rows_processed"),
        F.sum("Flagged").alias("errors_caught"),
        (F.rint(F.avg("Health %") * 10) / 10).alias("mean_health"),
        cents(F.avg("Seconds")).alias("mean_seconds"))
