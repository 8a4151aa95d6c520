"""Quality findings, row issues and totals from a profile.

The profile already holds what column findings need, so they are literals; the
row labels are one projection, and only duplicate rows need a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (CATEGORICAL, DATETIME, EMPTY, HIGH, LOW, MEDIUM, NUMERIC,
                         OUTLIER_MIN_VALUES, TEXT, Options)
from ..functions.text import is_blank, labels, quoted
from .keyed import check_order, mark_repeats, repeat_facts, row_digest
from .profile import VALUE, ColumnProfile, Profile, standard_cell, with_values
from .staging import settle

FINDING = ("`Column` string, `Type` string, `Issue` string, `Rows` bigint, `% of File` double, "
           "`Severity` string")
SEVERITY_RANK = {HIGH: 0, MEDIUM: 1, LOW: 2}
OUTLIER = "OUTLIER: "


def outlier_test(value: Column, p: ColumnProfile, sigma: float) -> Column | None:
    """Outside three quartile ranges, or further than ``sigma`` deviations from
    the mean; literals from the profile, so neither join nor window."""
    s = p.stats
    if not s or s["count"] < OUTLIER_MIN_VALUES:
        return None
    tests = []
    spread = s["q3"] - s["q1"]
    if spread > 0:
        tests.append((value < s["q1"] - 3 * spread) | (value > s["q3"] + 3 * spread))
    if s["std"] > 0:
        tests.append(F.abs(value - s["mean"]) > sigma * s["std"])
    if not tests:
        return None
    test = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return F.coalesce(test, F.lit(False))


def issue_tests(df: DataFrame, prof: Profile, o: Options) -> dict[str, Column]:
    """Label -> condition, in column order; only labels that can occur. Reads
    the columns of ``with_values``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    tests: dict[str, Column] = {}
    for p in prof.columns:
        blank = is_blank(quoted(p.name), types[p.name])
        if p.nulls and o.flag_nulls and p.type != EMPTY:
            tests[f"NULL: {p.name}"] = blank
        if p.unparsed:
            kind = "DATE" if p.type == DATETIME else "NUMBER"
            tests[f"BAD {kind}: {p.name}"] = quoted(VALUE + p.name).isNull() & ~blank
        if p.type == NUMERIC and o.flag_outliers:
            test = outlier_test(quoted(VALUE + p.name), p, o.outlier_sigma)
            if test is not None:
                tests[OUTLIER + p.name] = test
    return tests


@dataclass(frozen=True)
class AuditResult:
    rows: DataFrame        # the audited rows with `issues array<string>`
    findings: DataFrame
    totals: DataFrame


def label_rows(df: DataFrame, prof: Profile, o: Options) -> tuple[DataFrame, DataFrame]:
    """``df`` with its parsed values plus ``issues``: the labels of each row in
    finding order; and the same rows as ``mark_later_copies`` tells of them.
    Duplicates are judged on the standardised row."""
    if o.order_by is None:
        raise ValueError("the duplicate-row check needs Options.order_by")
    valued = with_values(df, prof.types, o)
    tests = issue_tests(df, prof, o)
    valued, told = mark_later_copies(valued, prof, o, tests)
    slots = [*tests.items(), ("DUPLICATE ROW", F.col("_repeat"))]
    return valued.withColumn("issues", labels(slots)).drop("_repeat"), told


def mark_later_copies(valued: DataFrame, prof: Profile, o: Options,
                      tests: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Boolean ``_repeat`` on every later copy of a row, and a narrow table of the rows: ``_repeat``,
    ``issue`` where one of ``tests`` holds, and each outlier's test by its number, so that what they
    count needs no second parse. Groups are found on a narrow (order key, digest) table; the few later
    copies come back by their unique order key, which no hot group can skew."""
    key = quoted(o.order_by)
    found = [reduce(lambda a, b: a | b, tests.values(), F.lit(False)).alias("issue")]
    found += [test.alias(f"o{i}") for i, test in enumerate(
        t for label, t in tests.items() if label.startswith(OUTLIER))]
    told = "_told"
    while told in valued.columns:
        told += "_"
    rows = valued.select(key, *[standard_cell(p.name, p.type) for p in prof.columns],
                         F.struct(*found).alias(told))
    narrow = rows.select(key, row_digest(rows, [p.name for p in prof.columns]).alias("_digest"),
                         F.col(told).alias("_told"))
    narrow = settle(narrow).df
    seen = narrow.select(key.alias("_key"), "_told.*")
    facts = repeat_facts(narrow, ["_digest"], o.order_by)
    if facts.rows == 0:
        return tuple(t.withColumn("_repeat", F.lit(False)) for t in (valued, seen))
    later = mark_repeats(narrow, ["_digest"], o.order_by, "_repeat", facts).filter("_repeat")
    settled = settle(later.select(key.alias("_later")))
    check_order({"_repeat": settled.rows}, {"_repeat": facts}, 0)
    side = F.broadcast(settled.df) if settled.broadcastable else settled.df

    def marked(df, by):
        out = df.join(side, by == F.col("_later"), "left")
        return out.withColumn("_repeat", F.col("_later").isNotNull()).drop("_later")

    return marked(valued, key), marked(seen, F.col("_key"))


def column_findings(prof: Profile, rows: int, outliers: dict[str, int],
                    o: Options) -> list[tuple]:
    """Findings that follow from the profile, in column order."""
    out = []

    def add(p, issue, n, severity, pct=None):
        share = round(n / max(rows, 1) * 100 if pct is None else pct, 1)
        out.append((p.name, p.type, issue, n, float(share), severity))

    for p in prof.columns:
        if p.nulls:
            grade = HIGH if p.null_pct > 20 else MEDIUM if p.null_pct > 5 else LOW
            add(p, "Missing values", p.nulls, grade, p.null_pct)
        if p.type == EMPTY:
            add(p, "Column is entirely empty", rows, HIGH, 100.0)
            continue
        if p.unique == 1 and p.non_null > 1:
            add(p, f"Constant value ('{p.mode}')", p.non_null, LOW)
        if p.unparsed:
            issue = ("Inconsistent date strings" if p.type == DATETIME
                     else "Non-numeric values in a numeric column")
            add(p, issue, p.unparsed, HIGH)
        if outliers.get(p.name):
            add(p, f"Severe numeric outliers (>{o.outlier_sigma:g} SD or 3x IQR)",
                outliers[p.name], MEDIUM)
        if p.type in (CATEGORICAL, TEXT) and p.unique > p.folded:
            add(p, "Inconsistent casing / spacing in labels", p.unique - p.folded, MEDIUM)
    return out


def audit(df: DataFrame, prof: Profile, o: Options) -> AuditResult:
    """Findings, labelled rows and totals. One aggregate over the narrow rows
    counts outliers, duplicates and affected rows together."""
    spark = df.sparkSession
    labelled, told = label_rows(df, prof, o)
    tested = [c[len(OUTLIER):] for c in issue_tests(df, prof, o) if c.startswith(OUTLIER)]
    counted = told.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("issue") | F.col("_repeat")).alias("affected"),
        F.count_if("_repeat").alias("duplicates"),
        *[F.count_if(f"o{i}").alias(f"o{i}") for i in range(len(tested))]).first()
    outliers = {c: counted[f"o{i}"] for i, c in enumerate(tested)}
    rows, duplicates = counted["rows"], counted["duplicates"]
    found = column_findings(prof, rows, outliers, o)
    if duplicates:
        found.append(("(whole row)", "-", "Duplicate rows", duplicates,
                      round(duplicates / max(rows, 1) * 100, 1), HIGH))
    found.sort(key=lambda f: (SEVERITY_RANK[f[5]], -f[3]))
    width = len(prof.columns)
    totals = spark.createDataFrame(
        [(rows, width, len(found), counted["affected"], rows - counted["affected"],
          (rows - counted["affected"]) / max(rows, 1) * 100, duplicates, rows * width,
          sum(p.nulls for p in prof.columns))],
        "rows bigint, columns bigint, issue_count bigint, rows_affected bigint, "
        "rows_clean bigint, health double, duplicate_rows bigint, total_cells bigint, "
        "missing_cells bigint")
    return AuditResult(labelled, spark.createDataFrame(found, FINDING), totals)
