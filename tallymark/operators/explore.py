"""Filters, search, preview and badges over a clean table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (HELPER_COLUMNS, PREVIEW_COLUMNS, PREVIEW_ROWS, RAW_PREVIEW_ROWS)
from ..functions import text
from ..functions.text import as_text, quoted

BOOKKEEPING = (*HELPER_COLUMNS, "flags", "issues")


def filter_category(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.filter(quoted(column).cast("string") == value)


def category_column(df: DataFrame, types: dict[str, str]) -> str | None:
    """Status where there is one, else the first categorical column."""
    if "Status" in df.columns:
        return "Status"
    return next((c for c in df.columns if types.get(c) == "Categorical"), None)


def filter_choices(df: DataFrame, column: str) -> DataFrame:
    """The distinct values, canonical statuses first, then A-Z."""
    values = df.select(quoted(column).cast("string").alias("value")).distinct()
    return values.orderBy(text.status_rank(F.col("value")), "value")


def filter_view(df: DataFrame, view: str = "all") -> DataFrame:
    """all, flagged or clean rows."""
    return {"all": df, "flagged": df.filter("Flagged"), "clean": df.filter("NOT Flagged")}[view]


def _shown(df: DataFrame, ledger: list[str]) -> list[str]:
    """The ledger's columns where the table is one (it has flags), else all data columns."""
    if "flags" in df.columns:
        return ledger
    return [c for c in df.columns if c not in BOOKKEEPING]


def search(df: DataFrame, needle: str, columns: list[str] | None = None) -> DataFrame:
    """Rows holding the text, whatever its case, in any searched column; by
    default those of the ledger preview, or all data columns of another table."""
    wanted = columns if columns is not None else _shown(df, [*PREVIEW_COLUMNS, "Reference"])
    found = [c for c in wanted if c in df.columns]
    needle = needle.strip().lower()
    types = {f.name: f.dataType for f in df.schema.fields}
    hits = [F.lower(as_text(quoted(c), types[c])).contains(needle) for c in found]
    return df.filter(reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), hits, F.lit(False)))


def highlight(df: DataFrame) -> Column:
    """Flagged or in need of review."""
    return F.coalesce(F.col("Flagged"), F.lit(False)) | F.coalesce(F.col("Needs_Review"),
                                                                   F.lit(False))


def preview(df: DataFrame, order_by: str, limit: int = PREVIEW_ROWS,
            columns: list[str] | None = None, bank_recon: bool = True) -> DataFrame:
    """The first rows in ``order_by``, preview columns only (a top-k, not a sort);
    of a table that is no ledger, all data columns."""
    ledger = [c for c in PREVIEW_COLUMNS if c != "Recon_Status" or bank_recon]
    wanted = columns or [c for c in _shown(df, ledger) if c != order_by]
    shown = [c for c in wanted if c in df.columns]
    keys = list(dict.fromkeys([order_by, *shown]))
    return (df.select(*[quoted(c) for c in keys]).orderBy(quoted(order_by)).limit(limit)
            .select(*[quoted(c) for c in shown]))


def raw_preview(df: DataFrame, order_by: str, limit: int = RAW_PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(quoted(order_by)).limit(limit)


def note_view(df: DataFrame) -> DataFrame:
    """Notes split into known flags and free text, with the row's badges."""
    tokens = text.note_tokens(F.col("Notes"))
    return df.withColumns({
        "Known_Flags": text.known_flag_tokens(tokens),
        "Free_Text": text.free_text_tokens(tokens),
        "Badge": text.row_badge(F.col("Flagged"), F.col("Needs_Review")),
        "Status_Badge": text.status_badge(F.col("Status")),
    })


def rule_catalogue(rules: DataFrame, category: str | None = None, severity: str | None = None,
                   state: str | None = None, needle: str = "") -> DataFrame:
    """Rows of ``report.rules_applied`` by category, severity, state and text."""
    out = rules
    if category:
        out = out.filter(F.col("Category") == category)
    if severity:
        out = out.filter(F.col("Severity") == severity.split(" (")[0])
    if state:
        out = out.filter(F.col("Enabled") == (state == "enabled"))
    needle = needle.strip().lower()
    if needle:
        out = out.filter(F.lower("Rule").contains(needle) | F.lower("Code").contains(needle))
    return out.orderBy("Code")


def catalogue_tally(rules: DataFrame, shown: DataFrame) -> DataFrame:
    """Shown, enabled and disabled rules."""
    counts = rules.agg(F.count_if("Enabled").alias("enabled"),
                       F.count_if(~F.col("Enabled")).alias("disabled"))
    listed = shown.agg(F.count(F.lit(1)).alias("shown"))
    both = counts.unionByName(listed, allowMissingColumns=True)
    return both.agg(F.max("shown").alias("shown"), F.max("enabled").alias("enabled"),
                    F.max("disabled").alias("disabled"))
