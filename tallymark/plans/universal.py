"""The universal run: any table, types found in its values."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F, types as T

from ..constants import PREVIEW_ROWS, Options
from ..functions import text
from ..functions.text import quoted
from ..operators import explore, report
from ..operators.audit import AuditResult, audit
from ..operators.profile import Profile, profile, standard_cell, standardise
from ..operators.schema import clean_headers
from ..operators.staging import collected, discard, settle
from .ledger import not_blank


def sanitise(df: DataFrame, o: Options) -> DataFrame:
    """Headers stripped, text columns cleaned, blank rows dropped. Typed
    columns are left as they are."""
    df = not_blank(clean_headers(df), o)
    strings = {f.name for f in df.schema.fields
               if isinstance(f.dataType, T.StringType) and f.name != o.order_by}
    cells = [(text.tidy(quoted(c)) if c in strings else quoted(c)).alias(c) for c in df.columns]
    final = [(text.null_words(quoted(c)) if c in strings else quoted(c)).alias(c)
             for c in df.columns]
    return df.select(*cells).select(*final)


@dataclass(frozen=True)
class UniversalRun:
    options: Options
    raw: DataFrame
    filled: DataFrame
    profile: Profile
    audit: AuditResult
    clean: DataFrame
    notes_column: str
    mode: str = "universal"
    mapping: dict | None = None
    staged: list[str] = field(default_factory=list, repr=False)

    def breakdown(self) -> DataFrame:
        return report.flag_breakdown(self.clean, "issues")

    def metrics(self) -> DataFrame:
        raw = self.raw.agg(F.count(F.lit(1)).alias("rows_in"))
        o = self.options
        return report._one_row(raw, self.audit.totals).select(
            F.lit("universal").alias("mode"), "rows_in", F.col("rows").alias("rows_out"),
            (F.col("rows_in") - F.col("rows")).alias("blank_dropped"),
            F.lit(0).cast("bigint").alias("dup_dropped"),
            F.col("rows_affected").alias("flagged"), F.col("rows_clean").alias("clean"),
            "health", "columns", "total_cells", "missing_cells", "duplicate_rows",
            F.lit(self.profile.numeric_total).alias("numeric_total"),
            F.col("issue_count").alias("rule_count"),
            F.lit(float(o.vat_rate)).alias("vat_rate"))

    def settled(self) -> UniversalRun:
        """The run with its clean table written once, for exports."""
        with collected() as paths:
            done = settle(self.clean).df
        self.staged.extend(paths)
        return replace(self, clean=done)

    def close(self) -> None:
        """Drop the tables that the run has settled."""
        discard(self.clean.sparkSession, self.staged)

    def _data(self) -> list[str]:
        return [c for c in self.display.columns if c != self.notes_column] + [self.notes_column]

    def search(self, needle: str) -> DataFrame:
        """Rows that hold the text in a data column or the notes."""
        return explore.search(self.clean, needle, self._data())

    def preview(self, limit: int = PREVIEW_ROWS) -> DataFrame:
        """The first rows: all data columns and the notes."""
        return explore.preview(self.clean, self.options.order_by, limit, self._data())

    @property
    def display(self) -> DataFrame:
        drop = ["Flagged", "Flag_Count", "Needs_Review", "issues"]
        drop += [self.options.order_by] if self.options.order_by else []
        return self.clean.drop(*drop)


def run_universal(df: DataFrame, o: Options) -> UniversalRun:
    """Clean, profile, standardise and audit. The audit looks at the cells as
    cleaned, so bad dates and numbers show; ``strict_compat`` audits the
    standardised table, where they already count as missing."""
    o = o.resolved()
    with collected() as paths:
        # cleaned once: the profile, the audit and the result read what is written here
        ready = sanitise(df, o)
        void = [f.name for f in ready.schema.fields if isinstance(f.dataType, T.NullType)]
        cleaned = settle(ready.drop(*void))
        if not cleaned.rows:
            discard(df.sparkSession, paths)
            raise ValueError("no data rows: the table is empty, or every row is blank")
        filled = cleaned.df.withColumns({c: F.lit(None) for c in void}).select(
            *[quoted(c) for c in ready.columns])
        prof = profile(filled, o)
        subject = filled
        if o.strict_compat:
            subject = standardise(filled, prof.types, o)
            prof = profile(subject, o)
        result = audit(subject, prof, o)
    rows = result.rows
    # Review words are looked for in the source's own texts.
    texts = [c for c in ("Status", "Notes") if c in filled.columns] or [
        f.name for f in filled.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name != o.order_by]
    notes = "Notes" if "Notes" not in filled.columns or o.strict_compat else "_issues"
    composed = F.array_join("issues", " | ")
    if o.strict_compat and "Status" not in filled.columns:
        review = text.needs_review(composed)
    else:
        review = text.needs_review(*[quoted(c) for c in texts])
    verdicts = rows.withColumns({
        "_note": composed, "Flagged": F.size("issues") > 0, "Flag_Count": F.size("issues"),
        "_review": review})
    data = [c for c in filled.columns if c not in (o.order_by, notes)]
    kinds = prof.types
    final = [*[standard_cell(c, kinds.get(c)) for c in data], F.col("_note").alias(notes),
             "Flagged", "Flag_Count", F.col("_review").alias("Needs_Review"), "issues"]
    final += [quoted(o.order_by)] if o.order_by else []
    return UniversalRun(o, df, filled, prof, result, verdicts.select(*final), notes,
                        staged=paths)
