"""Row rules as a table of predicates, turned into one projection.

Each entry yields the condition under which its label is attached, or None when
the rule does not run. The labels of a row are one array in catalogue order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import datetime as dt

from pyspark.sql import Column, functions as F

from ..constants import CRITICAL_FLAGS, FLAG_ORDER, RULES, Options
from ..functions import text
from ..functions.text import is_missing, strip

NEVER = None


@dataclass(frozen=True)
class Context:
    """What a predicate may look at: options and which columns are mapped."""

    options: Options
    mapped: frozenset[str]

    def runs(self, code: str) -> bool:
        """Enabled and, for R13 on, its columns are in the file. The earlier
        rules read canonical columns that always exist."""
        info = next(r for r in RULES if r.code == code)
        always = code <= "R12"
        return self.options.on(code) and (always or info.applies(self.mapped))


Predicate = Callable[[Context], Column | None]


def _when(test, column: Callable[[Context], Column]) -> Predicate:
    return lambda ctx: column(ctx) if test(ctx) else NEVER


def _no_contact(ctx: Context) -> Column:
    email = is_missing(F.col("Email")) if "Email" in ctx.mapped else F.lit(True)
    phone = is_missing(F.col("Phone")) if "Phone" in ctx.mapped else F.lit(True)
    return email & phone


def _without_space(ctx: Context, name: str) -> Column:
    """A cell without white space; R01 leaves no other than plain spaces."""
    if ctx.options.on("R01"):
        return F.replace(F.col(name), F.lit(" "), F.lit(""))
    return text.replace_space(F.col(name), "S", "")


def _bad_address(ctx: Context) -> Column:
    bad = F.lit(False)
    if "Postal_Code" in ctx.mapped:
        code = _without_space(ctx, "Postal_Code")
        bad = bad | ~F.coalesce(code.rlike(r"^\d{4,10}$"), F.lit(False))
    if "Address" in ctx.mapped:
        address = F.col("Address") if ctx.options.on("R01") else strip(F.col("Address"))
        bad = bad | (F.length(F.coalesce(address, F.lit(""))) < 8)
    return bad


def _bad_tax_number(ctx: Context) -> Column:
    number = F.replace(_without_space(ctx, "VAT_Number"), F.lit("-"), F.lit(""))
    return ~is_missing(number) & ~number.rlike(r"^\d{9,15}$")


def _day(ctx: Context, days: int) -> Column:
    return F.lit(ctx.options.today() + dt.timedelta(days=days))


# Label -> predicate. Columns starting with "_" are prepared by the ledger plan.
PREDICATES: dict[str, Predicate] = {
    "INVALID DATE": _when(lambda c: c.runs("R04") and c.options.flag_bad_dates,
                          lambda c: F.col("_date").isNull()),
    "MISSING ID": _when(lambda c: c.runs("R06") and c.options.flag_missing_id,
                        lambda c: is_missing(F.col("Client_ID"))),
    "UNASSIGNED": _when(lambda c: c.runs("R08") and c.options.flag_missing_status,
                        lambda c: F.col("_status_blank")),
    "INVALID AMOUNT": _when(lambda c: c.runs("R09"), lambda c: F.col("_amount").isNull()),
    "NEGATIVE AMOUNT": _when(lambda c: c.runs("R10") and c.options.flag_nonpositive,
                             lambda c: F.col("Amount") < 0),
    "ZERO AMOUNT": _when(lambda c: c.runs("R10") and c.options.flag_nonpositive,
                         lambda c: F.col("Amount") == 0),
    "BELOW THRESHOLD": _when(
        lambda c: c.runs("R10") and c.options.flag_nonpositive and c.options.min_amount > 0,
        lambda c: (F.col("Amount") > 0) & (F.col("Amount") < float(c.options.min_amount))),
    "RECON MISMATCH": _when(lambda c: c.runs("R12") and c.options.bank_recon,
                            lambda c: (F.col("Status") == "PAID") & (F.col("Amount") <= 0)),
    "DUPLICATE ENTRY": _when(
        lambda c: c.runs("R12") and c.options.flag_duplicates and not c.options.drop_duplicates,
        lambda c: F.col("_duplicate")),
    "INVALID VAT NUMBER": _when(lambda c: c.runs("R13"), _bad_tax_number),
    "APPROVAL REQUIRED": _when(lambda c: c.runs("R14") and c.options.high_value > 0,
                               lambda c: F.col("Amount") > float(c.options.high_value)),
    "CREDIT LIMIT BREACH": _when(
        lambda c: c.runs("R15"), lambda c: F.col("_breach")),
    "SAME-DAY DUPLICATE": _when(lambda c: c.runs("R17"), lambda c: F.col("_same_day")),
    "NO CONTACT DETAILS": _when(lambda c: c.runs("R19"), _no_contact),
    "RESTRICTED ENTITY": _when(
        lambda c: c.runs("R20") and c.options.restricts(),
        lambda c: F.upper(F.col("Client_ID")).isin(*c.options.blocked_ids()) | F.col("_listed")),
    "INCOMPLETE ADDRESS": _when(lambda c: c.runs("R21"), _bad_address),
    "FUTURE DATE": _when(lambda c: c.runs("R22"),
                         lambda c: F.col("_date") > _day(c, c.options.date_horizon)),
    "STALE DATE": _when(lambda c: c.runs("R22"),
                        lambda c: F.col("_date") < _day(c, -(c.options.stale_days or 1095))),
}


def flags_column(ctx: Context, labels=FLAG_ORDER) -> Column:
    """The labels whose predicate holds, in order, as array<string>."""
    slots = [(label, PREDICATES[label](ctx)) for label in labels]
    slots = [(label, p) for label, p in slots if p is not None]
    return text.labels(slots) if slots else F.array().cast("array<string>")


def is_blocked(flags: Column) -> Column:
    return F.arrays_overlap(flags, F.array(*[F.lit(x) for x in CRITICAL_FLAGS]))


def restricted_entities(df, blocked, key: str = "Client_ID"):
    """Rows whose client is in a blocklist table of any size."""
    known = df.filter(F.col(key) != "")
    return known.join(listed_ids(blocked), F.upper(F.col(key)) == F.col("_listed_id"), "left_semi")


def listed_ids(blocked):
    """The ids of a blocklist table (its first column), trimmed and upper-cased;
    blank lines list nobody."""
    ids = blocked.select(F.upper(strip(F.col(blocked.columns[0]))).alias("_listed_id"))
    return ids.filter("_listed_id != ''").distinct()


def applied_rules(ctx: Context) -> list[str]:
    """Codes that ran, by the options' and the file's leave."""
    o = ctx.options
    gate = {"R04": o.flag_bad_dates, "R06": o.flag_missing_id, "R08": o.flag_missing_status,
            "R10": o.flag_nonpositive, "R14": o.high_value > 0, "R20": o.restricts()}
    return [r.code for r in RULES if ctx.runs(r.code) and gate.get(r.code, True)]
