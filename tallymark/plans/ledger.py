"""The ledger run: map, clean, check, flag and total a transaction table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from ..constants import (CANONICAL, HELPER_COLUMNS, LEADING_COLUMNS, RECON_NO, RECON_NONE,
                         RECON_YES, Options)
from ..functions import dates, numbers, text
from ..functions.text import quoted
from ..operators import report, rules
from ..operators.audit import AuditResult, audit
from ..operators.keyed import (GROUP_ROWS, attach, check_order, exposure_facts, mark_repeats,
                               rolled_facts)
from ..operators.marks import Marks, settle_marks
from ..operators.profile import Profile, profile
from ..operators.schema import MappedTable, map_columns
from ..operators.staging import Settled, collected, discard, settle
from ..operators.summary import Summary, summarise

TYPED_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def scrub(df: DataFrame, o: Options) -> DataFrame:
    """R01 on every column but Amount; a typed date keeps its type."""
    cells, final = [], []
    for f in df.schema.fields:
        c = quoted(f.name)
        typed_date = f.name == "Date" and isinstance(f.dataType, TYPED_DATES)
        if f.name in (o.order_by, "Amount") or typed_date:
            cells.append(c)
            final.append(c)
        else:
            cell = text.as_text(c, f.dataType)
            wordy = o.on("R01") and text.holds_text(f.dataType)
            if isinstance(f.dataType, T.FractionalType) and o.on("R01"):
                cell = F.when(~text.is_blank(c, f.dataType), cell)
            cells.append((text.tidy(cell) if wordy else cell).alias(f.name))
            final.append((text.null_words(c) if wordy else c).alias(f.name))
    return df.select(*cells).select(*final)


def not_blank(df: DataFrame, o: Options) -> DataFrame:
    """Drop the rows whose data columns are all blank. The test runs on
    the cells as read, before any cleaning; the columns filled most lead, so a
    normal row is settled by its first cell."""
    if not o.on("R02"):
        return df
    fields = sorted((f for f in df.schema.fields if f.name != o.order_by),
                    key=lambda f: f.name not in ("Amount", "Date"))
    test = {f.name: text.is_blank_once_clean if o.on("R01") and f.name != "Amount"
            else text.is_blank for f in fields}
    blank = [test[f.name](quoted(f.name), f.dataType) for f in fields]
    return df.filter(~reduce(lambda a, b: a & b, blank))


def repair(df: DataFrame, mapped: frozenset[str], o: Options) -> DataFrame:
    """Row-local repairs. Working columns start with '_'."""
    types = {f.name: f.dataType for f in df.schema.fields}
    tidy = o.on("R01")      # of every column but Amount, see ``scrub``
    parsed_date = dates.parse_date(F.col("Date"), types["Date"], o.dayfirst, o.today().year, tidy)
    parsed = df.withColumns({
        "_date": parsed_date,
        "_amount": numbers.parse_amount(F.col("Amount"), types["Amount"]),
        "_limit": numbers.parse_amount(F.col("Credit_Limit"), is_tidy=tidy),
        "_status": F.col("Status"), "_email": F.col("Email"), "_phone": F.col("Phone"),
        "_company": F.col("Company"),
    })
    fixed = {
        "Date": dates.iso_text(F.col("_date")) if o.on("R03") else F.col("Date").cast("string"),
        "_status_blank": text.is_missing(F.col("_status") if tidy else text.strip(F.col("_status"))),
        "Amount": numbers.cents(F.coalesce(F.col("_amount"), F.lit(0.0))),
        "Notes": F.coalesce(F.col("Notes") if tidy else text.strip(F.col("Notes")), F.lit("")),
    }
    if o.on("R05"):
        fixed |= {"Client_ID": text.client_id(F.col("Client_ID"), tidy),
                  "Reference": text.reference(F.col("Reference"), tidy)}
    fixed["Status"] = (text.status(F.col("Status"), tidy) if o.on("R07")
                       else F.coalesce(F.col("Status"), F.lit("")))
    ctx = rules.Context(o, mapped)
    if ctx.runs("R16"):
        if "Email" in mapped:
            fixed["Email"] = text.email(F.col("Email"), tidy)
        if "Phone" in mapped:
            fixed["Phone"] = text.phone(F.col("Phone"), o.country_code)
    if ctx.runs("R18"):
        fixed["Company"] = text.proper_name(F.col("Company"), tidy)
    out = parsed.withColumns(fixed)
    if o.on("R11"):
        out = out.withColumn("VAT_15", numbers.cents(F.col("Amount") * float(o.vat_rate)))
        out = out.withColumn("Total_Inc_VAT", numbers.cents(F.col("Amount") + F.col("VAT_15")))
    else:
        out = out.withColumns({"VAT_15": F.lit(0.0), "Total_Inc_VAT": F.col("Amount")})
    if o.bank_recon and "Reference" in mapped and o.on("R12"):
        recon = F.when(text.is_missing(F.col("Reference")), RECON_NO).otherwise(RECON_YES)
    else:
        recon = F.lit(RECON_NONE)
    return out.withColumn("Recon_Status", recon)


ENTRY = ["Date", "Client_ID", "Amount", "Reference"]
DAY = ["_date", "_client", "Amount"]
MARKS = ("_duplicate", "_same_day", "_breach", "_listed")


def _wants(ctx: rules.Context) -> dict[str, bool]:
    o = ctx.options
    return {"_duplicate": ctx.runs("R12") and (o.drop_duplicates or o.flag_duplicates),
            "_same_day": ctx.runs("R17"), "_breach": ctx.runs("R15")}


def cross_groups(rows: DataFrame, o: Options) -> DataFrame:
    """Equal entries as one row each: first order key, rows, least positive
    limit. The keys of R17 and R15 are coarser, so their facts follow from it:
    this is the one shuffle of the rows."""
    first = F.min(quoted(o.order_by)) if o.order_by else F.lit(None).cast("bigint")
    limit = F.min(F.when(F.col("_limit") > 0, F.col("_limit")))
    return rows.groupBy(*ENTRY, "_date", "_client").agg(
        first.alias("_first"), F.count(F.lit(1)).alias(GROUP_ROWS), limit.alias("_least"))


def merged_groups(groups: DataFrame) -> DataFrame:
    """The groups of several batches as one."""
    return groups.groupBy(*ENTRY, "_date", "_client").agg(
        F.min("_first").alias("_first"), F.sum(GROUP_ROWS).alias(GROUP_ROWS),
        F.min("_least").alias("_least"))


def cross_facts(groups: DataFrame, wants: dict[str, bool], o: Options) -> dict[str, Settled]:
    """Facts of R12b, R17 and R15 from ``cross_groups`` (settled)."""
    facts = {}
    if wants["_duplicate"]:
        facts["_duplicate"] = settle(groups.select(*ENTRY, "_first", GROUP_ROWS)
                                     .filter(F.col(GROUP_ROWS) > 1), weight=GROUP_ROWS)
    left = groups.withColumn(GROUP_ROWS, F.lit(1).cast("bigint")) if o.drop_duplicates else groups
    if wants["_same_day"]:
        facts["_same_day"] = rolled_facts(left, DAY)
    if wants["_breach"]:
        facts["_breach"] = exposure_facts(left, "_client", "Amount", "_least", "_exposure")
    return facts


def no_marks(rows: DataFrame) -> DataFrame:
    return rows.withColumns({name: F.lit(False) for name in MARKS})


def add_marks(rows: DataFrame, facts: dict[str, Settled], o: Options) -> DataFrame:
    """_duplicate, _same_day and _breach of every row, from the groups' facts."""
    rows = rows.withColumns({name: F.lit(False) for name in MARKS[:3]})
    for name, keys in (("_duplicate", ENTRY), ("_same_day", DAY)):
        if name in facts:
            rows = mark_repeats(rows, keys, o.order_by, name, facts[name])
    if "_breach" in facts:
        spread = quoted(o.order_by) if o.order_by else F.xxhash64("_client", "Amount")
        rows = attach(rows, facts["_breach"], ["_client"], ["_exposure"], spread)
        over = (F.col("_limit") > 0) & (F.col("_exposure") > F.col("_limit"))
        rows = rows.withColumn("_breach", F.coalesce(over, F.lit(False))).drop("_exposure")
    return rows


def check_marks(marks: Marks, facts: dict[str, Settled], o: Options) -> None:
    """Raises where the order key does not order the rows."""
    repeats = {k: f for k, f in facts.items() if k == "_duplicate"
               or k == "_same_day" and not o.drop_duplicates}
    check_order({k: marks.counts[k] for k in repeats}, repeats, marks.nulls)


def mark_listed(df: DataFrame, narrow: DataFrame, o: Options) -> DataFrame:
    """_listed: the client is in the blocklist table."""
    if o.blocklist is None:
        return df.withColumn("_listed", F.lit(False))
    upper = F.upper("_client")
    clients = narrow.filter("_client != ''").groupBy(upper.alias("_id")).agg(
        F.count(F.lit(1)).alias(GROUP_ROWS))
    listed = clients.join(rules.listed_ids(o.blocklist), F.col("_id") == F.col("_listed_id"))
    facts = settle(listed.select("_id", F.lit(True).alias("_listed"), GROUP_ROWS), GROUP_ROWS)
    spread = quoted(o.order_by) if o.order_by else F.xxhash64("_client", "Amount")
    out = attach(df.withColumn("_id", upper), facts, ["_id"], ["_listed"], spread)
    return out.withColumn("_listed", F.coalesce("_listed", F.lit(False))).drop("_id")


def cross_row(df: DataFrame, mapped: frozenset[str], o: Options, local_only=False,
              counted: list[int] | None = None) -> DataFrame:
    """Facts about a row's group or client. With
    ``local_only`` (a plain stream) the columns exist and never fire.

    Group facts need few columns. Those are parsed once, into a narrow table; it
    is marked, and the marks alone meet the wide rows, once. ``counted`` takes the
    number of its rows, before any drop."""
    ctx = rules.Context(o, mapped)
    df = df.withColumn("_client", F.coalesce(F.col("Client_ID"), F.lit("")))
    wants = _wants(ctx)
    if local_only:
        return no_marks(df)
    if (wants["_duplicate"] or wants["_same_day"]) and o.order_by is None:
        raise ValueError("duplicate rules need Options.order_by: a unique column that says "
                         "which of several equal rows came first")
    if not any(wants.values()) and o.blocklist is None:
        demand_rows(not df.isEmpty())
        return no_marks(df)
    order = [quoted(o.order_by)] if o.order_by else []
    narrow = settle(df.select(*ENTRY, "_date", "_client", "_limit", *order))
    demand_rows(narrow.rows)
    if counted is not None:
        counted.append(narrow.rows)
    facts = {}
    if any(wants.values()):
        facts = cross_facts(settle(cross_groups(narrow.df, o)).df, wants, o)
    if o.order_by is None:
        return mark_listed(add_marks(df, facts, o), narrow.df, o)
    marked = mark_listed(add_marks(narrow.df, facts, o), narrow.df, o)
    marks = settle_marks(marked, list(MARKS), o.order_by)
    check_marks(marks, facts, o)
    df = marks.bring(df, o.order_by)
    return df.filter(~F.col("_duplicate")) if o.drop_duplicates else df


def demand_rows(found) -> None:
    if not found:
        raise ValueError("no data rows: the table is empty, or every row is blank")


def judge(df: DataFrame, mapped: frozenset[str], o: Options) -> DataFrame:
    """Attach the flags and the verdict columns, blank out the null texts."""
    return judge_rows(df.withColumn("flags", rules.flags_column(rules.Context(o, mapped))))


def judge_rows(flagged: DataFrame) -> DataFrame:
    """The verdict columns of rows that have their flags."""
    return flagged.withColumns({
        "Needs_Review": text.needs_review(F.col("Status"), F.col("Notes")),
        "Notes": text.compose_notes(F.col("flags"), F.col("Notes"), is_tidy=True),
        "Flagged": F.size("flags") > 0,
        "Flag_Count": F.size("flags"),
        "Blocked": rules.is_blocked(F.col("flags")),
    }).fillna("", subset=["Date", "Client_ID", "Reference"])


def published(df: DataFrame, o: Options) -> DataFrame:
    """Leading columns, the other canonicals, extras, helpers, flags, order key."""
    rest = [c for c in CANONICAL if c not in LEADING_COLUMNS]
    rest += [c for c in df.columns if c.startswith("EXTRA_")]
    names = [*LEADING_COLUMNS, *rest, *HELPER_COLUMNS, "flags"]
    names += [o.order_by] if o.order_by else []
    return df.select(*[quoted(n) for n in names])


@dataclass(frozen=True)
class LedgerRun:
    """A finished plan. Every table is a DataFrame; nothing has run but the
    small lookups of the cross-row rules. ``close`` drops their tables."""

    options: Options
    mapped: MappedTable
    filled: DataFrame      # scrubbed rows that are not blank, before any drop
    work: DataFrame        # judged rows with the working columns
    clean: DataFrame
    mode: str = "sales"
    staged: list[str] = field(default_factory=list, repr=False)
    filled_rows: int | None = None      # of ``filled``, where the cross-row rules counted them
    held: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    @property
    def context(self) -> rules.Context:
        return rules.Context(self.options, frozenset(self.mapped.mapping))

    @property
    def mapping(self) -> dict[str, str]:
        return self.mapped.mapping

    @property
    def display(self) -> DataFrame:
        """The clean table as exported: no helper or bookkeeping columns."""
        drop = [*HELPER_COLUMNS, "flags"]
        drop += [self.options.order_by] if self.options.order_by else []
        return self.clean.drop(*drop)

    def settled(self) -> LedgerRun:
        """The run with its clean table written once; exports, metrics and
        history of it read that instead of cleaning again."""
        with collected() as paths:
            done = settle(self.clean).df
        self.staged.extend(paths)
        return replace(self, clean=done)

    def summary(self) -> Summary:
        """Pivot, breakdown, trend, clients and totals from one pass over the rows."""
        with collected() as paths:
            done = summarise(self.clean)
        self.staged.extend(paths)
        return done

    def close(self) -> None:
        self.held.clear()
        discard(self.clean.sparkSession, self.staged)

    def __enter__(self) -> LedgerRun:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def profile(self) -> Profile:
        return profile(self.audited(), self.options)

    def audit(self, prof: Profile | None = None) -> AuditResult:
        return audit(self.audited(), prof or self.profile(), self.options)

    def audited(self) -> DataFrame:
        """``auditable``, written once: profile and audit read it several times, and
        each would clean and judge all rows again."""
        if "audited" not in self.held:
            with collected() as paths:
                self.held["audited"] = settle(self.auditable()).df
            self.staged.extend(paths)
        return self.held["audited"]

    def full_metrics(self, seconds: float = 0.0) -> DataFrame:
        """``metrics`` with duplicate_rows of the audited table, time and duration."""
        extra = self.audit().totals.select(
            "duplicate_rows", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
            .alias("finished"), F.lit(round(float(seconds), 2)).alias("seconds"))
        return report._one_row(self.metrics(), extra)

    def rules_applied(self) -> list[str]:
        return rules.applied_rules(self.context)

    def breakdown(self) -> DataFrame:
        return report.flag_breakdown(self.clean)

    def counters(self) -> DataFrame:
        return report.rule_counters(self.work, self.context)

    def metrics(self) -> DataFrame:
        return report.ledger_metrics(self.mapped.df, self.filled, self.clean, self.options,
                                     len(self.rules_applied()), self.filled_rows)

    def auditable(self) -> DataFrame:
        """What the quality audit looks at: the mapped, extra and derived
        columns, notes as they came (all of ``display`` under strict_compat)."""
        if self.options.strict_compat:
            return self.clean.drop(*HELPER_COLUMNS, "flags")
        derived = ("Recon_Status", "VAT_15", "Total_Inc_VAT", "Status", "Amount")
        keep = [c for c in self.display.columns
                if c in self.mapping or c in derived or c.startswith("EXTRA_")]
        names = keep + ([self.options.order_by] if self.options.order_by else [])
        notes = self.work.withColumn("Notes", F.col("_notes")).fillna(
            "", subset=["Date", "Client_ID", "Reference"])
        return notes.select(*[quoted(c) for c in names])


def run_ledger(df: DataFrame, o: Options) -> LedgerRun:
    o = o.resolved()
    mapped = map_columns(df, o.mapping, o.order_by)
    have = frozenset(mapped.mapping)
    filled = scrub(not_blank(mapped.df, o), o)
    repaired = repair(filled, have, o).withColumn("_notes", F.col("Notes"))
    counted: list[int] = []
    with collected() as paths:
        try:
            work = judge(cross_row(repaired, have, o, counted=counted), have, o)
        except ValueError:
            discard(df.sparkSession, paths)
            raise
    return LedgerRun(o, mapped, filled, work, published(work, o), staged=paths,
                     filled_rows=counted[0] if counted else None)


def clean_ledger(df: DataFrame, o: Options) -> DataFrame:
    return run_ledger(df, o).clean


def flag_rows_locally(df: DataFrame, o: Options) -> DataFrame:
    """The ledger without the rules that compare rows: no shuffle, so it runs
    on a stream as it is."""
    o = o.resolved()
    mapped = map_columns(df, o.mapping, o.order_by)
    have = frozenset(mapped.mapping)
    rows = scrub(not_blank(mapped.df, o), o)
    work = judge(cross_row(repair(rows, have, o), have, o, local_only=True), have, o)
    return published(work, o)


def stored_rows(df: DataFrame, o: Options) -> tuple[LedgerRun, DataFrame]:
    """A batch's run without the rules that compare rows, and its rows as they
    are stored: repaired, with the local flags (_local) and which of the
    comparing rules the batch's columns allow (_rules_12, _15, _17)."""
    o = o.resolved()
    mapped = map_columns(df, o.mapping, o.order_by)
    have = frozenset(mapped.mapping)
    filled = scrub(not_blank(mapped.df, o), o)
    rows = repair(filled, have, o).withColumn("_client", F.coalesce(F.col("Client_ID"), F.lit("")))
    local = mark_listed(rows, rows, o)
    ctx, marks = rules.Context(o, have), {name: F.lit(False) for name in MARKS[:3]}
    local = local.withColumns(marks).withColumn("_local", rules.flags_column(ctx)).drop(*MARKS[:3])
    local = local.withColumns({f"_rules_{n}": F.lit(ctx.runs(f"R{n}")) for n in (12, 15, 17)})
    # The cells as they came are needed by the local rules only.
    return LedgerRun(o, mapped, filled, local, local), local.drop(
        "_listed", "_amount", "_status", "_status_blank", "_email", "_phone", "_company")
