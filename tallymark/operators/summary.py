"""The report tables of a ledger from one pass over its clean rows.

A row counts once for its status, its client, its date and each of its flags.
One aggregate over these (group, key) pairs, partial before its shuffle, is
settled: every table below is read from it, and the wide rows only once. It
has a row per status, client, day and flag, however many rows are behind them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import TOP_CLIENTS
from ..functions.numbers import share
from ..functions.text import status_rank
from .staging import settle

#: Measure -> clean column.
SUMS = {"amount": "Amount", "vat": "VAT_15", "inc": "Total_Inc_VAT"}


def _pair(group: str, key: Column) -> Column:
    return F.struct(F.lit(group).alias("group"), key.cast("string").alias("key"))


def _money(name: str) -> Column:
    """A sum of whole cents as money."""
    return F.coalesce(F.sum(name).cast("double") / 100, F.lit(0.0))


@dataclass(frozen=True)
class Summary:
    """Sums by (group, key); money in whole cents."""

    facts: DataFrame

    def _of(self, group: str) -> DataFrame:
        return self.facts.filter(F.col("group") == group)

    def table(self) -> DataFrame:
        """All sums, long: one row per status, client, date and flag."""
        return self.facts.groupBy("group", "key").agg(
            F.sum("n").alias("n"), *[_money(m).alias(m) for m in SUMS],
            F.sum("flagged").alias("flagged"))

    def revenue_totals(self, exclude_cancelled: bool = True) -> DataFrame:
        counted = self._of("status")
        if exclude_cancelled:
            counted = counted.filter(F.col("key") != "CANCELLED")
        return counted.agg(*[_money(m).alias(n) for m, n in
                             zip(SUMS, ("revenue", "vat_total", "inc_vat_total"))])

    def status_pivot(self, total: bool = False) -> DataFrame:
        def rows(df, status):
            return df.agg(
                F.sum("n").alias("Transactions"), _money("amount").alias("Revenue_Excl_VAT"),
                _money("vat").alias("VAT_15"), _money("inc").alias("Total_Inc_VAT"),
                F.sum("flagged").alias("Flagged_Rows")).select(
                status.alias("Status"), "Transactions", "Revenue_Excl_VAT", "VAT_15",
                "Total_Inc_VAT", "Flagged_Rows")

        pivot = rows(self._of("status").groupBy("key"), F.col("key"))
        if not total:
            return pivot.orderBy(status_rank(F.col("Status")), "Status")
        grand = rows(self._of("status"), F.lit("GRAND TOTAL"))
        both = pivot.withColumn("_last", F.lit(0)).unionByName(grand.withColumn("_last", F.lit(1)))
        return both.orderBy("_last", status_rank(F.col("Status")), "Status").drop("_last")

    def flag_breakdown(self) -> DataFrame:
        return (self._of("flag").select(F.col("key").alias("Exception"), F.col("n").alias("Rows"))
                .orderBy(F.desc("Rows"), "Exception"))

    def breakdown_share(self) -> DataFrame:
        """Flags with their percent of all rows: each row has one status."""
        narrow = self.facts.filter(F.col("group").isin("status", "flag"))
        # one row per status and flag: a window over all of them is small
        whole = F.sum(F.when(F.col("group") == "status", F.col("n"))).over(
            Window.partitionBy(F.lit(1)))
        return (narrow.withColumn("_all", whole).filter(F.col("group") == "flag")
                .select(F.col("key").alias("Exception"), F.col("n").alias("Rows"),
                        share(F.col("n"), F.col("_all")).alias("% of File"))
                .orderBy(F.desc("Rows"), "Exception"))

    def daily_trend(self) -> DataFrame:
        return (self._of("date").filter(F.length("key") == 10).groupBy(F.col("key").alias("Date"))
                .agg(_money("amount").alias("Revenue")).orderBy("Date"))

    def top_clients(self, n: int = TOP_CLIENTS) -> DataFrame:
        return (self._of("client").filter(F.col("key") != "")
                .groupBy(F.col("key").alias("Client_ID"))
                .agg(F.sum("n").alias("Transactions"), _money("amount").alias("Revenue"),
                     _money("vat").alias("VAT"), F.sum("flagged").alias("Flagged"))
                .orderBy(F.desc("Revenue"), "Client_ID").limit(n))


def summarise(clean: DataFrame) -> Summary:
    """The summary of a ledger's clean rows, settled."""
    pairs = F.array(*[_pair(group, F.col(c)) for group, c in
                      (("status", "Status"), ("client", "Client_ID"), ("date", "Date"))])
    flags = F.transform(F.coalesce("flags", F.array().cast("array<string>")),
                        lambda flag: _pair("flag", flag))
    cents = [F.rint(F.col(c) * 100).try_cast("decimal(38,0)").alias(m) for m, c in SUMS.items()]
    laid = clean.select(F.inline(F.concat(pairs, flags)), *cents, "Flagged")
    return Summary(settle(laid.groupBy("group", "key").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in SUMS],
        F.count_if("Flagged").alias("flagged"))).df)
