"""A deliberately messy ledger for demonstrations and tests, of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

STATUS_TEXTS = ("received", " Closed", "OPEN", "awaiting", "Arrears", "voided", "Cleared ",
                "outstanding", "", "past-due")
BRANCHES = ("NORTH", "SOUTH", "EAST", "WEST", "HUB")


def _pick(words, i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))


def make_dirty(clean: DataFrame) -> DataFrame:
    """Dirt by rule on rows of (i, day 1-30, amount, client, status_no, ref):
    blank, zero, negative and re-typed cells, copies and blank rows, all by the
    row number. ``row_id`` keeps each copy right after its original."""
    i = F.col("i")

    def every(n, dirty, otherwise):
        return F.when(i % n == 0, dirty).otherwise(otherwise)

    branch = _pick(BRANCHES, i)
    client = F.concat(F.lit("AC-"), branch, F.lit("-"), F.col("client").cast("string"))
    day = F.lpad(F.col("day").cast("string"), 2, "0")
    amount = every(29, F.lit(0.0), F.col("amount"))
    amount = every(31, -F.abs(amount), amount)
    typed = F.concat(F.lit("R "), F.format_number(amount, 2))
    date = every(13, F.concat(day, F.lit("-09-2025")), F.concat(F.lit("2025/09/"), day))
    rows = clean.select(
        (i * 10).alias("row_id"), i.alias("_i"),
        every(41, F.lit("not a date"), date).alias("  Date "),
        F.concat(F.lit("  "), every(17, F.lit(""), client), F.lit("  ")).alias("Client ID"),
        every(23, F.lit(""), F.concat(F.lit("EFT"), F.col("ref").cast("string"))
              ).alias("Bank Ref"),
        _pick(STATUS_TEXTS, F.col("status_no")).alias("Status"),
        every(7, typed, amount.cast("string")).alias("Amount (ZAR)"),
        every(5, F.lit(""), F.lit("standing order")).alias("Remarks"),
        branch.alias("Branch"))
    data = [c for c in rows.columns if c not in ("row_id", "_i")]
    # one pass: each row carries its own copies
    kinds = F.filter(F.array(F.lit(0), F.when(F.col("_i") % 37 == 0, F.lit(1)),
                             F.when(F.col("_i") % 53 == 0, F.lit(2))), lambda k: k.isNotNull())
    copied = rows.withColumn("_kind", F.explode(kinds))
    return copied.select(
        (F.col("row_id") + F.col("_kind")).alias("row_id"),
        *[F.when(F.col("_kind") == 2, F.lit("")).otherwise(F.col(f"`{c}`")).alias(c)
          for c in data])


def dirty_ledger(spark: SparkSession, n: int = 220, seed: int = 20240915) -> DataFrame:
    """``n`` base rows, pseudo-random by hash of row number and seed."""
    def uniform(salt, low, high):
        return low + F.pmod(F.xxhash64(F.col("i"), F.lit(seed), F.lit(salt)),
                            F.lit(high - low + 1))
    base = spark.range(n).withColumnRenamed("id", "i").select(
        "i", uniform(1, 1, 30).alias("day"), (uniform(2, 35000, 4800000) / 100).alias("amount"),
        uniform(3, 1001, 1480).alias("client"), uniform(4, 0, 9).alias("status_no"),
        uniform(5, 100000, 999999).alias("ref"))
    return make_dirty(base)
