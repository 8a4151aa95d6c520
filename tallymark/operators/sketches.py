"""Profiles of rows that are not read again: a small state, merged.

The state of a table is one row per column: counts, sums, spread and extremes, which are exact, and
four sketches: distinct values and distinct folded ones (theta), the order of the numbers (KLL) and
the frequent values (frequent items). States of disjoint rows merge into the state of all of them,
so what a new drop costs is a pass over the drop, without a shuffle of its cells. ``profile`` is the exact
way and stays the default.

How far off an estimate can be is part of the result (``Bound``): distinct counts are exact below
``2 ** distinct`` and then within three standard errors; a quantile is a value of the column whose rank
is off by a stated share; a frequent value's count is exact while the sketch holds all values, and then
too high by a stated number of rows at most.

Rows may be missing (an empty table's state counts nothing, each of its columns is Empty), values null,
blank, repeated or infinite. A value of more than SHOWN characters is counted whole; among
the frequent ones it shows as its first characters and its digest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import CATEGORICAL, DATETIME, EMPTY, NUMERIC, TEXT, TOP_VALUES, Options
from ..functions import dates, numbers
from ..functions.text import strip
from .profile import DATE_TYPES, ColumnProfile, Profile, _cells, _decide, _digest

#: Characters by which a frequent value is shown.
SHOWN = 200
#: States of a table's partitions before they are merged into one.
PARTS = 64
QUARTILES = (0.25, 0.5, 0.75)
#: A column's declared kind, as it decides the detected type.
DECLARED = {"number": T.DoubleType(), "day": T.DateType(), "flag": T.BooleanType(),
            "text": T.StringType()}
SUMS = ("rows", "filled", "gated", "numbers", "datelike", "days")


@dataclass(frozen=True)
class Accuracy:
    """Sizes of the sketches; all states of a merge must be made with the same. With these a
    column's state has 1.6 MB at most (0.5 MB for ASCII), most of it the frequent values of a column of long texts."""

    distinct: int = 12      # binary logarithm of the values a theta sketch holds
    ranks: int = 800        # k of the KLL sketch
    frequent: int = 1000    # values the frequent-items sketch holds at least

    @property
    def standard_error(self) -> float:
        return 1 / math.sqrt(2 ** self.distinct - 1)

    @property
    def rank_error(self) -> float:
        """Of a quantile, with 99 % confidence."""
        return 2.296 / self.ranks ** 0.9723

    @property
    def count_error(self) -> float:
        """Share of all rows by which a frequent value's count may be too high."""
        return 3.5 / 2 ** math.ceil(math.log2(self.frequent / 0.75))


@dataclass(frozen=True)
class Bound:
    """Where the exact figures of a column lie."""

    unique: tuple[float, float]
    rank: float
    count: float


@dataclass(frozen=True)
class Sketched:
    profile: Profile
    bounds: dict[str, Bound]

    def bound_table(self) -> DataFrame:
        rows = [(c, *[float(x) for x in (*b.unique, b.rank, b.count)]) for c, b in self.bounds.items()]
        return self.profile.spark.createDataFrame(
            rows, "`Column` string, `Unique From` double, `Unique To` double, "
                  "`Rank Error` double, `Count Error` double")


def _declared(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "flag"
    if isinstance(dtype, T.NumericType):
        return "number"
    return "day" if isinstance(dtype, DATE_TYPES) else "text"


def _shown(key: Column) -> Column:
    return F.when(F.char_length(key) <= SHOWN, key).otherwise(
        F.concat(F.left(key, F.lit(SHOWN)), F.lit(" #"), F.lower(F.hex(_digest(key)))))


def _read_cells(df: DataFrame, columns: list[str], o: Options) -> DataFrame:
    """(column, key, day, num, gate, datelike, fold, item, live): every cell parsed, and one row
    that is not live per column, so a column without rows has a state too."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [f"c{i}" for i, c in enumerate(columns) if isinstance(types[c], T.NumericType)]
    cell = _cells(df, columns, columns).withColumn("live", F.lit(True))
    blank = df.sparkSession.createDataFrame([(f"c{i}",) for i in range(len(columns))], "column string")
    cell = cell.unionByName(blank.withColumn("live", F.lit(False)), allowMissingColumns=True)
    text, key = F.col("text"), F.col("key")
    cell = cell.withColumns({"gate": F.when(text, numbers.looks_numeric(key)),
                             "datelike": F.when(text, dates.looks_datelike(key))})
    return cell.withColumns({
        "num": F.when(F.col("column").isin(numeric), key.try_cast("double"))
                .when(F.col("gate"), numbers.parse_amount(key)),
        "day": F.when(text, dates.parse_date(key, T.StringType(), o.dayfirst, o.today().year))
                .otherwise(F.col("day")),
        "fold": F.when(text, F.lower(strip(key))),
        "item": F.when(text, _shown(key))})


def state(df: DataFrame, o: Options | None = None, a: Accuracy | None = None) -> DataFrame:
    """The state of a table: a row for every column but the order key."""
    o, a = (o or Options()).resolved(), a or Accuracy()
    columns = [c for c in df.columns if c != o.order_by]
    if not columns:
        raise ValueError("there is no column to profile")
    types = {f.name: f.dataType for f in df.schema.fields}
    names = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (f"c{i}", c)])
    kinds = F.create_map(*[F.lit(x) for i, c in enumerate(columns)
                           for x in (f"c{i}", _declared(types[c]))])
    cell = _read_cells(df, columns, o).withColumn("part", F.spark_partition_id() % PARTS)
    true = {"rows": F.col("live"), "filled": F.col("key").isNotNull(), "gated": F.col("gate"),
            "numbers": F.col("num").isNotNull(), "datelike": F.col("datelike"),
            "days": F.col("day").isNotNull()}
    num = F.col("num")
    parts = cell.groupBy("column", "part").agg(
        *[F.count_if(cond).alias(name) for name, cond in true.items()],
        F.coalesce(F.sum(num), F.lit(0.0)).alias("sum"),
        F.coalesce(F.var_pop(num) * F.count(num), F.lit(0.0)).alias("m2"),
        F.min(num).alias("min"), F.max(num).alias("max"),
        F.min("day").alias("min_date"), F.max("day").alias("max_date"),
        F.theta_sketch_agg("key", a.distinct).alias("distinct"),
        F.theta_sketch_agg("fold", a.distinct).alias("folded"),
        F.kll_sketch_agg_double(num, a.ranks).alias("ranks"),
        F.expr(f"approx_top_k_accumulate(item, {int(a.frequent)})").alias("frequent"))
    named = parts.drop("part").withColumns({
        "position": F.substring("column", 2, 9).cast("int"),
        "kind": F.try_element_at(kinds, F.col("column")),
        "column": F.try_element_at(names, F.col("column"))})
    return merged(named, a)


def merged(states: DataFrame, a: Accuracy | None = None) -> DataFrame:
    """The state of all rows that some states stand for. A column that was declared
    differently in two of them raises."""
    a = a or Accuracy()
    grouped = states.groupBy("column").agg(
        F.min("position").alias("position"), F.min("kind").alias("kind"),
        F.max("kind").alias("_kind"), *[F.sum(c).alias(c) for c in SUMS],
        F.sum("sum").alias("sum"),
        F.collect_list(F.struct("numbers", "sum", "m2")).alias("_parts"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"),
        F.theta_union_agg("distinct", a.distinct).alias("distinct"),
        F.theta_union_agg("folded", a.distinct).alias("folded"),
        F.kll_merge_agg_double("ranks", a.ranks).alias("ranks"),
        F.expr(f"approx_top_k_combine(frequent, {int(a.frequent)})").alias("frequent"))
    # Spread about the common mean, not a difference of large squares.
    mean = F.col("sum") / F.col("numbers")
    spread = F.aggregate(F.filter("_parts", lambda p: p["numbers"] > 0), F.lit(0.0),
                         lambda s, p: s + p["m2"] + p["numbers"] * F.pow(p["sum"] / p["numbers"] - mean, 2))
    kind = F.when(F.col("kind") == F.col("_kind"), F.col("kind")).otherwise(F.raise_error(
        F.concat(F.lit("column "), "column", F.lit(" is declared as "), "kind", F.lit(" and as "), "_kind")))
    return grouped.withColumns({"m2": spread, "kind": kind}).drop("_kind", "_parts")


def sketched(states: DataFrame, a: Accuracy | None = None) -> Sketched:
    """The profile that a table's state gives, and its bounds. Only figures come to the
    driver: a row per column, with TOP_VALUES values at most."""
    a = a or Accuracy()
    quartiles = F.when(F.kll_sketch_get_n_double("ranks") > 0, F.kll_sketch_get_quantile_double(
        "ranks", F.array(*[F.lit(q) for q in QUARTILES])))
    figures = states.select(
        "column", "position", "kind", *SUMS, "sum", "m2", "min", "max", "min_date", "max_date",
        F.theta_sketch_estimate("distinct").alias("unique"),
        F.theta_sketch_estimate("folded").alias("folded"), quartiles.alias("quartiles"),
        _most_frequent(a).alias("top"))
    out, bounds = [], {}
    for r in sorted(figures.collect(), key=lambda r: (r["position"], r["column"])):
        p = _column(r.asDict(), DECLARED[r["kind"]])
        out.append(p)
        bounds[p.name] = _bound(p, r["unique"], a)
    return Sketched(Profile(states.sparkSession, out), bounds)


def _most_frequent(a: Accuracy) -> Column:
    """(less, item) of the most frequent values, ties by value; ``less`` is the negative count."""
    held = F.filter(F.expr(f"approx_top_k_estimate(frequent, {int(a.frequent)})"),
                    lambda x: x["item"].isNotNull())
    ordered = F.array_sort(F.transform(held, lambda x: F.struct((-x["count"]).alias("less"),
                                                                x["item"].alias("item"))))
    return F.slice(ordered, 1, TOP_VALUES)


def _column(r: dict, dtype: T.DataType) -> ColumnProfile:
    unique = min(r["unique"], r["filled"])
    p = ColumnProfile(r["column"], _decide(r | {"unique": unique}, dtype), r["rows"], r["filled"],
                      r["rows"] - r["filled"], unique)
    if p.type == NUMERIC:
        n, m2 = r["numbers"], r["m2"]
        q1, median, q3 = r["quartiles"] or (0.0, 0.0, 0.0)
        p.stats = {"count": n, "sum": r["sum"], "mean": r["sum"] / max(n, 1), "min": r["min"] or 0.0,
                   "max": r["max"] or 0.0, "std": math.sqrt(m2 / (n - 1)) if n > 1 else 0.0,
                   "q1": q1, "median": median, "q3": q3}
        p.unparsed = r["filled"] - n
    elif p.type == DATETIME:
        p.min_date, p.max_date = (d.isoformat() if d else "" for d in (r["min_date"], r["max_date"]))
        p.unparsed = r["filled"] - r["days"]
    elif p.type in (CATEGORICAL, TEXT):
        p.folded = min(r["folded"], unique)
        p.top = [(t["item"], -t["less"]) for t in r["top"]]
    return p


def _bound(p: ColumnProfile, unique: int, a: Accuracy) -> Bound:
    if p.type == EMPTY:
        return Bound((0, 0), 0.0, 0.0)
    exact = unique < 2 ** a.distinct
    off = 0.0 if exact else 3 * a.standard_error
    spread = (unique, unique) if exact else (unique / (1 + off), unique / (1 - off))
    # A null is an item too.
    count = 0.0 if exact and unique < a.frequent else a.count_error * p.rows
    rank = a.rank_error if p.type == NUMERIC else 0.0
    return Bound(spread, rank, count if p.type in (CATEGORICAL, TEXT) else 0.0)
