"""Column profile from one value-frequency table.

Every cell becomes (column, value), values collapse to (column, value, n) with
partial aggregation before the one wide shuffle, and types, counts, statistics
and top values are small aggregates of that table. Numbers, dates and texts
shaped like them are keyed by themselves, and parsed once per distinct value.
Any other text is keyed by its digest and travels as that, the digest of its
folded form and its first characters, however long it is; the texts of the few
winners are fetched afterwards. What reaches the driver is a row or a handful
of values per column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..constants import (CATEGORICAL, CATEGORY_RATIO, CATEGORY_SMALL, DATETIME, EMPTY, ID_NAMES,
                         MEASURE_WORDS, NUMERIC, PARSE_SHARE, TEXT, TOP_VALUES, Options)
from ..functions import dates, numbers
from ..functions.text import as_text, is_blank, quoted, strip_cell
from .quantiles import exact_quantiles
from .schema import norm_header
from .staging import settle

#: Characters of a text that stand in for it when ties are ordered.
PREFIX = 16
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass
class ColumnProfile:
    name: str
    type: str
    rows: int = 0
    non_null: int = 0
    nulls: int = 0
    unique: int = 0
    unparsed: int = 0
    folded: int = 0
    stats: dict = field(default_factory=dict)
    min_date: str = ""
    max_date: str = ""
    top: list = field(default_factory=list)

    @property
    def null_pct(self) -> float:
        return self.nulls / max(self.rows, 1) * 100

    @property
    def mode(self) -> str:
        return self.top[0][0] if self.top else ""

    @property
    def detail(self) -> str:
        if self.type == NUMERIC:
            s = self.stats
            return f"min {s['min']:,.2f} | mean {s['mean']:,.2f} | max {s['max']:,.2f}"
        if self.type == DATETIME:
            return f"{self.min_date} to {self.max_date}"
        return ", ".join(f"{v} ({n})" for v, n in self.top[:3])


def _cell(c: Column, dtype: T.DataType, i: int) -> Column:
    """One cell as (column, cell, day). A number's cell is its exact value as
    text, and null for NaN; minus zero is zero."""
    day = F.lit(None).cast("date")
    if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
        value = c.cast("double") + 0.0
        text = F.when(~F.isnan(value), value.cast("string"))
    elif isinstance(dtype, DATE_TYPES):
        text, day = c.cast("string"), c.cast("date")
    else:
        text = c.cast("string") if isinstance(dtype, T.NumericType) else as_text(c, dtype)
    return F.struct(F.lit(f"c{i}").alias("column"), text.alias("cell"), day.alias("day"))


def _digest(text: Column) -> Column:
    """The first 128 bits of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _fold(text: Column, digest: Column) -> Column:
    """The digest of a text without outer space and case."""
    folded = F.lower(strip_cell(text))
    return F.when(folded == text, digest).otherwise(_digest(folded))


def _cells(df: DataFrame, columns: list[str], among: list[str]) -> DataFrame:
    """(column, key, day, text): the cells of ``among``, laid out long first, so the
    expressions do not grow with the columns. ``text`` marks filled cells of text columns."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*[_cell(quoted(c), types[c], i) for i, c in enumerate(columns) if c in among])
    numeric = [f"c{i}" for i, c in enumerate(columns) if isinstance(types[c], T.NumericType)]
    days = [f"c{i}" for i, c in enumerate(columns) if isinstance(types[c], DATE_TYPES)]
    key = F.when(F.col("column").isin(numeric) | ~is_blank(F.col("cell")), F.col("cell"))
    cell = df.select(F.inline(cells)).select("column", key.alias("key"), "day")
    return cell.withColumn("text", ~F.col("column").isin(numeric + days) & F.col("key").isNotNull())


def frequencies(df: DataFrame, columns: list[str], o: Options) -> DataFrame:
    """(column, key, digest, day, n, gate, datelike, num, fold, prefix): the one wide
    shuffle. Hot values collapse before it. ``key`` holds numbers, dates and texts that may
    be one, which are parsed after it, once each; other texts have a digest instead."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [f"c{i}" for i, c in enumerate(columns) if isinstance(types[c], T.NumericType)]
    cell = _cells(df, columns, columns).withColumns({
        "gate": F.when(F.col("text"), numbers.looks_numeric(F.col("key"))),
        "datelike": F.when(F.col("text"), dates.looks_datelike(F.col("key")))})
    worded = F.col("text") & ~F.col("gate") & ~dates.has_shape(F.col("key"), F.col("datelike"))
    cell = cell.withColumn("digest", F.when(worded, _digest(F.col("key"))))
    away = F.col("digest").isNotNull()
    slim = cell.select(
        "column", "text", "day", "gate", "datelike", "digest",
        F.when(away, _fold(F.col("key"), F.col("digest"))).alias("fold"),
        F.when(away, F.left("key", F.lit(PREFIX))).alias("prefix"),
        F.when(~away, F.col("key")).alias("key"))
    grouped = slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("n"))
    own = F.col("text") & F.col("key").isNotNull()
    return grouped.withColumns({
        "num": F.when(F.col("column").isin(numeric), F.col("key").try_cast("double"))
                .when(F.col("gate"), numbers.parse_amount(F.col("key"))),
        "day": F.when(own, dates.parse_date(F.col("key"), T.StringType(), o.dayfirst,
                                            o.today().year)).otherwise(F.col("day")),
        "fold": F.when(own, _fold(F.col("key"), _digest(F.col("key")))).otherwise(F.col("fold")),
        "prefix": F.coalesce("prefix", F.left("key", F.lit(PREFIX))),
    }).drop("text")


def _decide(r, dtype: T.DataType) -> str:
    """The five-way type of a column from its shares."""
    n = r["filled"]
    if n == 0:
        return EMPTY
    if isinstance(dtype, T.BooleanType):
        return CATEGORICAL
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, DATE_TYPES):
        return DATETIME
    if r["gated"] / n >= PARSE_SHARE and r["gated"] and r["numbers"] / r["gated"] >= PARSE_SHARE:
        return NUMERIC
    if r["datelike"] / n >= PARSE_SHARE and r["days"] / n >= PARSE_SHARE:
        return DATETIME
    if r["unique"] / n <= CATEGORY_RATIO or r["unique"] <= CATEGORY_SMALL:
        return CATEGORICAL
    return TEXT


def _census(freq: DataFrame) -> dict:
    n, one = F.col("n"), F.lit(1)
    filled = (F.col("key").isNotNull() | F.col("digest").isNotNull()
              | F.col("num").isNotNull() | F.col("day").isNotNull())
    total = {"rows": F.lit(True), "filled": filled, "gated": F.col("gate"),
             "numbers": F.col("num").isNotNull(), "datelike": F.col("datelike"),
             "days": F.col("day").isNotNull()}
    aggs = [F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).alias(k) for k, cond in total.items()]
    aggs += [F.count(F.when(filled, one)).alias("unique"),
             F.sum(F.col("num") * n).alias("sum"), F.min("num").alias("min"),
             F.max("num").alias("max"), F.min("day").alias("min_date"),
             F.max("day").alias("max_date")]
    return {r["column"]: r for r in freq.groupBy("column").agg(*aggs).collect()}


def _number_stats(freq, census, names, spark) -> dict[str, dict]:
    """Mean-centred spread, then exact quartiles."""
    out = {}
    for c in names:
        r = census[c]
        total = r["numbers"]
        out[c] = {"sum": r["sum"] or 0.0, "mean": (r["sum"] or 0.0) / max(total, 1),
                  "min": r["min"] or 0.0, "max": r["max"] or 0.0, "std": 0.0, "median": 0.0,
                  "q1": 0.0, "q3": 0.0, "count": total}
    live = [c for c in names if census[c]["numbers"]]
    if not live:
        return out
    numeric = freq.filter(F.col("column").isin(live) & F.col("num").isNotNull())
    mean = F.create_map(*[x for c in live for x in (F.lit(c), F.lit(out[c]["mean"]))])
    off = F.col("num") - F.try_element_at(mean, F.col("column"))
    for r in numeric.groupBy("column").agg(F.sum(off * off * F.col("n")).alias("ss")).collect():
        total = census[r["column"]]["numbers"]
        out[r["column"]]["std"] = math.sqrt(r["ss"] / (total - 1)) if total > 1 else 0.0
    counts = {c: census[c]["numbers"] for c in live}
    for c, q in exact_quantiles(numeric.select("column", "num", "n"), counts,
                                [0.25, 0.5, 0.75]).items():
        out[c] |= {"q1": q[0.25], "median": q[0.5], "q3": q[0.75]}
    return out


def _worded(freq: DataFrame, names: list[str]) -> DataFrame:
    filled = F.col("key").isNotNull() | F.col("digest").isNotNull()
    return freq.filter(F.col("column").isin(names) & filled)


def _top_values(freq, df, columns, names, n=TOP_VALUES) -> dict[str, list]:
    """The most frequent values, ties by value. Counts and first characters decide which
    values can be among them, and only the texts of these are fetched. Each task keeps a
    few rows per column before a shuffle, so no column gathers in one."""
    values = _worded(freq, names).select("column", "key", "digest", "prefix", "n")

    def first(rows, by, limit):
        rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), by))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= limit)

    heads: dict[str, list] = {}
    for r in sorted(first(values, "prefix", n + 1).collect(), key=lambda r: (r["column"], r["rank"])):
        heads.setdefault(r["column"], []).append(r)
    # Where the first one left out equals the last one taken so far, whole texts decide.
    tied = {c: rows[n] for c, rows in heads.items()
            if len(rows) > n and all(rows[n][x] == rows[n - 1][x] for x in ("n", "prefix"))}
    taken = [r for c, rows in heads.items() if c not in tied for r in rows[:n]]
    found = [(r["column"], r["key"], r["n"]) for r in taken if r["key"] is not None]
    # First characters that are fewer than could be are the whole text.
    short = [r for r in taken if r["key"] is None and len(r["prefix"]) < PREFIX]
    found += [(r["column"], r["prefix"], r["n"]) for r in short]
    far = [r for r in taken if r["key"] is None and len(r["prefix"]) >= PREFIX]
    if away := {(r["column"], bytes(r["digest"])): r["n"] for r in far}:
        cells = _texts(df, columns, {c for c, _ in away}, sorted({r["prefix"] for r in far}))
        named = cells.filter(F.col("digest").isin([F.lit(d) for _, d in away])).distinct()
        found += [(r["column"], r["key"], away[r["column"], bytes(r["digest"])])
                  for r in named.collect() if (r["column"], bytes(r["digest"])) in away]
    if tied:
        def edge(field):
            return F.try_element_at(F.create_map(*[F.lit(x) for c, r in tied.items()
                                                   for x in (c, r[field])]), F.col("column"))

        near = ((F.col("n") > edge("n"))
                | ((F.col("n") == edge("n")) & (F.col("prefix") <= edge("prefix"))))
        chosen = settle(values.filter(near))
        rows = chosen.df.filter("digest IS NULL").select("column", "key", "n")
        wanted = chosen.df.filter("digest IS NOT NULL").select("column", "digest", "n")
        cells = _texts(df, columns, set(tied))
        # Past a broadcast, each distinct text of these columns is shuffled once.
        hits = (cells.join(F.broadcast(wanted), ["column", "digest"]).distinct()
                if chosen.broadcastable else cells.distinct().join(wanted, ["column", "digest"]))
        rows = rows.union(hits.select("column", "key", "n"))
        found += first(rows, "key", n).select("column", "key", "n").collect()
    top: dict[str, list] = {}
    for column, key, count in sorted(found, key=lambda r: (r[0], -r[2], r[1].encode())):
        top.setdefault(column, []).append((key, count))
    return top


def _texts(df, columns, among, prefixes=None) -> DataFrame:
    """(column, key, digest): the texts of some columns, of those only that begin with one of ``prefixes``."""
    cells = _cells(df, columns, [c for i, c in enumerate(columns) if f"c{i}" in among])
    if prefixes:
        cells = cells.filter(F.left("key", F.lit(PREFIX)).isin(prefixes))
    return cells.filter("text").select("column", "key", _digest(F.col("key")).alias("digest"))


def _folded(freq, names) -> dict[str, int]:
    """Distinct values once case and outer space are ignored."""
    if not names:
        return {}
    folds = (_worded(freq, names)
             .groupBy("column", "fold").agg(F.count(F.lit(1)).alias("spellings")))
    return {r["column"]: r["folded"] for r in
            folds.groupBy("column").agg(F.count(F.lit(1)).alias("folded")).collect()}


def _cents(x: float) -> float:
    """``numbers.cents`` of a value on the driver."""
    return round(x * 100) / 100 if math.isfinite(x) else x


@dataclass
class Profile:
    """A profile and its tables. Each table is a row per column."""

    spark: SparkSession
    columns: list[ColumnProfile]

    def __getitem__(self, name: str) -> ColumnProfile:
        return next(c for c in self.columns if c.name == name)

    @property
    def types(self) -> dict[str, str]:
        return {c.name: c.type for c in self.columns}

    def _table(self, rows, schema) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def of(self, *types: str) -> list[ColumnProfile]:
        return [c for c in self.columns if c.type in types]

    def type_table(self) -> DataFrame:
        return self._table([(c.name, c.type) for c in self.columns],
                           "`Column` string, `Detected Type` string")

    def table(self) -> DataFrame:
        return self._table(
            [(c.name, c.type, c.non_null, c.nulls, round(c.null_pct, 1), c.unique, c.detail)
             for c in self.columns],
            "`Column` string, `Detected Type` string, `Non-Null` bigint, `Missing` bigint, "
            "`Missing %` double, `Unique` bigint, `Detail` string")

    def numeric(self) -> DataFrame:
        rows = [(c.name, c.non_null, *[_cents(c.stats[k]) for k in
                 ("sum", "mean", "median", "min", "max", "std")], c.nulls)
                for c in self.of(NUMERIC)]
        return self._table(rows, "`Column` string, `Count` bigint, `Sum` double, `Mean` double, "
                                 "`Median` double, `Min` double, `Max` double, "
                                 "`Std Dev` double, `Missing` bigint")

    def categorical(self, top_n: int = 5) -> DataFrame:
        rows = [(c.name, c.type, c.unique, c.mode, c.top[0][1] if c.top else 0,
                 round(c.top[0][1] / max(c.non_null, 1) * 100, 1) if c.top else 0.0,
                 ", ".join(f"{v} ({n})" for v, n in c.top[:top_n]), c.nulls)
                for c in self.of(CATEGORICAL, TEXT)]
        return self._table(rows, "`Column` string, `Type` string, `Unique` bigint, "
                                 "`Most Common` string, `Frequency` bigint, `Share %` double, "
                                 "`Top Values` string, `Missing` bigint")

    def datetime(self) -> DataFrame:
        rows = [(c.name, c.min_date, c.max_date, c.unique, c.unparsed, c.nulls)
                for c in self.of(DATETIME)]
        return self._table(rows, "`Column` string, `Earliest` string, `Latest` string, "
                                 "`Distinct Dates` bigint, `Unparseable` bigint, "
                                 "`Missing` bigint")

    def top_values(self) -> DataFrame:
        rows = [(c.name, i, v, n) for c in self.columns for i, (v, n) in enumerate(c.top, 1)]
        return self._table(rows, "`Column` string, `Rank` int, `Value` string, `Rows` bigint")

    def key_numeric(self, limit: int = 3) -> list[str]:
        """Measure-like names first, identifiers last, then by size of the sum."""
        def score(c):
            name = norm_header(c.name)
            if name.endswith("_id") or name in ID_NAMES:
                return 0
            return 2 if any(w in name for w in MEASURE_WORDS) else 1
        ranked = sorted(self.of(NUMERIC), key=lambda c: (-score(c), -abs(c.stats["sum"])))
        return [c.name for c in ranked[:limit]]

    def key_numeric_table(self, limit: int = 3) -> DataFrame:
        names = self.key_numeric(limit)
        rows = [(i, c, _cents(self[c].stats["sum"])) for i, c in enumerate(names, 1)]
        return self._table(rows, "`Rank` int, `Column` string, `Sum` double")

    def type_census(self) -> DataFrame:
        return (self.type_table().groupBy("Detected Type")
                .agg(F.count(F.lit(1)).alias("Columns")))

    @property
    def numeric_total(self) -> float:
        return float(sum(self[c].stats["sum"] for c in self.key_numeric()))


def profile(df: DataFrame, o: Options | None = None) -> Profile:
    """Profile every column but the order key."""
    o = (o or Options()).resolved()
    columns = [c for c in df.columns if c != o.order_by]
    types = {f.name: f.dataType for f in df.schema.fields}
    freq = settle(frequencies(df, columns, o)).df
    census = _census(freq)
    if not census:
        return Profile(df.sparkSession, [ColumnProfile(c, EMPTY) for c in columns])
    kinds = {f"c{i}": _decide(census[f"c{i}"], types[c]) for i, c in enumerate(columns)}
    numeric = [c for c, k in kinds.items() if k == NUMERIC]
    worded = [c for c, k in kinds.items() if k in (CATEGORICAL, TEXT)]
    stats = _number_stats(freq, census, numeric, df.sparkSession)
    top = _top_values(freq, df, columns, worded) if worded else {}
    folded = _folded(freq, worded)
    out = []
    for i, name in enumerate(columns):
        c = f"c{i}"
        r = census[c]
        p = ColumnProfile(name, kinds[c], r["rows"], r["filled"], r["rows"] - r["filled"],
                          r["unique"], folded=folded.get(c, 0), top=top.get(c, []))
        if p.type == NUMERIC:
            p.stats = stats[c]
            p.unparsed = r["filled"] - r["numbers"]
        elif p.type == DATETIME:
            p.min_date, p.max_date = (d.isoformat() if d else ""
                                      for d in (r["min_date"], r["max_date"]))
            p.unparsed = r["filled"] - r["days"]
        out.append(p)
    return Profile(df.sparkSession, out)


def infer_types(df: DataFrame, o: Options | None = None) -> DataFrame:
    return profile(df, o).type_table()


def coerced(c: Column, dtype: T.DataType, kind: str, o: Options) -> Column:
    """A cell as its column's detected type: its own numeric type or double,
    date, or unchanged."""
    if kind == NUMERIC:
        if isinstance(dtype, T.NumericType):
            return F.when(~is_blank(c, dtype), c)
        # What looks numeric has a digit, which no blank spelling has.
        return F.when(numbers.looks_numeric(c), numbers.parse_amount(c, dtype))
    if kind == DATETIME:
        return dates.parse_date(c, dtype, o.dayfirst, o.today().year)
    return c


VALUE = "_value_"


def with_values(df: DataFrame, kinds: dict[str, str], o: Options) -> DataFrame:
    """Adds ``_value_<column>`` for every detected number and date, so later
    expressions name a parsed cell instead of parsing it again."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({VALUE + c: coerced(quoted(c), types[c], kind, o)
                           for c, kind in kinds.items() if kind in (NUMERIC, DATETIME)})


def standard_cell(name: str, kind: str) -> Column:
    """The published cell: a date as YYYY-MM-DD ('' when unreadable), a number
    in its declared type (a parsed one as double), anything else as it is.
    Needs ``with_values``."""
    if kind == DATETIME:
        return F.coalesce(dates.iso_text(quoted(VALUE + name)), F.lit("")).alias(name)
    return (quoted(VALUE + name) if kind == NUMERIC else quoted(name)).alias(name)


def standardise(df: DataFrame, kinds: dict[str, str], o: Options) -> DataFrame:
    """Detected dates as YYYY-MM-DD, numbers found in texts as double."""
    return with_values(df, kinds, o).select(*[standard_cell(c, kinds.get(c))
                                              for c in df.columns])
