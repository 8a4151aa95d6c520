"""Sketched profiles: states of parts against the exact profile of the whole."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallymark.constants import Options
from tallymark.operators.profile import profile
from tallymark.operators.sketches import SHOWN, Accuracy, merged, sketched, state
from tallymark.streaming.commits import CommitLog, levelled
from tallymark.streaming.profiled import profile_stream, stream_profile

O = Options(order_by="k", as_of=dt.date(2000, 6, 30))
SCHEMA = "k bigint, name string, paid string, day string, x double, ok boolean, void string"


def rows(n):
    return [(i, None if i % 7 == 0 else f" N{i % 13} " if i % 2 else f"n{i % 13}",
             f"{i % 50}.5" if i % 11 else "?", f"2001-02-{i % 28 + 1:02d}",
             math.inf if i == 5 else math.nan if i == 6 else 1e9 + i, i % 3 == 0, None)
            for i in range(n)]


def figures(p):
    s = {k: v for k, v in p.stats.items() if k not in ("q1", "median", "q3", "std", "mean")}
    return (p.name, p.type, p.rows, p.non_null, p.nulls, p.unique, p.unparsed, p.folded, s,
            p.min_date, p.max_date, p.top)


def test_parts_merge_into_the_whole(spark):
    df = spark.createDataFrame(rows(900), SCHEMA).repartition(5, "k")
    exact = profile(df, O)
    parts = [state(df.filter(F.pmod("k", F.lit(4)) == i), O) for i in range(4)]
    pair = [merged(parts[0].union(parts[1])), merged(parts[2].union(parts[3]))]
    for got in (sketched(state(df, O)), sketched(merged(pair[0].union(pair[1])))):
        assert [figures(p) for p in got.profile.columns] == [figures(p) for p in exact.columns]
        paid = got.profile["paid"].stats
        assert paid["std"] == pytest.approx(exact["paid"].stats["std"], rel=1e-12)
        b = got.bounds["name"]
        assert b.unique == (exact["name"].unique,) * 2 and b.count == 0


def test_spread_far_from_zero(spark):
    df = spark.createDataFrame([(i, 1e9 + i % 3) for i in range(3000)], "k bigint, x double")
    halves = state(df.filter("k < 100"), O).union(state(df.filter("k >= 100"), O))
    got = sketched(merged(halves)).profile["x"].stats
    # Sums of squares would lose all digits here; the means keep seven of the spread.
    assert got["std"] == pytest.approx(profile(df, O)["x"].stats["std"], rel=1e-7)


def test_bounds_hold_past_the_sizes_of_the_sketches(spark):
    n, a = 60_000, Accuracy(distinct=10, ranks=200, frequent=100)
    df = spark.range(n, numPartitions=6).select(
        F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**6)).cast("double").alias("x"),
        F.when(F.col("id") % 4 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.sha2(F.col("id").cast("string"), 256))).alias("t"))
    parts = [state(df.filter(F.pmod("k", F.lit(6)) == i), O, a) for i in range(6)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    got, exact = sketched(merged(whole, a), a), profile(df, O)
    for c in ("x", "t"):
        low, high = got.bounds[c].unique
        assert low < high and low <= exact[c].unique <= high
    for quantile, at in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        value = got.profile["x"].stats[quantile]
        rank = df.filter(F.col("x") <= value).count() / n
        assert abs(rank - at) <= 1.5 * a.rank_error
    (item, count), off = got.profile["t"].top[0], got.bounds["t"].count
    assert item == "hot" and n // 4 <= count <= n // 4 + off and 0 < off < n / 20
    assert got.bound_table().count() == 2


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "k bigint, t string, x double")
    got = sketched(state(empty, O)).profile
    assert [(p.name, p.type, p.rows, p.unique, p.top) for p in got.columns] == [
        ("t", "Empty", 0, 0, []), ("x", "Empty", 0, 0, [])]
    one = spark.createDataFrame([(1, "w " * 5000, 2.0), (2, "w " * 5000, None), (3, " ", 2.0)],
                                empty.schema)
    both = sketched(merged(state(empty, O).union(state(one, O)))).profile
    assert (both["t"].rows, both["t"].non_null, both["t"].unique) == (3, 2, 1)
    (shown, n), = both["t"].top
    assert n == 2 and shown.startswith("w w ") and len(shown) == SHOWN + 34
    assert both["x"].stats["median"] == 2.0
    with pytest.raises(ValueError, match="no column"):
        state(one.select("k"), O)
    other = state(one.select("k", F.lit(True).alias("x")), O)
    with pytest.raises(Exception, match="declared as"):
        sketched(merged(state(one, O).union(other)))


def test_state_shuffles_no_cells(spark):
    """Only states of partitions are exchanged: a few rows a task, however many cells."""
    plan = state(spark.range(10).select(F.col("id").alias("k"), F.lit("a").alias("t")), O)
    text = plan._jdf.queryExecution().executedPlan().toString()
    for line in text.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "hashpartitioning(column" in line
    assert text.count("partial_theta_sketch_agg") and "SortMergeJoin" not in text


def test_levels():
    names = []

    def merge(same, level):
        names.append([n for n, _ in same])
        return f"m{level}-{len(names)}"

    runs = []
    for i in range(17):
        runs = levelled([*runs, (f"r{i}", 0)], merge)
        assert len(runs) <= 7
    assert runs == [("m2-5", 2), ("r16", 0)] and len(names) == 5


def test_stream_counts_every_drop_once(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame(rows(400), SCHEMA)

    def take_up(checkpoint):
        profile_stream(spark, path, df.schema, out, str(tmp_path / checkpoint), O,
                       maxFilesPerTrigger=1).awaitTermination()

    with pytest.raises(ValueError, match="committed"):
        stream_profile(spark, out)
    for i in range(5):
        df.filter(F.pmod("k", F.lit(5)) == i).coalesce(1).write.mode("append").parquet(path)
        take_up("a")
    assert len(CommitLog(spark, out).snapshot().runs) == 2
    exact = profile(df, O)
    assert {p.name: p.non_null for p in stream_profile(spark, out).profile.columns} == {
        p.name: p.non_null for p in exact.columns}
    take_up("b")            # a lost checkpoint: the same batches come again
    assert stream_profile(spark, out).profile["x"].rows == 400
