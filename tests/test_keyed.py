"""Group facts on hot groups, against brute force, on every join path."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import keyed, marks, quantiles
from tallymark.operators.staging import Settled


def skewed_rows(n=3000):
    """A third of all rows in one group, a sixth in the null group."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else None if i % 6 == 1 else f"k{rng.randrange(400)}"
        rows.append((i, key, rng.randrange(3)))
    rng.shuffle(rows)
    return rows


def brute_repeats(rows):
    seen, out = set(), set()
    for i, key, v in sorted(rows):
        if (key, v) in seen:
            out.add(i)
        seen.add((key, v))
    return out


@pytest.mark.parametrize("path", ["broadcast", "shuffle"])
def test_mark_repeats_on_skew(spark, monkeypatch, path):
    rows = skewed_rows()
    if path == "shuffle":
        monkeypatch.setattr(Settled, "broadcastable", property(lambda self: False))
        monkeypatch.setattr(keyed, "HOT_ROWS", 100)
    for parts in (1, 7, 64):
        df = spark.createDataFrame(rows, "i int, k string, v int").repartition(parts)
        got = keyed.mark_repeats(df, ["k", "v"], "i", "again")
        assert got.columns == ["i", "k", "v", "again"] and got.count() == len(rows)
        assert {r["i"] for r in got.filter("again").collect()} == brute_repeats(rows)


def test_hot_groups_are_spread_and_cold_groups_are_not(spark, monkeypatch):
    monkeypatch.setattr(Settled, "broadcastable", property(lambda self: False))
    monkeypatch.setattr(keyed, "HOT_ROWS", 100)
    df = spark.createDataFrame(skewed_rows(), "i int, k string, v int")
    facts = keyed.repeat_facts(df, ["k"], "i")
    plan = keyed.attach(df, facts, ["k"], ["_first"], F.col("i"))
    text = plan._jdf.queryExecution().toString()
    assert "_salt" in text and "ResolvedHint (strategy=broadcast)" in text


def test_exposure(spark):
    df = spark.createDataFrame([("a", 30.0, 100.0, 2), ("a", 50.0, None, 1), ("b", 10.0, 100.0, 1),
                                ("", 5.0, 1.0, 1), ("c", 500.0, None, 1)],
                               "k string, amount double, least double, _rows bigint")
    facts = keyed.exposure_facts(df, "k", "amount", "least", "total").df
    assert {r["k"]: r["total"] for r in facts.collect()} == {"a": 110.0, "": 5.0}


def test_whole_row_repeats_tell_null_from_text(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "null", "x"), (3, None, "x"), (4, "", "x"),
                                (5, "4:null", "x")], "i int, a string, b string")
    got = keyed.mark_repeated_rows(df, ["a", "b"], "i", "again")
    assert [r["i"] for r in got.filter("again").collect()] == [3]


def test_drop_or_flag(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, k string")
    dropped = keyed.drop_or_flag_duplicates(df, ["k"], "i", drop=True)
    assert sorted(r["i"] for r in dropped.collect()) == [1, 3]
    assert keyed.drop_or_flag_duplicates(df, ["k"], "i", drop=False).filter("is_duplicate").count() == 1


def test_quantiles(spark):
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(3)
    columns = {"normal": rng.normal(0, 1, 700).round(3), "heavy": rng.pareto(0.3, 701).round(4),
               "hot": np.where(rng.random(600) < 0.4, 5.0, rng.integers(-50, 50, 600)),
               "one": np.array([2.5]), "same": np.full(9, -1.25),
               "ends": np.array([-np.inf, -1.0, 0.0, 1.0, 2.0, 3.0, np.inf, np.inf, np.inf])}
    weights, data = {}, []
    for c, v in columns.items():
        values, n = np.unique(v, return_counts=True)
        weights[c] = len(v)
        data += [(c, float(x), int(k)) for x, k in zip(values, n)]
    freq = spark.createDataFrame(data, "column string, num double, n bigint")
    got = quantiles.exact_quantiles(freq, weights, [0.25, 0.5, 0.75])
    for c, v in columns.items():
        want = [0.0, 2.0, np.inf] if c == "ends" else np.quantile(v, [0.25, 0.5, 0.75])
        assert np.allclose([got[c][p] for p in (0.25, 0.5, 0.75)], want, rtol=1e-12), c


@pytest.mark.parametrize("key", ["number", "place", "text"])
@pytest.mark.parametrize("few", [True, False])
def test_marks_reach_the_rows_by_key_and_by_bitmap(spark, key, few):
    keys = {"number": F.col("id"), "place": F.struct(F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("file"),
                                                     F.col("id").alias("row")),
            "text": F.col("id").cast("string")}
    rows = spark.range(-70_000, 100_000, 1, 5).select(F.col("id"), keys[key].alias("k"))
    a = F.pmod("id", F.lit(40_000 if few else 3)) == 0
    marked = rows.select("k", a.alias("a"), (F.col("id") == 77).alias("b"))
    found = marks.settle_marks(marked, ["a", "b"], "k")
    assert found.bitmaps == (key != "text" and not few) and found.nulls == 0
    assert found.counts == {"a": marked.where("a").count(), "b": 1}
    wide = spark.range(-80_000, 110_000, 1, 3).select(F.col("id"), keys[key].alias("k"))
    out = found.bring(wide, "k")
    known = F.col("id").between(-70_000, 99_999)
    assert out.columns == ["id", "k", "a", "b"] and out.count() == 190_000
    assert out.filter((F.col("a") != (a & known)) | (F.col("b") != (F.col("id") == 77))).isEmpty()


def test_marks_show_shared_and_missing_keys(spark):
    rows = spark.range(200_000).select((F.col("id") / 2).cast("bigint").alias("k"), F.lit(True).alias("a"))
    found = marks.settle_marks(rows.union(spark.sql("SELECT CAST(NULL AS BIGINT), false")), ["a"], "k")
    assert found.bitmaps and found.counts == {"a": 100_000} and found.nulls == 1
    none = marks.settle_marks(rows.withColumn("a", F.lit(False)), ["a"], "k").bring(rows.drop("a"), "k")
    assert "Join" not in none._jdf.queryExecution().executedPlan().toString() and not none.first()["a"]
