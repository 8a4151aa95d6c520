"""Type inference, audit and the universal run on small hand-made tables."""

import datetime as dt
import statistics

from pyspark.sql import functions as F

from tallymark import Options, audit, profile, run, run_universal, standardise
from tallymark.operators import profile as profiles
from tallymark.operators.audit import label_rows
from tallymark.operators.profile import frequencies

O = Options(order_by="id", as_of=dt.date(2025, 1, 1))


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(i, *[columns[c][i] for c in columns]) for i in range(n)]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"`{c}` string" for c in columns))


def test_types(spark):
    n = 40
    df = frame(spark, money=["R 1 0%02d,50" % i for i in range(n)],
               when=["%02d/03/2024" % (i % 28 + 1) for i in range(n)],
               code=["ORD-%04d" % i for i in range(n)], place=["a b c d".split()[i % 4] for i in range(n)],
               none=[None if i % 2 else "NaN" for i in range(n)],
               mixed=["7" if i < 31 else "x%d" % i for i in range(n)])
    assert profile(df, O).types == {"money": "Numeric", "when": "Datetime", "code": "Text / ID",
                                    "place": "Categorical", "none": "Empty",
                                    "mixed": "Categorical"}


def test_declared_types(spark):
    df = spark.sql("SELECT id, id % 2 = 0 AS b, id * 1.5 AS d, DATE'2020-01-01' + id AS day, "
                   "CAST(NULL AS INT) AS gone, array(id) AS list FROM "
                   "(SELECT CAST(id AS INT) AS id FROM range(30))")
    assert profile(df, O).types == {"b": "Categorical", "d": "Numeric", "day": "Datetime",
                                    "gone": "Empty", "list": "Text / ID"}


def test_statistics_and_top_values(spark):
    df = frame(spark, v=["1", "2", "2", "3", "100"], w=["b", "a", "a", "b", None])
    p = profile(df, O)
    s = p["v"].stats
    assert (s["sum"], s["mean"], s["median"], s["q1"], s["q3"]) == (108.0, 21.6, 2.0, 2.0, 3.0)
    assert round(s["std"], 9) == round(statistics.stdev([1, 2, 2, 3, 100]), 9)
    assert p["w"].top == [("a", 2), ("b", 2)] and p["w"].nulls == 1


def test_long_texts_are_counted_whole(spark):
    base = "x" * 500
    df = frame(spark, t=[base + "1", base + "2", base + "1", " short ", base + "1"])
    p = profile(df, O)["t"]
    assert p.unique == 3
    assert p.top[0] == (base + "1", 3)
    assert {v for v, _ in p.top} == {base + "1", base + "2", " short "}


def test_length_changes_nothing(spark):
    short = ["2001-02-%02d" % (i % 6 + 1) for i in range(12)]
    df = frame(spark, a=short, b=[x.ljust(215) for x in short],
               t=["a" * 250, "b" * 150, "c" * 250, "d" * 10] * 3)
    p = profile(df, O)
    assert p.types["a"] == p.types["b"] == "Datetime"
    assert [v[0] for v, _ in p["t"].top] == ["a", "b", "c", "d"]


def test_winners_that_differ_late_are_ordered_whole(spark):
    head = "the same first words "
    df = frame(spark, t=[head + "%02d" % (40 - i) for i in range(40)],
               u=[head + "%02d" % (i // 2) for i in range(38)] + ["z", "z"],
               d=["2024-01-02 is a day, not a date"] * 39 + ["03/04/2024"])
    p = profile(df, O)
    tops = {c: p[c].top for c in ("t", "u")}
    for name, want in (("t", [head + "%02d" % (i + 1) for i in range(40)]),
                       ("u", [head + "%02d" % i for i in range(19)] + ["z"])):
        assert [v for v, _ in tops[name]] == want[:len(tops[name])]
    assert p["d"].type == "Categorical" and p["d"].unique == 2
    assert p["u"].unique == 20 and p["t"].unique == 40


def test_long_texts_do_not_travel(spark):
    text = F.concat(F.col("id").cast("string"), F.repeat(F.lit(" long text"), 400))
    df = spark.range(500).select("id", text.alias("t"))
    freq = frequencies(df, ["t"], Options(order_by="id").resolved())
    rows = freq.select("key", "prefix", "n").collect()
    assert len(rows) == 500 and all(r["key"] is None and len(r["prefix"]) <= 16 for r in rows)


def test_the_source_is_cleaned_once(spark, tmp_path):
    frame(spark, a=["1", "x", "3"], b=["p", "q", "q"]).write.parquet(str(tmp_path / "t"))
    r = run_universal(spark.read.parquet(str(tmp_path / "t")), O)
    assert str(tmp_path) not in "".join(r.clean.inputFiles())
    r.close()


def test_what_is_counted_is_told_once(spark, tmp_path):
    values = ["1", "2", "2", "3", "900"] * 20 + ["x", None]
    df = frame(spark, v=values, w=["a", "b"] * 51)
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    prof = profile(df, O)
    rows, told = label_rows(df, prof, O)
    # The counts read the narrow rows that were settled, not the source again.
    assert all("/t/" not in f for f in told.inputFiles()) and told.inputFiles()
    want = [(len(r.issues) > 0, "DUPLICATE ROW" in r.issues, "OUTLIER: v" in r.issues) for r in rows.collect()]
    assert sorted((r.issue or r._repeat, r._repeat, r.o0) for r in told.collect()) == sorted(want)
    assert [sum(w) for w in zip(*want)] == [96, 92, 20]


def test_short_winners_need_no_fetch(spark, monkeypatch):
    asked = []
    texts = profiles._texts
    monkeypatch.setattr(profiles, "_texts", lambda df, columns, among, *a: asked.append(among) or texts(df, columns, among, *a))
    df = frame(spark, a=["Åb", "Åb", " c", "c"] * 3, b=["x" * 15 + c for c in "abab"] * 3)
    p = profile(df, O)
    assert p["a"].top == [("Åb", 6), (" c", 3), ("c", 3)]
    assert p["b"].top == [("x" * 15 + "a", 6), ("x" * 15 + "b", 6)]
    assert asked == [{"c1"}]


def test_infinity_and_large_numbers(spark):
    big = 2 ** 53
    df = spark.sql(f"SELECT CAST(id AS INT) AS id, {big} + id AS big, CAST({big} + id AS DECIMAL(30,4))"
                   " + 0.0001 AS dec, IF(id = 3, double('Infinity'), double(id)) AS d FROM range(4)")
    p = profile(df, O)
    assert (p["big"].unique, p["dec"].unique, p["d"].unique) == (4, 4, 4)
    assert p["d"].stats["median"] == 1.5 and p["d"].stats["max"] == float("inf")
    r = run_universal(df, Options(order_by="id", as_of=O.as_of, flag_outliers=False))
    assert [x["big"] for x in r.clean.orderBy("id").collect()] == [big + i for i in range(4)]
    assert r.clean.filter("Flagged").isEmpty()


def test_universal_search_and_preview(spark):
    df = frame(spark, kind=["Click", "view", "view"], n=["1", "2", "2"])
    r = run_universal(df, O)
    assert [x["id"] for x in r.search("click").collect()] == [0]
    assert [x["id"] for x in r.search("duplicate").collect()] == [2]
    assert r.preview(2).columns == ["kind", "n", "Notes"] and r.preview(2).count() == 2


def test_findings_and_row_issues(spark):
    n = 30
    df = frame(spark, qty=[str(5 + i % 2) for i in range(n - 2)] + ["oops", "9000"],
               day=["2024-01-%02d" % (i + 1) for i in range(n - 1)] + ["someday - soon"],
               tag=["Red", "red ", None] * (n // 3), fixed=["same"] * n)
    r = run(df, O)
    assert r.mode == "universal"
    found = {(f["Column"], f["Issue"].split(" (")[0]): f["Rows"] for f in
             r.audit.findings.collect()}
    assert found == {("qty", "Non-numeric values in a numeric column"): 1,
                     ("qty", "Severe numeric outliers"): 1, ("tag", "Missing values"): 10,
                     ("day", "Inconsistent date strings"): 1,
                     ("tag", "Inconsistent casing / spacing in labels"): 1,
                     ("fixed", "Constant value"): n}
    rows = {x["id"]: x for x in r.clean.collect()}
    assert rows[28]["issues"] == ["BAD NUMBER: qty"]
    assert rows[29]["issues"] == ["OUTLIER: qty", "BAD DATE: day", "NULL: tag"]
    assert rows[29]["day"] == "" and rows[28]["qty"] is None and rows[0]["qty"] == 5.0
    ranks = [f["Severity"] for f in r.audit.findings.collect()]
    assert ranks == sorted(ranks, key=["High", "Medium", "Low"].index)


def test_strict_compat_counts_bad_values_as_missing(spark):
    df = frame(spark, qty=["1", "2", "3", "4", "5", "6", "7", "8", "9", "bad"])
    strict = run_universal(df, Options(order_by="id", strict_compat=True))
    assert [f["Issue"] for f in strict.audit.findings.collect()] == ["Missing values"]
    loose = run_universal(df, Options(order_by="id"))
    assert "Non-numeric" in loose.audit.findings.first()["Issue"]


def test_duplicates_are_judged_on_the_standardised_row(spark):
    df = frame(spark, qty=["1 000", "1000", "7", "8"], tag=["a", "a", "b", "c"])
    r = run_universal(df, Options(order_by="id"))
    assert [x["id"] for x in r.clean.filter("Flagged").collect()] == [1]
    assert r.audit.totals.first()["duplicate_rows"] == 1


def test_a_source_column_called_notes_is_kept(spark):
    df = frame(spark, Notes=["urgent", "b", "b"], x=["1", "2", "2"])
    r = run_universal(df, O)
    assert r.notes_column == "_issues"
    got = {x["id"]: x for x in r.clean.collect()}
    assert got[0]["Notes"] == "urgent" and got[0]["Needs_Review"]
    assert got[2]["_issues"] == "DUPLICATE ROW"


def test_standardise_and_audit_leave_row_counts_alone(spark):
    df = frame(spark, a=["1", "x", "3", "4", "5", "6"], b=[None, "", "q", "q", "r", "s"])
    p = profile(df, O)
    assert standardise(df, p.types, O).count() == 6
    result = audit(df, p, O)
    t = result.totals.first()
    assert t["rows_affected"] + t["rows_clean"] == t["rows"] == 6


def test_key_numeric_prefers_measures(spark):
    df = frame(spark, user_id=["9000000", "2"], cost=["5", "6"], other=["900", "1"])
    assert profile(df, O).key_numeric() == ["cost", "other", "user_id"]
