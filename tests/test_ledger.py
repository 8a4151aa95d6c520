"""The ledger run: golden counts, options, invariants."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalogue.fixture import ledger_raw
from tallymark import Options, detect_mapping, dirty_ledger, is_ledger, run
from tallymark.operators import explore, report
from tallymark.operators.schema import clean_headers, norm_header
from tallymark.operators.summary import summarise
from tallymark.plans.ledger import flag_rows_locally, run_ledger

DAY = dt.date(2001, 8, 1)


def test_headers():
    assert norm_header("  Amount (ZAR) ") == "amount_zar"
    got = detect_mapping(["Updated", "Invoice Date", "Cust Net Value", "Client", "State"])
    assert got == {"Date": "Invoice Date", "Client_ID": "Client", "Status": "State",
                   "Amount": "Cust Net Value"}
    assert is_ledger(got) and not is_ledger({"Amount": "x", "Date": "y"})
    # no header serves twice: the exact pass takes it first
    assert detect_mapping(["vat", "tax_id"]) == {"VAT_Number": "vat"}


def test_blank_and_repeated_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` a ` int, ` ` int, `b` int").toDF(" a ", " ", "a")
    assert clean_headers(df).columns == ["a", "Column_2", "a_2"]


def test_generator_golden_counts(spark):
    r = run(dirty_ledger(spark, 220), Options(order_by="row_id", as_of=dt.date(2025, 10, 1)))
    m = r.metrics().first()
    assert (m["rows_in"], m["blank_dropped"], m["rows_out"]) == (231, 5, 226)
    hits = {x["Exception"]: x["Rows"] for x in r.breakdown().collect()}
    assert (hits["MISSING ID"], hits["ZERO AMOUNT"], hits["NEGATIVE AMOUNT"],
            hits["INVALID DATE"], hits["DUPLICATE ENTRY"]) == (14, 9, 7, 7, 6)
    assert r.clean.filter("Recon_Status = 'Unreconciled'").count() == 11


def test_generator_scales_by_rule(spark):
    n = 100_000
    df = dirty_ledger(spark, n)
    blank = -(-n // 53)
    assert df.count() == n + -(-n // 37) + blank


def test_invariants_hold_however_the_rows_are_split(spark, sf):
    raw = ledger_raw(spark, sf)
    seen = set()
    for parts in (1, 7, 64):
        r = run_ledger(raw.repartition(parts), Options(order_by="row_id", as_of=DAY))
        m = r.metrics().first()
        assert m["flagged"] + m["clean"] == m["rows_out"]
        assert m["rows_in"] == m["rows_out"] + m["blank_dropped"] + m["dup_dropped"]
        digest = r.clean.agg(F.sum(F.xxhash64(*[c for c in r.clean.columns]).cast("decimal(38,0)")),
                             F.count(F.lit(1))).first()
        seen.add(tuple(digest))
    assert len(seen) == 1
    clean = r.clean
    assert clean.filter("Flag_Count <> size(flags) OR (Blocked AND NOT Flagged)").isEmpty()
    pivot = report.status_pivot(clean).agg(F.sum("Transactions")).first()[0]
    assert pivot == m["rows_out"]


def test_dropping_duplicates_comes_before_exposure(spark):
    rows = [(1, "2001-01-01", "a", "60", "x", "100"), (2, "2001-01-01", "a", "60", "x", "100"),
            (3, "2001-01-02", "b", "60", "y", "100"), (4, "2001-01-02", "b", "50", "z", "100")]
    df = spark.createDataFrame(rows, "id int, date string, client string, amount string, "
                                     "ref string, credit_limit string")
    flag = run_ledger(df, Options(order_by="id", as_of=DAY))
    hits = {r["id"]: r["flags"] for r in flag.clean.collect()}
    assert "DUPLICATE ENTRY" in hits[2] and "SAME-DAY DUPLICATE" in hits[2]
    assert all("CREDIT LIMIT BREACH" in hits[i] for i in (1, 2, 3, 4))
    drop = run_ledger(df, Options(order_by="id", as_of=DAY, drop_duplicates=True))
    hits = {r["id"]: r["flags"] for r in drop.clean.collect()}
    assert set(hits) == {1, 3, 4} and "CREDIT LIMIT BREACH" not in hits[1]
    assert "CREDIT LIMIT BREACH" in hits[3]
    m = drop.metrics().first()
    assert (m["rows_in"], m["dup_dropped"], m["rows_out"]) == (4, 1, 3)


@pytest.mark.parametrize("drop", [False, True])
def test_large_facts_give_the_same_rows(spark, sf, monkeypatch, drop):
    """Facts too large to broadcast: their marks come as bitmaps, and the wide
    rows are not shuffled; by key only where bitmaps don't fit either."""
    from tallymark.operators import keyed, staging
    from tallymark.operators.staging import Settled
    raw = ledger_raw(spark, sf)
    o = Options(order_by="row_id", as_of=DAY, drop_duplicates=drop)
    want = sorted(map(str, run_ledger(raw, o).clean.collect()))
    monkeypatch.setattr(Settled, "broadcastable", property(lambda self: False))
    monkeypatch.setattr(keyed, "HOT_ROWS", 20)
    spread = run_ledger(raw, o).clean
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == 1 and "bitmapBucketNumber" in plan
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert sorted(map(str, spread.collect())) == want
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 0)
    by_key = run_ledger(raw, o).clean
    plan = by_key._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == 1 and "bitmapBucketNumber" not in plan
    assert sorted(map(str, by_key.collect())) == want


def test_options_and_toggles(spark, sf):
    raw = ledger_raw(spark, sf)
    base = Options(order_by="row_id", as_of=DAY)

    def labels(o):
        return {r["Exception"] for r in run_ledger(raw, o).breakdown().collect()}

    off = dataclasses.replace(base, flag_bad_dates=False, flag_missing_id=False,
                              flag_missing_status=False, flag_nonpositive=False,
                              flag_duplicates=False, bank_recon=False, high_value=0.0,
                              rules={"R13": False, "R15": False, "R17": False, "R22": False})
    assert labels(off) == {"INVALID AMOUNT", "NO CONTACT DETAILS", "INCOMPLETE ADDRESS"}
    some = labels(dataclasses.replace(base, min_amount=1e5, blacklist="ac-north-3;AC-WEST-1"))
    assert {"BELOW THRESHOLD", "RESTRICTED ENTITY"} <= some
    applied = run_ledger(raw, off).rules_applied()
    assert not {"R04", "R06", "R08", "R10", "R13", "R14", "R20"} & set(applied)
    assert {"R01", "R12", "R21"} <= set(applied)


def test_rules_need_their_columns(spark):
    df = spark.createDataFrame([(1, "2001-01-01", "Paid", "5")],
                               "id int, date string, status string, amount string")
    r = run(df, Options(order_by="id", as_of=DAY))
    assert r.mode == "sales" and r.clean.first()["Recon_Status"] == "Not Checked"
    assert not {"R13", "R15", "R16", "R18", "R19", "R20", "R21"} & set(r.rules_applied())
    assert r.clean.first()["flags"] == ["MISSING ID"]


def test_order_key_is_demanded_and_empty_input_refused(spark):
    df = spark.createDataFrame([("2001-01-01", "Paid", "5")],
                               "date string, status string, amount string")
    with pytest.raises(ValueError, match="order_by"):
        run_ledger(df, Options())
    blank = spark.createDataFrame([(1, " ", "NaN", "")],
                                  "id int, date string, status string, amount string")
    with pytest.raises(ValueError, match="blank"):
        run_ledger(blank, Options(order_by="id"))


def test_local_rules_need_no_shuffle(spark, sf):
    raw = ledger_raw(spark, sf)
    plan = flag_rows_locally(raw, Options(order_by="row_id", as_of=DAY))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_are_not_shuffled_for_small_facts(spark, sf):
    clean = run_ledger(ledger_raw(spark, sf), Options(order_by="row_id", as_of=DAY)).clean
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert "PythonUDF" not in plan


def test_pruning_reaches_the_scan(spark, sf):
    clean = run_ledger(ledger_raw(spark, sf), Options(order_by="row_id", as_of=DAY)).clean
    plan = report.daily_trend(clean)._jdf.queryExecution().executedPlan().toString()
    assert "Amount (ZAR)#" in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and not clean.isEmpty()


def test_search_and_preview(spark, sf):
    clean = run_ledger(ledger_raw(spark, sf), Options(order_by="row_id", as_of=DAY)).clean
    assert explore.search(clean, "zzz-no-such").isEmpty()
    shown = explore.preview(clean, "row_id", limit=5)
    assert shown.count() == 5 and "flags" not in shown.columns
    assert explore.filter_view(clean, "all").count() == clean.count()


def test_strict_compat_audits_the_whole_display(spark, sf):
    from tallymark import audit, profile
    raw = ledger_raw(spark, sf)
    for strict in (False, True):
        o = Options(order_by="row_id", as_of=DAY, strict_compat=strict)
        table = run_ledger(raw, o).auditable()
        assert ("Notes" in table.columns)
        result = audit(table, profile(table, o), o)
        copies = result.totals.first()["duplicate_rows"]
        # with the flags in the notes a copy no longer equals its original
        assert (copies > 0) != strict


def test_summary_equals_the_single_tables(spark, sf):
    with run_ledger(ledger_raw(spark, sf), Options(order_by="row_id", as_of=DAY)) as r:
        done = r.settled()
        clean, sums = done.clean, done.summary()
        pairs = [(sums.revenue_totals(), report.revenue_totals(clean)),
                 (sums.revenue_totals(False), report.revenue_totals(clean, False)),
                 (sums.status_pivot(), report.status_pivot(clean)),
                 (sums.status_pivot(True), report.status_pivot(clean, True)),
                 (sums.flag_breakdown(), report.flag_breakdown(clean)),
                 (sums.breakdown_share(), report.breakdown_share(clean)),
                 (sums.daily_trend(), report.daily_trend(clean)),
                 (sums.top_clients(), report.top_clients(clean))]
        for got, want in pairs:
            assert got.columns == want.columns and got.collect() == want.collect()
            # none of them reads the wide rows again
            assert not set(got.inputFiles()) & set(clean.inputFiles())


def test_summary_of_no_rows(spark, sf):
    with run_ledger(ledger_raw(spark, sf), Options(order_by="row_id", as_of=DAY)) as r:
        empty = summarise(r.clean.limit(0))
    assert empty.flag_breakdown().collect() == [] and empty.top_clients().collect() == []
    assert tuple(empty.revenue_totals().first()) == (0.0, 0.0, 0.0)


def test_profile_and_audit_read_rows_that_are_cleaned_once(spark, tmp_path):
    dirty_ledger(spark, 220).write.parquet(str(tmp_path / "raw"))
    options = Options(order_by="row_id", as_of=dt.date(2025, 10, 1))
    with run(spark.read.parquet(str(tmp_path / "raw")), options) as r:
        seen, found = r.profile(), r.audit()
        assert not [f for f in found.rows.inputFiles() if str(tmp_path) in f]
        assert found.totals.first()["rows"] == seen.columns[0].rows == 226
        assert sorted(found.rows.columns) == sorted({*found.rows.columns, *r.auditable().columns})
        assert r.audited().exceptAll(r.auditable()).isEmpty()


def test_ledger_raw_comes_from_one_pass(spark, sf):
    from catalogue import fixture
    got = ledger_raw(spark, sf)
    spark.sql(fixture._ROWS).createOrReplaceTempView("spread_rows")
    cte = fixture.LEDGER_CTE.replace(f"source_rows AS ({fixture._ROWS})", "source_rows AS (SELECT * FROM spread_rows)")
    want = spark.sql(f"WITH {cte} SELECT * FROM ledger_raw".replace('"', "`"))
    assert got.dtypes == want.dtypes and got.count() == want.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    made = spark.sql(fixture._ONE_PASS.replace('"', "`"))._jdf.queryExecution().executedPlan().toString()
    assert made.count("FileScan") == 2 and "Union" not in made


def test_settled_cells_have_no_dictionary(spark):
    import pyarrow.parquet as pq

    from tallymark.operators.staging import settle
    done = settle(spark.range(1000).select((F.col("id") % 3).cast("string").alias("v"))).df
    assert {r["v"] for r in done.collect()} == {"0", "1", "2"}
    for f in done.inputFiles():
        held = pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).column(0)
        assert not held.has_dictionary_page


def test_metrics_of_a_drop_count_the_filled_rows_once(spark, sf):
    run_ = run_ledger(ledger_raw(spark, sf), Options(order_by="row_id", as_of=DAY, drop_duplicates=True))
    got, filled = run_.metrics(), run_.filled.count()
    assert run_.filled_rows == filled
    row = got.first()
    assert (row["blank_dropped"], row["dup_dropped"]) == (row["rows_in"] - filled, filled - row["rows_out"])
    again = dataclasses.replace(run_, filled_rows=None).metrics()
    assert again.collect() == got.collect()
    scans = [m._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for m in (got, again)]
    assert scans[0] < scans[1]
