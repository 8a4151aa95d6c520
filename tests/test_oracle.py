"""Registered queries against their SQL twins. Set TALLYMARK_ALL=1 for all."""

import math
import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from catalogue import ledger
from catalogue.fixture import TABLES

duckdb = pytest.importorskip("duckdb")

SOME = ("clean_text blank_rows parse_dates parse_amount vat status_fold proper_case numeric_gate "
        "note_tokens flag_duplicate_entry flag_credit_limit_breach flag_same_day_duplicate "
        "dup_drop ledger_run pivot_grand_total breakdown_share run_metrics top_clients "
        "rule_counters rules_applied profile_table profile_table_documents audit_table "
        "row_issues report_summary universal_run csv_scan dirty_ledger stream_flags "
        "sketch_profile_events stream_profile").split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TALLYMARK_ALL") else SOME


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "%.9g" % (v or 0.0)
    return str(v) if not isinstance(v, Decimal) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall())
    assert got == want


def test_every_query_has_a_twin():
    assert set(ledger.QUERIES) == set(ledger.SQL)


def test_entry(spark):
    assert entry.entry(spark).count() == 3
