"""Value vectors of the cleaning expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymark.functions import dates, numbers, text

NBSP, EM = " ", " "


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


AMOUNTS = {
    "R 1 234,56": 1234.56, "R 1,234.56": 1234.56, "(500)": -500.0, "(-500)": 500.0,
    "-R 500": -500.0, "R (500)": 500.0, "1.234,56": 1.23456, "1,234,56": None, "1,234": 1234.0,
    "1,5": 1.5, "12%": 12.0, "ORD-0001": -1.0, "1e5": 15.0, "True": None, "abc": None,
    "ZAR 99": 99.0, "Rand 12": 12.0, "1-2": None, "--5": None, "": None, "   ": None, "-": None,
    "1.2.3": None, "5-": None, "0,00": 0.0, "R": None, "$1,000.50": 1000.5, "((7))": -7.0,
    "(R 1,5)": -1.5, "12.": 12.0, " .5": 0.5, "1 000 000,5": 1000000.5, "7": 7.0, "-3.25": -3.25,
    f"R{NBSP}1{NBSP}000": 1000.0, None: None,
}


def test_parse_amount(spark):
    got = values(spark, numbers.parse_amount, list(AMOUNTS))
    assert dict(zip(AMOUNTS, got)) == AMOUNTS


CLEAN = {
    "a\tb": "ab", f"  x {NBSP} y ": "x y", "\x00z": "z", f"{EM}em{EM}": "em", "  ": None,
    "N/A": None, "n/a": None, "-": None, "NULL": None, "None": None, "#N/A": None, "nan": None,
    "Null": "Null", "": None, "plain": "plain", "a  b": "a b", " a": "a", "é  è": "é è",
    "n\x00an": None, None: None,
}


def test_clean_text_and_its_idempotence(spark):
    got = values(spark, text.clean_text, list(CLEAN))
    assert dict(zip(CLEAN, got)) == CLEAN
    assert values(spark, text.clean_text, got) == got


def test_blank_read_off_the_raw_cell_agrees_with_cleaning_first(spark):
    cells = [*CLEAN, "<NA>", " <NA> ", "NaT", f"{NBSP}NaT", "\x01", "nat", "0", "- -"]
    early = values(spark, text.is_blank_once_clean, cells)
    late = values(spark, lambda c: text.is_blank(text.clean_text(c)), cells)
    assert early == late


DATES = {
    "12/09/2025": "2025-09-12", "12-09-2025": "2025-09-12", "12.09.2025": "2025-09-12",
    "1/9/2025": "2025-09-01", "09/13/2025": "2025-09-13", "13/09/2025": "2025-09-13",
    "2025-9-2": "2025-09-02", "2025/09/12": "2025-09-12", "12 Sep 2025": "2025-09-12",
    "12 sep 2025": "2025-09-12", "Sep 12, 2025": "2025-09-12", "12 September 2025": "2025-09-12",
    "September 12, 2025": "2025-09-12", "12-Sep-2025": "2025-09-12", "12/09/25": "2025-09-12",
    "2025-09-12 10:00": "2025-09-12", "2025-09-12T10:00:00.123": "2025-09-12",
    "12/09/2025 23:59:59": "2025-09-12", "20250912": "2025-09-12", "30/02/2025": None,
    "not a date": None, "10:30": None, "2025": None, "2025-09-12 25:00": None,
    "2025-13-01": None, "12/09/85": "1985-09-12", "march": None, "": None, None: None,
}


def test_parse_date_day_first(spark):
    got = values(spark, lambda c: dates.parse_date(c, this_year=2025).cast("string"), list(DATES))
    assert dict(zip(DATES, got)) == DATES


CLOCKS = {"12/09/2025 10:30 PM": "2025-09-12", "2025-09-12 10:00 AM": "2025-09-12",
          "2025-09-12T10:00:00Z": "2025-09-12", "2025-09-12 10:00:00+02:00": "2025-09-12",
          "Fri 12 Sep 2025": "2025-09-12", "Friday, 12 September 2025": "2025-09-12",
          "12th Sep 2025": "2025-09-12", "September 3rd, 2025": "2025-09-03",
          "12 Sep 2025 9:05 pm": "2025-09-12", "12/09/2025 13:30 PM": None,
          "12/09/2025 25:00 AM": None, "Someday 12 Sep 2025": None}


def test_clocks_weekdays_and_ordinals(spark):
    got = values(spark, lambda c: dates.parse_date(c, this_year=2025).cast("string"), list(CLOCKS))
    assert dict(zip(CLOCKS, got)) == CLOCKS


def test_parse_date_month_first(spark):
    got = values(spark, lambda c: dates.parse_date(c, dayfirst=False, this_year=2025)
                 .cast("string"), ["09/12/2025", "13/09/2025", "2025-09-12"])
    assert got == ["2025-09-12", "2025-09-13", "2025-09-12"]


def test_dates_agree_with_pandas(spark):
    pd = pytest.importorskip("pandas")
    texts = ["12/09/2025", "1/9/2025", "13/09/2025", "12 Sep 2025", "Sep 12, 2025", "12-Sep-2025",
             "12.09.2025", "20250912", "not a date", "30/02/2025", "12/09/2025 10:00"]
    want = [None if pd.isna(d) else str(d.date()) for d in
            pd.to_datetime(pd.Series(texts), errors="coerce", format="mixed", dayfirst=True)]
    got = values(spark, lambda c: dates.parse_date(c).cast("string"), texts)
    assert got == want


def test_typed_dates_pass_through(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 2, 3, 4, 5),)], "t timestamp")
    got = df.select(dates.parse_date(F.col("t"), df.schema["t"].dataType).alias("d")).first()
    assert got["d"] == dt.date(2020, 2, 3)


def test_numeric_gate(spark):
    yes = ["R 1 234,56", f"R{NBSP}1{NBSP}234,56", "12%", "(500)", "US$ 9", "€5", "+3", "zar 4"]
    no = ["ORD-0001", "note 7", "5 apples", "-", "1e5", None]
    assert values(spark, numbers.looks_numeric, yes + no) == [True] * len(yes) + [False] * len(no)


def test_half_even_cents(spark):
    pairs = {0.125: 0.12, 1.005: 1.0, 2.675: 2.68, 1234.565: 1234.56, 33.335: 33.34, 0.015: 0.02}
    df = spark.createDataFrame([(k,) for k in pairs], "v double")
    got = [r["x"] for r in df.select(numbers.cents(F.col("v")).alias("x")).collect()]
    assert got == list(pairs.values())


def test_contact_and_identifier_shapes(spark):
    phones = {"(082) 000 0899": "+27820000899", "27 82 0000769": "+27820000769",
              "+27 82 1": "+27821", "0027 82 1": "+27027821"}
    assert values(spark, text.phone, list(phones)) == list(phones.values())
    ids = {"ac - north_1042": "AC-NORTH-1042", "AC-NORTH-1042 ": "AC-NORTH-1042", " a  b ": "A B",
           "x__y": "X--Y"}
    got = values(spark, text.client_id, list(ids))
    assert got == list(ids.values())
    assert values(spark, text.client_id, got) == got
    assert values(spark, text.email, [" A b@C.Com "]) == ["ab@c.com"]


def test_names(spark):
    titles = {"o'brien (pty) ltd": "O'Brien (Pty) Ltd", "3m npc": "3M Npc",
              "mc-donald cc": "Mc-Donald Cc", "élan vital INC": "Élan Vital Inc",
              "van der merwe": "Van Der Merwe"}
    assert values(spark, text.title_case, list(titles)) == list(titles.values())
    names = {"o'brien (pty) ltd": "O'Brien (Pty) Ltd", "acme pty ltd": "Acme (Pty) Ltd",
             "3m  npc": "3M NPC", "mc-donald cc": "Mc-Donald CC", "accord": "Accord"}
    assert values(spark, text.proper_name, list(names)) == list(names.values())


def test_status_fold(spark):
    words = {"Paid": "PAID", " past-due ": "OVERDUE", "in  progress": "PENDING",
             "Credit Note": "CANCELLED", "Wholesale": "Wholesale", " ": "UNASSIGNED",
             None: "UNASSIGNED", "P": "PAID"}
    assert values(spark, text.status, list(words)) == list(words.values())


def test_note_tokens_and_badges(spark):
    row = spark.createDataFrame([("ZERO AMOUNT | call | ZERO AMOUNT || STALE DATE | call ",)],
                                "n string")
    tokens = text.note_tokens(F.col("n"))
    got = row.select(text.known_flag_tokens(tokens).alias("k"),
                     text.free_text_tokens(tokens).alias("f")).first()
    assert got["k"] == ["ZERO AMOUNT", "STALE DATE"] and got["f"] == ["call"]
    assert values(spark, text.status_badge, ["PAID", "urgent", "Retail", ""]) == [
        "PAID", "REVIEW", "CUSTOM", "UNASSIGNED"]


def test_money_text(spark):
    df = spark.createDataFrame([(1284930.4,), (None,)], "v double")
    got = [r[0] for r in df.select(numbers.money_text(F.col("v"), "R", 0)).collect()]
    assert got == ["R 1,284,930", "R 0"]
    assert df.select(numbers.money_text(F.col("v"), "", 2)).first()[0] == "1,284,930.40"


def test_labels_are_compiled(spark):
    """A lambda would be interpreted for each row, with all the conditions below it."""
    from tallymark.constants import Options
    from tallymark.operators.rules import Context, flags_column
    df = spark.createDataFrame([(1,), (None,), (3,)], "n int")
    found = text.labels([("ONE", F.col("n") == 1), ("ODD", F.col("n") % 2 == 1), ("NO", F.col("n") > 9)])
    got = {r["n"]: r["labels"] for r in df.select("n", found.alias("labels")).collect()}
    assert got == {1: ["ONE", "ODD"], None: [], 3: ["ODD"]}
    ctx = Context(Options(order_by="id").resolved(), frozenset({"Email", "Phone"}))
    rows = spark.createDataFrame([], "_date date, Client_ID string, _status_blank boolean, _amount double, "
                                     "Amount double, Status string, _duplicate boolean, _same_day boolean, "
                                     "_breach boolean, Email string, Phone string, _listed boolean")
    plan = rows.select(flags_column(ctx))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_tidy_cells_need_no_second_trim(spark):
    cells = ["", " a ", "o'hara  x (pty) ltd", "past - due", "N/A", " é  ß-b", "a\tb\n", "\x1ca", "A_b c", "x 　y", None]
    for fn in (text.client_id, text.reference, text.status, text.email, text.proper_name):
        want = values(spark, lambda c, f=fn: f(text.tidy(c)), cells)
        assert values(spark, lambda c, f=fn: f(text.tidy(c), is_tidy=True), cells) == want
    assert values(spark, text.strip_cell, cells) == values(spark, text.strip, cells)
    plan = spark.range(1).select(text.tidy(F.col("id").cast("string")).alias("t")).select(
        text.client_id(F.col("t"), True), text.reference(F.col("t"), True))
    assert plan._jdf.queryExecution().analyzed().toString().lower().count("trim(") == 1, "tidy's own"


def test_title_case_of_ascii_reads_no_array(spark):
    cells = ["o'hara  building", "x-y.z 3rd", "mcDONALD", "éa b'c", "a\x00b", "", None, "'a", "a'"]
    want = ["O'Hara  Building", "X-Y.Z 3Rd", "Mcdonald", "Éa B'C", "A\x00B", "", None, "'A", "A'"]
    assert values(spark, text.title_case, cells) == want
    marked = spark.range(1).select(text.title_case(F.lit("o'hara").substr(F.lit(1), F.col("id").cast("int") + 6)).alias("t"))
    assert "initcap(regexp_replace" in marked._jdf.queryExecution().analyzed().toString()
