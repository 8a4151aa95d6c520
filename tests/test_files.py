"""Sources, sinks, history and streaming."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from catalogue import files
from catalogue.fixture import ledger_raw
from catalogue.ledger import OPTIONS, QUERIES
from tallymark import Options, run
from tallymark.operators import staging
from tallymark.operators.staging import spread
from tallymark.sources import delimited, sinks
from tallymark.streaming import ingest
from tallymark.streaming.commits import CommitLog
from tallymark.streaming.ingest import ingest_stream, ingested

O = Options(order_by="row_id", as_of=dt.date(2001, 8, 1))


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separators(spark, tmp_path, sep):
    (tmp_path / "f.csv").write_text("﻿a{0}b c\n\n1{0}x\n\nNA{0}\"q\"\"{0}z\"\n".format(sep))
    df = delimited.read_delimited(spark, str(tmp_path / "f.csv"))
    assert df.columns == ["a", "b c"]
    assert sorted(map(tuple, df.collect()), key=str) == [("1", "x"), (None, f'q"{sep}z')]


def test_latin1_and_single_column(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("name;v\ncafé;1\n".encode("latin-1"))
    df = delimited.read_delimited(spark, str(tmp_path / "l.csv"))
    assert df.first()["name"] == "café"
    (tmp_path / "s.csv").write_text("only\n1\n2\n")
    assert delimited.read_delimited(spark, str(tmp_path / "s.csv")).count() == 2
    (tmp_path / "e.csv").write_text("\n")
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(tmp_path / "e.csv"))


def test_file_order_gives_a_repeatable_first_row(spark, tmp_path):
    (tmp_path / "d.csv").write_text("date,status,amount\n" + "2001-01-01,Paid,5\n" * 3)
    df = delimited.stage_delimited(spark, str(tmp_path / "d.csv"), str(tmp_path / "staged"))
    r = run(df, Options(order_by="row_order", as_of=dt.date(2001, 8, 1)))
    flagged = r.clean.filter("array_contains(flags, 'DUPLICATE ENTRY')")
    rows = sorted(x["row_order"]["row"] for x in df.collect())
    assert sorted(x["row_order"]["row"] for x in flagged.collect()) == rows[1:]


def test_folders_of_unequal_files_keep_their_lines_in_order(spark, tmp_path):
    for name, n in (("a", 3), ("b", 50), ("c", 7)):
        lines = "".join(f"{name},{i}\n" for i in range(n))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.csv").write_text("file,line\n" + lines)
    want = [(name, str(i)) for name, n in (("a", 3), ("b", 50), ("c", 7)) for i in range(n)]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for i, width in enumerate(("128m", "64")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", width)
        df = delimited.stage_delimited(spark, str(tmp_path / "in"), str(tmp_path / f"out{i}"))
        got = [(r["file"], r["line"]) for r in df.orderBy("row_order").collect()]
        assert got == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def messy_lines(n, seed):
    """Records with quotes, separators and line breaks in cells, and what they say."""
    rng, text, want = random.Random(seed), [], []
    for i in range(n):
        cells = [str(i)]
        for _ in range(2):
            cells.append("".join(rng.choice(["a", "bc", " ", ",", '"', "\n", "\n\n", "é"]) for _ in range(rng.randrange(1, 9))) if rng.random() < 0.4
                         else rng.choice(["plain", '5" pipe', "x y"]))
        want.append(tuple(cells))
        text.append(",".join('"' + c.replace('"', '""') + '"' if c.startswith('"') or set(c) & {",", "\n"} or '"' in c and c != '5" pipe' else c for c in cells))
        if rng.random() < 0.1:
            text.append("")
    return "number,one,two\n" + "\n".join(text) + "\n", want


@pytest.mark.parametrize("multiline", [False, True])
def test_rows_have_one_number_however_files_are_split(spark, tmp_path, multiline):
    (tmp_path / "in").mkdir()
    want = {}
    for k in range(2):
        text, rows = messy_lines(120, k)
        if not multiline:
            rows = [(str(i), f"v{k}", "w") for i in range(120)]
            text = "number,one,two\n" + "\n".join(",".join(r) for r in rows) + "\n\n"
        (tmp_path / "in" / f"f{k}.csv").write_text(text)
        want |= {(f"f{k}.csv", i): r for i, r in enumerate(rows)}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for i, width in enumerate(("128m", "700", "97")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", width)
            df = delimited.stage_delimited(spark, str(tmp_path / "in"), str(tmp_path / f"out{i}"), encoding="UTF-8", multiline=multiline)
            if i:
                assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 2
            got = {(r["row_order"]["file"].rsplit("/", 1)[1], r["row_order"]["row"]): (r["number"], r["one"], r["two"]) for r in df.collect()}
            assert got == {k: tuple(None if c == "" else c for c in v) for k, v in want.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_quoted_headers_and_no_separator(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"Amount, net";Date\n1;2001-01-01\n')
    assert delimited.read_delimited(spark, str(tmp_path / "q.csv")).columns == ["Amount, net", "Date"]
    (tmp_path / "n.csv").write_text("a~b~c\n1~2~3\n")
    with pytest.raises(ValueError, match="separators"):
        delimited.read_delimited(spark, str(tmp_path / "n.csv"))


def test_order_keys_must_order(spark):
    rows = [(1, "2001-01-01", "c", "Paid", 5.0), (1, "2001-01-01", "c", "Paid", 5.0)]
    schema = "i int, date string, client string, status string, amount double"
    for broken in (rows, [(None, *rows[0][1:]), rows[1]]):
        with pytest.raises(ValueError, match="unique and not null"):
            run(spark.createDataFrame(broken, schema), Options(order_by="i"))


def test_order_over_many_files(spark, tmp_path):
    for i, n in ((1, 3), (0, 2), (2, 4)):
        spark.range(n).selectExpr(f"id + {i} * 10 AS v").coalesce(1).write.parquet(
            str(tmp_path / "t" / f"part={i}"))
    df = delimited.read_ordered(spark, str(tmp_path / "t"))
    got = [r["v"] for r in df.orderBy("row_order").collect()]
    assert got == [0, 1, 10, 11, 12, 20, 21, 22, 23]
    assert df.select("row_order").distinct().count() == 9


def test_export_and_history(spark, sf, tmp_path):
    r = run(ledger_raw(spark, sf), O)
    places = sinks.export_report(r, str(tmp_path / "out"))
    assert set(places) == {"cleaned_data", "status_pivot", "run_metrics", "flag_breakdown"}
    data = spark.read.parquet(places["cleaned_data"])
    assert "Flagged" not in data.columns and "row_id" not in data.columns
    path = str(tmp_path / "history")
    for day in (1, 3, 2):
        sinks.append_history(r, path, f"file{day}", 0.1, dt.datetime(2001, 8, day))
    runs = [x["Source File"] for x in sinks.read_history(spark, path).collect()]
    assert runs == ["file3", "file2", "file1"]
    sinks.export_history(spark, path, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3


def test_stream_picks_up_each_drop_once(spark, sf, tmp_path):
    raw = ledger_raw(spark, sf)
    drop, out, mark = (str(tmp_path / n) for n in ("drop", "out", "mark"))
    half = raw.filter("row_id % 20 < 10")
    half.coalesce(1).write.mode("append").parquet(drop)
    for _ in range(2):      # the second start finds nothing new
        ingest_stream(spark, drop, raw.schema, out, mark, O).awaitTermination()
    rest = raw.filter("row_id % 20 >= 10")
    rest.coalesce(1).write.mode("append").parquet(drop)
    ingest_stream(spark, drop, raw.schema, out, mark, O).awaitTermination()
    clean, history = ingested(spark, out, O)
    blank = run(half, O).metrics().first()["blank_dropped"]
    blank += run(rest, O).metrics().first()["blank_dropped"]
    assert clean.count() == raw.count() - blank
    whole = {r["row_id"]: r["flags"] for r in run(raw, O).clean.collect()}
    assert {r["row_id"]: r["flags"] for r in clean.collect()} == whole
    assert history.count() == 2 and clean.select("row_id").distinct().count() == clean.count()


def test_history_of_a_stream_counts_its_rows(spark, sf):
    got = QUERIES["stream_history"](spark, sf).collect()
    m = run(ledger_raw(spark, sf), OPTIONS).metrics().first()
    assert [tuple(r) for r in got] == [("Sales", m["rows_in"], m["rows_out"], m["flagged"])]


LEDGER = "id int, date string, client string, status string, amount double, credit_limit double"


def drops(spark, folder):
    """A function that ingests one more drop of (id, date, client, status, amount, limit)."""
    def more(rows):
        frame = spark.createDataFrame(rows, LEDGER)
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/drop")
        ingest_stream(spark, f"{folder}/drop", frame.schema, f"{folder}/out", f"{folder}/mark",
                      Options(order_by="id", as_of=dt.date(2001, 8, 1))).awaitTermination()
    return more


def flags(spark, folder):
    with_keys = ingested(spark, f"{folder}/out", Options(order_by="id", as_of=dt.date(2001, 8, 1)))
    found = {(r["batch"], r["id"]): set(r["flags"]) for r in with_keys.clean.collect()}
    with_keys.close()
    return found


def test_drops_whose_keys_start_anew(spark, tmp_path):
    more = drops(spark, tmp_path)
    rows = [(0, "2001-07-01", "a", "Paid", 60.0, 100.0), (1, "2001-07-02", "b", "Paid", 5.0, None)]
    more(rows)
    assert not any("DUPLICATE ENTRY" in f for f in flags(spark, tmp_path).values())
    more(rows)
    got = flags(spark, tmp_path)
    copies = {k for k, f in got.items() if "DUPLICATE ENTRY" in f}
    assert copies == {(1, 0), (1, 1)} and len(got) == 4
    assert {k for k, f in got.items() if "SAME-DAY DUPLICATE" in f} == copies
    assert {k for k, f in got.items() if "CREDIT LIMIT BREACH" in f} == {(0, 0), (1, 0)}
    with pytest.raises(Exception, match="within a drop"):
        more([rows[0], (0, "2001-07-03", "c", "Paid", 1.0, None)])
    assert len(flags(spark, tmp_path)) == 4


DROPS = ([(0, "2001-07-01", "a", "Paid", 60.0, 100.0), (1, "2001-07-02", "b", "Paid", 5.0, None),
          (2, "2001-07-02", "c", "Paid", 7.0, 10.0), (3, "2001-07-02", None, "Paid", 7.0, 5.0),
          (4, "2001-07-02", None, "Paid", 7.0, 500.0), (5, None, "c", "Paid", 0.0, -1.0)],
         [(1, "2001-07-01", "a", "Paid", 60.0, None), (0, "2001-07-02", "c", "Open", 7.0, 9.0),
          (7, "2001-07-03", "b", "Paid", 5.0, 4.0), (8, None, "c", "Paid", 0.0, None)])


def test_streamed_rows_are_judged_without_a_shuffle_of_them(spark, tmp_path, monkeypatch):
    more = drops(spark, tmp_path / "usual")
    for rows in DROPS:
        more(rows)
    usual = flags(spark, tmp_path / "usual")
    copies = {k for k, f in usual.items() if "DUPLICATE ENTRY" in f}
    assert copies == {(0, 4), (1, 0), (1, 1), (1, 8)}
    assert {k for k, f in usual.items() if "CREDIT LIMIT BREACH" in f} == {(0, 0), (0, 2), (0, 3), (1, 0), (1, 7)}
    monkeypatch.setattr(staging, "BROADCAST_ROWS", 0)       # as if the facts were large
    monkeypatch.setattr(ingest, "GROUPED_ROWS", 2)
    more = drops(spark, tmp_path / "large")
    for rows in DROPS:
        more(rows)
    assert flags(spark, tmp_path / "large") == usual
    found = ingested(spark, f"{tmp_path}/large/out", Options(order_by="id", as_of=dt.date(2001, 8, 1)))
    plan = found.clean._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    found.close()
    # Where not even bitmaps can be broadcast.
    monkeypatch.setattr(staging, "BROADCAST_BYTES", 0)
    assert flags(spark, tmp_path / "large") == usual


def test_folders_begun_without_row_numbers_stay_so(spark, tmp_path, monkeypatch):
    more = drops(spark, tmp_path)
    numbered = ingest._numbered
    monkeypatch.setattr(ingest, "_numbered", lambda *_: False)
    more(DROPS[0])
    monkeypatch.setattr(ingest, "_numbered", numbered)
    more(DROPS[1])
    assert ingest.AT not in spark.read.parquet(f"{tmp_path}/out/rows").columns
    got = flags(spark, tmp_path)
    assert {k for k, f in got.items() if "DUPLICATE ENTRY" in f} == {(0, 4), (1, 0), (1, 1), (1, 8)}


def test_an_ingested_drop_leaves_no_shuffle_files(spark, tmp_path):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffles()
    more = drops(spark, tmp_path)
    for rows in DROPS:
        more(rows)
    flags(spark, tmp_path)
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.2)
    assert not left


def test_a_reader_sees_whole_drops_only(spark, tmp_path, monkeypatch):
    more = drops(spark, tmp_path)
    row = (0, "2001-07-01", "a", "Paid", 60.0, 100.0)
    more([row])
    publish = CommitLog.publish

    def stop(*_):
        raise RuntimeError("stopped before the commit")

    monkeypatch.setattr(CommitLog, "publish", stop)
    with pytest.raises(Exception, match="before the commit"):
        more([row, (1, "2001-07-02", "b", "Paid", 5.0, None)])
    before = ingested(spark, f"{tmp_path}/out", Options(order_by="id"))
    assert before.clean.count() == 1 and before.history.count() == 1
    monkeypatch.setattr(CommitLog, "publish", publish)
    more([(0, "2001-07-09", "z", "Paid", 1.0, None)])
    assert before.clean.count() == 1, "what was read stays as it was"
    after = ingested(spark, f"{tmp_path}/out", Options(order_by="id"))
    assert sorted((r["batch"], r["id"]) for r in after.clean.collect()) == [(0, 0), (1, 0), (1, 1), (2, 0)]
    assert after.history.count() == 3
    with pytest.raises(RuntimeError, match="another writer"):
        CommitLog(spark, f"{tmp_path}/out").publish(2, [])
    with pytest.raises(ValueError, match="no batch"):
        ingested(spark, f"{tmp_path}/none", Options(order_by="id"))


def test_runs_of_the_state_are_merged_by_level(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "RUNS", 2)
    groups = spark.createDataFrame([("2001-07-01", "a", 5.0, "r", dt.date(2001, 7, 1), "a", 3, None)],
                                   "Date string, Client_ID string, Amount double, Reference string, _date date, "
                                   "_client string, _rows bigint, _least double")
    runs, rewritten = [], 0
    for batch in range(7):
        first = groups.withColumn("_first", F.struct(F.lit(batch).alias("batch"), F.lit(0).alias("key")))
        runs.append((ingest._write_run(first.select(*groups.columns[:6], "_first", "_rows", "_least"), str(tmp_path), 0), 0))
        before = {name for name, _ in runs}
        runs = ingest.compacted(spark, str(tmp_path), runs)
        rewritten += len({name for name, _ in runs} - before)
    assert sorted(level for _, level in runs) == [0, 1, 2] and rewritten == 3
    merged = ingest._read_runs(spark, str(tmp_path), runs).collect()
    assert [(r["_rows"], r["_first"]["batch"]) for r in merged] == [(21, 0)]
    CommitLog(spark, str(tmp_path)).publish(6, runs)
    assert len(ingest.vacuum(spark, str(tmp_path))) == 7 + 4 - 3
    assert ingest._read_runs(spark, str(tmp_path), runs).count() == 1


def test_splits_grow_with_the_files(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("x" * 300_000)
    assert files.split_bytes(spark, str(tmp_path)) == 64 << 10
    monkeypatch.setattr(files, "SPLITS", 2)
    assert files.split_bytes(spark, str(tmp_path)) >= 150_000


def test_drops_of_several_files_keep_their_order(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILE_ROWS", 100)
    rows = ledger_raw(spark, sf)
    last = rows.agg(F.max("row_id")).first()[0]
    quarter = F.floor(F.col("row_id") * 4 / (last + 1))
    path = str(tmp_path / "drop")
    n = files.write_drops(rows, quarter, 4, path)
    assert n > 1, "a drop is spread over files, so that no task has all of it"
    places = spark.read.parquet(path).select(quarter.alias("q"), F.col("_metadata.file_path").alias("f"),
                                             F.col("_metadata.file_modification_time").alias("at"))
    found = places.groupBy("f").agg(F.min("q").alias("q"), F.max("q").alias("upto"), F.max("at").alias("at")).collect()
    assert len(found) == 4 * n and all(r["q"] == r["upto"] for r in found)
    byq = {q: [r["at"] for r in found if r["q"] == q] for q in range(4)}
    assert all(len(v) == n for v in byq.values()) and all(max(byq[q]) <= min(byq[q + 1]) for q in range(3))
    assert spark.read.parquet(path).exceptAll(rows).isEmpty() and spark.read.parquet(path).count() == rows.count()
    few = rows.filter("row_id < 100")
    assert files.write_drops(few, quarter, 4, str(tmp_path / "few")) == 1


def test_a_spread_table_has_files_of_few_rows(spark):
    df = spark.range(1000, numPartitions=1).withColumn("v", F.lit("a"))
    got = spread(df, rows=100)
    assert len(got.inputFiles()) == 10 and got.count() == 1000 and got.select("id").distinct().count() == 1000
    assert spread(df.filter("id < 0"), rows=100).count() == 0
