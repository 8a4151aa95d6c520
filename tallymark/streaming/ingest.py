"""Monthly drops: each new file is cleaned, stored and added to the history.

A drop costs what the drop is worth. Its rows are stored with the flags of the
row-local rules; its group facts (equal entries as one row each) become a run of the state. Runs
of one level are merged when RUNS of them are there, into one of the next level, so a group is rewritten
once a level and the state is a handful of runs however many drops there were. A commit publishes
rows, state and history of a drop together (see ``commits``).

Stored rows carry their number within the drop, and a group the number of its first row, so the firsts
of all groups are bitmaps taken from the state alone: no row is shuffled to learn whether it repeats another. Only
clients, limits and numbers of rows with a limit are, for the exposure.

The order of rows is (batch, order key): keys may start anew in each drop, and must be unique
and not null within one.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import time
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..constants import FLAG_ORDER, Options
from ..functions.text import quoted
from ..operators.marks import settle_marks
from ..operators.staging import collected, discard, freed_shuffles, settle
from ..plans.ledger import (DAY, MARKS, add_marks, cross_facts, cross_groups,
                            flag_rows_locally, judge_rows, merged_groups, published, stored_rows)
from ..sources.sinks import history_row
from .commits import RUNS, CommitLog, levelled

ORDER = "_order"
#: The number of a stored row within its drop; with the batch its place, a column while rows are judged.
AT, PLACE = "_at", "_place"
#: Rows that are grouped at a time: what their shuffle takes of the disk is bounded by it.
GROUPED_ROWS = 20_000_000


def ingest_stream(spark: SparkSession, in_path: str, schema: T.StructType, out_path: str,
                  checkpoint: str, o: Options, fmt: str = "parquet", **read_options):
    """Process what has arrived and stop; run it again for the next drop.

    The history's row about a drop counts what is found within the drop. The duplicate and credit
    rules over all drops are judged by ``ingested``: of equal rows the first is the one of the earliest
    drop, so drops that arrive in key order are judged as one table. A batch repeated after a failure writes its own folders anew, and one whose
    commit is there is left as it is, so nothing doubles. The date rules look at the day on which a batch
    arrived, unless ``as_of`` is given."""
    if o.order_by is None:
        raise ValueError("ingestion needs Options.order_by")

    def handle(batch: DataFrame, batch_id: int) -> None:
        log = CommitLog(spark, out_path)
        if log.has(batch_id) or batch.isEmpty():
            return
        with ExitStack() as held:
            for session in (spark, batch.sparkSession):
                held.enter_context(freed_shuffles(session))
            store(log, batch, batch_id)

    def store(log: CommitLog, batch: DataFrame, batch_id: int) -> None:
        started, today = time.perf_counter(), o.resolved()
        run, rows = stored_rows(batch, today)
        now = log.snapshot()
        if _numbered(spark, out_path, now.batches):
            rows = rows.withColumn(AT, F.monotonically_increasing_id())
        _write(rows, f"{out_path}/rows/batch={batch_id}")
        rows = _ordered(spark.read.parquet(f"{out_path}/rows/batch={batch_id}")
                        .withColumn("batch", F.lit(batch_id).cast("bigint")), o)
        _check_keys(rows, batch_id, o)
        groups = [cross_groups(part, _by_batch(today)) for part in _parts(rows)]
        runs = [*now.runs, (_write_run(groups, out_path, 0), 0)]
        own = spark.read.parquet(f"{out_path}/{runs[-1][0]}")
        with collected() as paths:
            try:
                clean = _judged(rows, own, today)
                row = history_row(dataclasses.replace(run, clean=clean), f"batch {batch_id}",
                                  time.perf_counter() - started, dt.datetime.now())
                row.write.mode("overwrite").parquet(f"{out_path}/history/batch={batch_id}")
            finally:
                discard(spark, paths)
        log.publish(batch_id, compacted(spark, out_path, runs))

    stream = spark.readStream.schema(schema).format(fmt).options(**read_options).load(in_path)
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _by_batch(o: Options) -> Options:
    return dataclasses.replace(o, order_by=ORDER)


def _numbered(spark: SparkSession, out_path: str, batches: tuple[int, ...]) -> bool:
    """Whether the folder's rows have numbers. Folders begun before rows were numbered stay without, as
    all of their groups and rows must be alike."""
    return not batches or AT in spark.read.parquet(f"{out_path}/rows/batch={batches[-1]}").columns


def _ordered(rows: DataFrame, o: Options) -> DataFrame:
    number = [F.col(AT).alias("at")] if AT in rows.columns else []
    return rows.withColumn(ORDER, F.struct("batch", quoted(o.order_by).alias("key"), *number))


def _place(df: DataFrame, order: str) -> Column:
    """What finds a row again: its batch and number, or the order key where it has no number."""
    if "at" not in df.schema[order].dataType.fieldNames():
        return F.col(order)
    return F.struct(F.col(f"{order}.batch").cast("string").alias("file"), F.col(f"{order}.at").alias("row"))


def _write(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("compression", "zstd").parquet(path)


def _check_keys(rows: DataFrame, batch_id: int, o: Options) -> None:
    keys = rows.groupBy(quoted(o.order_by).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    if not keys.filter("n > 1 OR key IS NULL").isEmpty():
        raise ValueError(f"Options.order_by must be unique and not null within a drop; "
                         f"batch {batch_id} repeats or lacks keys of {o.order_by}")


def _write_run(groups: DataFrame | list[DataFrame], out_path: str, level: int) -> str:
    """Write the groups, whole or part by part, as one run; returns its name."""
    name = f"groups/run-{level}-{uuid.uuid4().hex}"
    for part in groups if isinstance(groups, list) else [groups]:
        _write(part, f"{out_path}/{name}", "append")
    return name


def _parts(rows: DataFrame) -> list[DataFrame]:
    """The stored rows, or groups, in parts of about GROUPED_ROWS. Equal entries are in one part."""
    parts = max(1, -(-rows.count() // GROUPED_ROWS))
    part = F.pmod(F.xxhash64("Date", "Client_ID", "Reference"), F.lit(parts))
    return [rows.filter(part == i) for i in range(parts)] if parts > 1 else [rows]


def _merged(spark: SparkSession, out_path: str, runs) -> list[DataFrame]:
    """The groups of several runs as one, in parts."""
    both = reduce(DataFrame.union, [spark.read.parquet(f"{out_path}/{name}") for name, _ in runs])
    return [merged_groups(part) for part in _parts(both)]


def _read_runs(spark: SparkSession, out_path: str, runs) -> DataFrame:
    """The groups of all runs: of one as it lies there, of several merged and settled."""
    if len(runs) == 1:
        return spark.read.parquet(f"{out_path}/{runs[0][0]}")
    return reduce(DataFrame.union, [settle(p).df for p in _merged(spark, out_path, runs)])


def compacted(spark: SparkSession, out_path: str,
              runs: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The runs, with RUNS of one level merged into one of the next. The merged
    ones stay on disk for those who read an older commit, until ``vacuum``."""
    return levelled(runs, lambda same, level: _write_run(
        _merged(spark, out_path, same), out_path, level), RUNS)


def vacuum(spark: SparkSession, out_path: str) -> list[str]:
    """Delete the runs of the state that the newest commit doesn't name, while
    nobody writes or reads an older one; returns their names."""
    live = {name for name, _ in CommitLog(spark, out_path).snapshot().runs}
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{out_path}/groups")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f"groups/{f.getPath().getName()}" for f in fs.listStatus(place)]
    gone = sorted(set(found) - live)
    discard(spark, [f"{out_path}/{name}" for name in gone])
    return gone


def _repeats(rows: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """``name``: the row is not the first of its group."""
    firsts = groups.select(_place(groups, "_first").alias(PLACE), F.lit(True).alias("_is_first"))
    marks = settle_marks(firsts, ["_is_first"], PLACE)
    return marks.bring(rows, PLACE).withColumn(name, ~F.col("_is_first")).drop("_is_first")


def _breaches(rows: DataFrame, groups: DataFrame, o: Options) -> DataFrame:
    """``_breach``: the row's client is exposed beyond the row's limit."""
    by_batch, wants = _by_batch(o), {"_duplicate": False, "_same_day": False, "_breach": True}
    limited = rows.filter("_limit > 0").select("_client", "_limit", ORDER, PLACE)
    with collected() as used:
        facts = cross_facts(groups, wants, by_batch)
    marks = settle_marks(add_marks(limited, facts, by_batch), ["_breach"], PLACE)
    discard(rows.sparkSession, used)
    return marks.bring(rows.drop("_breach"), PLACE)


def _judged(rows: DataFrame, groups: DataFrame, o: Options) -> DataFrame:
    """Stored rows with the labels of the cross-row rules among the local ones."""
    rows = rows.withColumn(PLACE, _place(rows, ORDER))
    marked = rows.withColumns({name: F.lit(False) for name in MARKS[:3]})
    if o.on("R12") and (o.drop_duplicates or o.flag_duplicates):
        marked = _repeats(marked, groups, "_duplicate")
    if o.on("R17"):
        days = groups.groupBy(*DAY).agg(F.min("_first").alias("_first"))
        marked = _repeats(marked, days, "_same_day")
    if o.on("R15"):
        marked = _breaches(marked, groups, o)
    if o.drop_duplicates:
        marked = marked.filter(~F.col("_duplicate"))
    found = {"SAME-DAY DUPLICATE": F.col("_same_day") & F.col("_rules_17"),
             "CREDIT LIMIT BREACH": F.col("_breach") & F.col("_rules_15")}
    if o.flag_duplicates and not o.drop_duplicates:
        found["DUPLICATE ENTRY"] = F.col("_duplicate") & F.col("_rules_12")
    slots = [F.when(F.array_contains("_local", label)
                    | F.coalesce(found.get(label, F.lit(False)), F.lit(False)), F.lit(label))
             for label in FLAG_ORDER]
    judged = judge_rows(marked.withColumn("flags", F.array_compact(F.array(*slots))))
    names = published(judged, o).columns
    return judged.select(*[quoted(n) for n in names], *([] if "batch" in names else ["batch"]))


@dataclasses.dataclass(frozen=True)
class Ingested:
    """All batches of one commit: the clean rows (with their ``batch``) and the
    history, newest first. ``close`` drops the facts that judge the rows."""

    clean: DataFrame
    history: DataFrame
    staged: list[str] = dataclasses.field(default_factory=list, repr=False)

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.clean, self.history))

    def close(self) -> None:
        discard(self.clean.sparkSession, self.staged)


def ingested(spark: SparkSession, out_path: str, o: Options) -> Ingested:
    """What the newest commit holds, judged over all its batches by the options
    they were ingested with."""
    now = CommitLog(spark, out_path).snapshot()
    if not now.batches:
        raise ValueError(f"no batch has been committed to {out_path}")

    def read(name: str) -> DataFrame:
        places = [f"{out_path}/{name}/batch={b}" for b in now.batches]
        found = spark.read.option("basePath", f"{out_path}/{name}").parquet(*places)
        return found.withColumn("batch", F.col("batch").cast("bigint"))

    with collected() as paths, freed_shuffles(spark):
        with collected() as merged:
            groups = _read_runs(spark, out_path, now.runs)
        try:
            clean = _judged(_ordered(read("rows"), o), groups, o)
        finally:
            discard(spark, merged)
    return Ingested(clean, read("history").orderBy(F.desc("Run"), F.desc("batch")), paths)


def flag_stream(stream: DataFrame, o: Options) -> DataFrame:
    """Row-local rules on the stream itself: no state, no shuffle."""
    return flag_rows_locally(stream, o)
