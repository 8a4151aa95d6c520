"""Delimited files: separator from the header line, encoding from the bytes."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..constants import CSV_NA_TOKENS
from ..functions.text import quoted
from ..operators.staging import BROADCAST_ROWS

SEPARATORS = (",", ";", "\t", "|")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The first candidate that parts the header, quotes respected, into more
    than one column; a header of one plain word is one column."""
    line = spark.read.text(path).filter(F.trim("value") != "").limit(1).first()
    if line is None:
        raise ValueError(f"no lines in {path}")
    header = line["value"].removeprefix("\ufeff")
    for sep in SEPARATORS:
        if len(next(csv.reader([header], delimiter=sep))) > 1:
            return sep
    if re.fullmatch(r'"[^"]*"|[\w .-]+', header.strip()):
        return SEPARATORS[0]
    raise ValueError(f"none of the separators {SEPARATORS} fits the header {header[:200]!r}")


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 when every line is, else Latin-1. One narrow pass, no shuffle."""
    valid = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value")).alias("ok")).first()
    return "UTF-8" if valid["ok"] is not False else "ISO-8859-1"


def read_delimited(spark: SparkSession, path: str, sep: str | None = None,
                   encoding: str | None = None, multiline: bool = False) -> DataFrame:
    """All cells as text, blank lines skipped, the usual missing-value
    spellings null. Name the ``encoding`` of large files: to find it costs a
    pass over them. ``multiline`` allows line breaks inside quotes, at the price
    of files that cannot be split; ``stage_delimited`` splits those too, and
    numbers the rows."""
    sep = sep or sniff_separator(spark, path)
    encoding = encoding or sniff_encoding(spark, path)
    raw = spark.read.csv(path, header=True, inferSchema=False, sep=sep, encoding=encoding,
                         quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE")
    return raw.select(*_cells(raw.columns))


def _cells(names: list[str]) -> list[Column]:
    return [F.when(~quoted(c).isin(*CSV_NA_TOKENS), quoted(c)).alias(c.removeprefix("\ufeff"))
            for c in names]


def read_ordered(spark: SparkSession, path: str, name: str = "row_order") -> DataFrame:
    """Parquet rows with their place, for ``Options.order_by``: a struct of the
    file's path and the row in the file. It is the same however the scan is
    split."""
    place = F.struct(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.row_index").alias("row"))
    return spark.read.parquet(path).select("*", place.alias(name))


def stage_delimited(spark: SparkSession, path: str, out: str, name: str = "row_order",
                    sep: str | None = None, encoding: str | None = None,
                    multiline: bool = False) -> DataFrame:
    """Parse once into Parquet, with the place of each row: its file and its
    number there, from 0. Files are split; the place does not depend on how.

    A task numbers the rows of its splits from anywhere; what is written has these numbers,
    and a row per split says how many rows of the file come before it. ``multiline`` allows line
    breaks (read as \\n) inside quotes, whose two ends may be in different splits."""
    sep = sep or sniff_separator(spark, path)
    encoding = encoding or sniff_encoding(spark, path)
    if multiline:
        rows = _multiline_records(spark, path, f"{out}/lines", sep, encoding, name)
        rows.write.mode("overwrite").parquet(f"{out}/rows")
    else:
        raw = spark.read.csv(path, header=True, inferSchema=False, sep=sep, encoding=encoding,
                             quote='"', escape='"', mode="PERMISSIVE")
        place = F.struct(F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.file_block_start").alias("start"),
                         F.monotonically_increasing_id().alias("row"))
        raw.select(*_cells(raw.columns), place.alias(name)).write.mode("overwrite").parquet(
            f"{out}/rows")
        place = spark.read.parquet(f"{out}/rows").select(f"{name}.*")
        splits = place.groupBy("file", "start").agg(F.min("row").alias("first"),
                                                    F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("file").orderBy("start"))
        splits.select("file", "start", (upto - F.col("n") - F.col("first")).alias("shift")) \
            .write.mode("overwrite").parquet(f"{out}/splits")
    return read_staged(spark, out, name)


def read_staged(spark: SparkSession, out: str, name: str = "row_order") -> DataFrame:
    """What ``stage_delimited`` wrote."""
    rows = spark.read.parquet(f"{out}/rows")
    if len(rows.schema[name].dataType.fields) == 2:
        return rows
    splits = spark.read.parquet(f"{out}/splits").select(
        F.col("file").alias("_file"), F.col("start").alias("_start"), "shift")
    if splits.count() <= BROADCAST_ROWS:
        splits = F.broadcast(splits)
    here = quoted(name)
    joined = rows.join(splits, (here["file"] == F.col("_file")) & (here["start"] == F.col("_start")))
    place = F.struct(here["file"].alias("file"), (here["row"] + F.col("shift")).alias("row"))
    return joined.select(*[quoted(c) for c in rows.columns if c != name], place.alias(name))


_LINES = ("file string, start bigint, line bigint, value string, inside0 boolean, inside1 boolean, "
          "after0 boolean, after1 boolean, record0 bigint, record1 bigint")


def _quote_states(sep: str, encoding: str):
    """Lines of splits, as (file, start, raw line), with what is known of them
    whichever way the split begins, outside (0) or inside (1) of quotes: whether
    the line begins and ends inside, and how many records have begun with it."""
    s = re.escape(sep)
    quoted_field = re.compile(f'(?:^|(?<={s}))"(?:[^"]|"")*"(?=$|{s})')
    opening = re.compile(f'(?:^|(?<={s}))"')
    closing = re.compile('^(?:[^"]|"")*"(?!")')

    def opens(text: str) -> bool:
        return opening.search(quoted_field.sub("", text)) is not None

    def step(text: str) -> tuple[bool, bool]:
        """The state after the line, from outside and from inside."""
        close = closing.match(text)
        return opens(text), True if close is None else opens(" " + text[close.end():])

    def scan(effect: np.ndarray, state: bool) -> np.ndarray:
        """States before each line and after the last. A line that ends in one
        state whatever it began with forgets what came before it."""
        fixed = effect[:, 0] == effect[:, 1]
        flips = np.concatenate(([0], np.cumsum(effect[:, 0] & ~effect[:, 1])))
        last = np.maximum.accumulate(np.concatenate(([0], np.where(fixed, np.arange(1, len(effect) + 1), 0))))
        known = np.where(last > 0, np.concatenate(([state], effect[:, 0]))[last], state)
        return known ^ ((flips - flips[last]) % 2 == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, line, states, records = None, 0, [False, True], [0, 0]
        for batch in batches:
            places = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            cuts = [k for k in range(1, len(places)) if places[k] != places[k - 1]]
            for first, end in zip([0, *cuts], [*cuts, len(places)], strict=True):
                if first == end:
                    continue
                if places[first] != at:
                    at, line, states, records = places[first], 0, [False, True], [0, 0]
                text = [raw.decode(encoding, "replace") for raw in batch.column(2)[first:end].to_pylist()]
                effect = np.array([step(t) if '"' in t else (False, True) for t in text])
                filled = np.array([t.strip() != "" for t in text])
                both = [scan(effect, s) for s in states]
                begun = [n + np.cumsum(~b[:-1] & filled) for b, n in zip(both, records, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end], batch.column(1)[first:end], pa.array(range(line, line + len(text)), pa.int64()),
                     pa.array(text), *[pa.array(b[:-1]) for b in both], *[pa.array(b[1:]) for b in both],
                     *[pa.array(n, pa.int64()) for n in begun]],
                    ["file", "start", "line", "value", "inside0", "inside1", "after0", "after1", "record0", "record1"])
                line += len(text)
                states, records = [bool(b[-1]) for b in both], [int(n[-1]) for n in begun]
    return run


def _multiline_records(spark: SparkSession, path: str, staged: str, sep: str, encoding: str,
                       name: str) -> DataFrame:
    """The records of files whose quoted cells may hold line breaks. Only the
    lines of records of several lines are grouped."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("raw"))
    lines.mapInArrow(_quote_states(sep, encoding), _LINES).write.mode("overwrite").parquet(staged)
    lines = spark.read.parquet(staged)
    last = [F.max_by(c, "line").alias(c) for c in ("after0", "after1", "record0", "record1")]
    splits = lines.groupBy("file", "start").agg(*last)
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.sum((F.col("after0") & ~F.col("after1")).cast("int"))
    fixed = F.when(F.col("after0") == F.col("after1"), F.struct(F.col("after0").alias("state"), "flips"))
    splits = splits.withColumn("flips", flips.over(order))
    known = F.last(fixed, ignorenulls=True).over(before)
    so_far = F.coalesce(F.lag("flips").over(order), F.lit(0))
    # Inside when the last split that fixes the state ends inside, or flips since then are odd; not both.
    odd = (so_far - F.coalesce(known["flips"], F.lit(0))) % 2 == 1
    splits = splits.withColumn("begins", F.coalesce(known["state"], F.lit(False)) != odd)
    own = F.when(F.col("begins"), F.col("record1")).otherwise(F.col("record0"))
    records = F.coalesce(F.sum(own).over(before), F.lit(0))
    splits = splits.select(F.col("file").alias("_file"), F.col("start").alias("_start"), "begins", records.alias("before"))
    if splits.count() <= BROADCAST_ROWS:
        splits = F.broadcast(splits)
    rows = lines.join(splits, (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")))

    def either(column: str) -> Column:
        return F.when(F.col("begins"), F.col(f"{column}1")).otherwise(F.col(f"{column}0"))

    rows = rows.select("file", (F.col("before") + either("record") - 1).alias("row"), "start", "line", "value",
                       either("inside").alias("inside"), either("after").alias("after"))
    single = rows.filter("NOT inside AND NOT after AND trim(value) != ''").select("file", "row", "value")
    parts = F.sort_array(F.collect_list(F.struct("start", "line", "value")))
    several = rows.filter("inside OR after").groupBy("file", "row").agg(parts.alias("parts")).select(
        "file", "row", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    records = single.union(several)
    head = records.filter("row = 0").orderBy("file").limit(1).first()
    if head is None:
        raise ValueError(f"no lines in {path}")
    header = next(csv.reader([head["value"].removeprefix("\ufeff")], delimiter=sep))
    cells = F.from_csv("value", _ddl(header),
                       {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"})
    parsed = records.filter("row > 0").select(cells.alias("c"), F.struct("file", (F.col("row") - 1).alias("row")).alias(name))
    flat = parsed.select(*[F.col("c").getField(c).alias(c) for c in header], name)
    return flat.select(*_cells(header), name)


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` string" for c in names)


def source_metadata(df: DataFrame, name: str) -> DataFrame:
    """Name, bytes, rows, columns, load time of a file-backed table: one pass
    over file metadata, grouped by file before anything is added up."""
    files = (df.select(F.col("_metadata.file_path").alias("f"),
                       F.col("_metadata.file_size").alias("b"))
             .groupBy("f").agg(F.max("b").alias("b"), F.count(F.lit(1)).alias("n")))
    return files.agg(F.lit(name).alias("name"), F.sum("b").alias("size_bytes"),
                     F.sum("n").alias("rows"),
                     F.lit(len(df.columns)).cast("bigint").alias("cols"),
                     F.current_timestamp().alias("loaded"))
