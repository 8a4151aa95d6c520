"""Intermediate tables in the cluster's shared folder.

A settled table is written once and read back, so its lineage is cut and a lost
executor costs one read. Its size is measured while it is written, which is
what every broadcast decision in this package rests on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Settled:
    df: DataFrame
    rows: int
    bytes: int
    weight: int = 0
    path: str = ""

    @property
    def broadcastable(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.bytes <= BROADCAST_BYTES


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or by ``tune(work_dir=...)``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir, or tune(spark, work_dir=...), to a folder "
                         "every executor can reach")
    return folder.rstrip("/")


_OPEN: ContextVar[list | None] = ContextVar("settled tables of the plan being built", default=None)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The folders of all tables settled inside, for ``discard`` later."""
    paths: list[str] = []
    token = _OPEN.set(paths)
    try:
        yield paths
    finally:
        _OPEN.reset(token)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete settled tables. What reads them can no longer run."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while paths:
        place = jvm.org.apache.hadoop.fs.Path(paths.pop())
        place.getFileSystem(conf).delete(place, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside are deleted as soon as it has run, not whenever the driver
    collects its garbage. For tables that are settled or written: a frame run twice would shuffle twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Rows of one file of a table that is spread, and of one file of a drop.
FILE_ROWS = 50_000


def spread(df: DataFrame, rows: int = FILE_ROWS) -> DataFrame:
    """``df`` settled in files of about ``rows`` rows each. Costly expressions over a table of few files, or of
    files that are one row group each, would run in few tasks; for narrow tables, as all rows are shuffled."""
    done = settle(df)
    return settle(done.df.repartition(-(-done.rows // rows))).df if done.rows > rows else done.df


def settle(df: DataFrame, weight: str | None = None) -> Settled:
    """Write ``df`` to the shared folder and read it back, with its measured
    size. ``weight`` names a column to add up on the way (source rows)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallymark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if (paths := _OPEN.get()) is not None:
        paths.append(path)
    size = F.lit(8 * len(df.columns)).cast("bigint")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
    seen = Observation()
    total = F.sum(weight) if weight else F.lit(0).cast("bigint")
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"),
                         F.max(total).alias("weight") if not weight else total.alias("weight"))
    # A dictionary costs a lookup for each cell written, and a copy each time an expression reads it.
    watched.write.option("parquet.enable.dictionary", "false").parquet(path)
    got = seen.get
    return Settled(spark.read.schema(df.schema).parquet(path), got["rows"], got["bytes"] or 0,
                   got["weight"] or 0, path)
