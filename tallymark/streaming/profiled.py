"""The profile of all drops of a stream, from a small state and no row twice.

Each drop is cleaned as the universal run does it and becomes one state (see
``operators.sketches``), which a commit makes visible. States are merged by levels, so what a drop
costs does not grow with those before it and a profile reads a handful of states.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, types as T

from ..constants import Options
from ..operators.sketches import Accuracy, Sketched, merged, sketched, state
from ..plans.universal import sanitise
from .commits import CommitLog, Run, levelled


def _write(states: DataFrame, out_path: str, level: int) -> str:
    name = f"states/run-{level}-{uuid.uuid4().hex}"
    states.coalesce(1).write.parquet(f"{out_path}/{name}")
    return name


def _merged(spark: SparkSession, out_path: str, runs: list[Run], a: Accuracy) -> DataFrame:
    return merged(reduce(DataFrame.union, [spark.read.parquet(f"{out_path}/{n}") for n, _ in runs]), a)


def profile_stream(spark: SparkSession, in_path: str, schema: T.StructType, out_path: str,
                   checkpoint: str, o: Options | None = None, a: Accuracy | None = None,
                   fmt: str = "parquet", **read_options):
    """Take up what has arrived and stop; run it again, with the same options and accuracy, for
    the next drop. A batch repeated after a failure counts once."""
    o, a = o or Options(), a or Accuracy()

    def handle(batch: DataFrame, batch_id: int) -> None:
        log = CommitLog(spark, out_path)
        if log.has(batch_id):
            return
        run = _write(state(sanitise(batch, o), o, a), out_path, 0)
        runs = [*log.snapshot().runs, (run, 0)]
        log.publish(batch_id, levelled(runs, lambda same, level: _write(
            _merged(spark, out_path, same, a), out_path, level)))

    stream = spark.readStream.schema(schema).format(fmt).options(**read_options).load(in_path)
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_profile(spark: SparkSession, out_path: str, a: Accuracy | None = None) -> Sketched:
    """The profile of all rows that the newest commit stands for, and its bounds."""
    a, runs = a or Accuracy(), list(CommitLog(spark, out_path).snapshot().runs)
    if not runs:
        raise ValueError(f"no batch has been committed to {out_path}")
    return sketched(_merged(spark, out_path, runs, a), a)
