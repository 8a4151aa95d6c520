"""A log of commits beside the data: a batch is there once its commit is.

Each batch writes its folders first and then one small file, put in place by a
rename. The file names the batch's folders and the state's live runs, so whoever reads the newest
commit sees whole batches and the state that belongs to them, whatever is being written meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Runs of one level that are merged into one of the next.
RUNS = 4
Run = tuple[str, int]


def levelled(runs: list[Run], merge: Callable[[list[Run], int], str], width: int = RUNS) -> list[Run]:
    """The runs, with ``width`` of one level merged into one of the next, so that a state is rewritten
    once a level and stays a handful of runs. ``merge`` writes the run of a level and names it."""
    level = 0
    while len(same := [r for r in runs if r[1] == level]) >= width:
        runs = [r for r in runs if r[1] != level] + [(merge(same, level + 1), level + 1)]
        level += 1
    return runs


@dataclass(frozen=True)
class Snapshot:
    """What the commits up to one of them hold: batches in order, the live runs
    of the state as (folder, level)."""

    batches: tuple[int, ...]
    runs: tuple[tuple[str, int], ...]


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self._jvm = f"{folder.rstrip('/')}/_commits", spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _place(self, batch: int):
        return self._path(f"batch-{batch:012d}.json")

    def has(self, batch: int) -> bool:
        return self._fs.exists(self._place(batch))

    def publish(self, batch: int, runs: list[tuple[str, int]]) -> None:
        """Make the batch visible, with the runs that hold the state from now on."""
        hidden = self._path(f".{uuid.uuid4().hex}")
        out = self._fs.create(hidden, False)
        try:
            out.write(bytearray(json.dumps({"batch": batch, "runs": runs}).encode()))
        finally:
            out.close()
        if self.has(batch) or not self._fs.rename(hidden, self._place(batch)):
            self._fs.delete(hidden, False)
            raise RuntimeError(f"batch {batch} of {self.folder} was committed by another writer")

    def snapshot(self) -> Snapshot:
        if not self._fs.exists(self._path("")):
            return Snapshot((), ())
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(""))
                       if f.getPath().getName().startswith("batch-"))
        if not names:
            return Snapshot((), ())
        stream = self._fs.open(self._path(names[-1]))
        try:
            last = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        batches = tuple(int(n.removeprefix("batch-").removesuffix(".json")) for n in names)
        return Snapshot(batches, tuple((p, level) for p, level in last["runs"]))
