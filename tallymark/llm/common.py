"""Helpers of this package: the shared work folder, table input and word hashes of byte buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Bytes that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one is set only for a session of one machine without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        checkpoints = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = checkpoints.get() if checkpoints.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/checkpoints"
    return f"{folder.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def settle_path(df: DataFrame, name: str) -> str:
    """Where df was written as Parquet, in the shared folder."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends here."""
    return df.sparkSession.read.schema(df.schema).parquet(settle_path(df, name))


def words(text: Column) -> Column:
    """The words of a text (runs without ASCII white space) as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to n."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, STEP_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any slice of data follows (see slice_hash)."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return sums


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal slices have equal hashes wherever they start."""
    _, down = powers(len(sums))
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def steps(values: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A binary or string array in steps of rows: first row, row after the last, bytes, offsets."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    values = values.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(values):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP_BYTES, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def not_space(data: np.ndarray) -> np.ndarray:
    return ~((data == 32) | ((data >= 9) & (data <= 13)))


def letters(data: np.ndarray) -> np.ndarray:
    """ASCII letters and digits, and every byte of other characters."""
    low = data | np.uint8(32)
    return (data >= 128) | ((low >= 97) & (low <= 122)) | ((data >= 48) & (data <= 57))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside=not_space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the text that each is in."""
    inside = inside(data)
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside=not_space) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, and the number of the text that it is in."""
    starts, ends, owner = word_spans(data, offsets, inside)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), owner
    return slice_hash(prefix_hash(data), starts, ends), owner


def shingle_sets(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, sorted, and their texts; fewer words are one shingle."""
    if not len(hashes):
        return hashes, owner
    count = np.bincount(owner)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    length = np.minimum(count, n)
    place = np.arange(len(hashes)) - first[owner]
    at = np.flatnonzero(place <= (count - length)[owner])
    total = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        have = length[owner[at]] > k
        part = mix64(hashes[np.minimum(at + k, len(hashes) - 1)] + np.uint64(k * 0x632BE59BD9B4E019 % (1 << 64)))
        total = total * np.uint64(0xD6E8FEB86659FD93) + np.where(have, part, np.uint64(k + 1))
    shingles, texts = mix64(total), owner[at]
    order = np.lexsort((shingles, texts))
    shingles, texts = shingles[order], texts[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (texts[1:] != texts[:-1])
    return shingles[new], texts[new]


#: Rows of a few short fields that are broadcast at most (some tens of MB).
SMALL_ROWS = 500_000


def small(settled: DataFrame) -> DataFrame:
    """A settled narrow table, marked for a broadcast if its counted rows allow one."""
    return F.broadcast(settled) if settled.count() <= SMALL_ROWS else settled
