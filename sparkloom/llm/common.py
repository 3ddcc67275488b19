"""Helpers shared by the text operators: scratch tables in the shared folder, Arrow access, byte-level hashing."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import shared_dir

#: Cleans up the shuffle files of a query once its result is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Intermediate tables under the shared folder: they cut the lineage, so a lost executor costs one stage only."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self.delete)

    def table(self, df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
        """Writes df and reads it again; the shuffle files behind it are dropped."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        schema = df.schema
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", compression).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes the files behind tables that no later result reads."""
        for t in tables:
            for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                self._remove(path)

    def delete(self) -> None:
        try:
            self._remove(self.root)
        except Exception:  # the session has ended: the shared folder's owner clears it
            return

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


#: The folder that holds this package.
HOME = str(Path(__file__).resolve().parents[2])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Before Python runs on executors: bounds the rows of an Arrow batch, as texts may be long, and lets workers find this
    package where the session was started without it on their path."""
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if HOME not in known:
        environment["PYTHONPATH"] = ":".join([HOME, *known])
    if int(spark.conf.get(BATCH_ROWS)) > rows:
        spark.conf.set(BATCH_ROWS, str(rows))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, end to end, and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def random_words(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit words; the same on every machine."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x2545F4914F6CDD1D & (2**64 - 1))
    return mix64(mix64(x))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (xor, shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Odd base of the polynomial hash modulo 2**64.
BASE = 0xB5AD4ECEDA1CE2A9
BYTE_WORDS = random_words(7, 256)


def gram_hash(words: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q words, by doubling: log2(q) vector passes."""
    m = (1 << 64) - 1
    have, size, out, at = words, 1, None, 0
    while True:
        if q & size:
            if out is None:
                out, at = have, size
            else:
                n = len(words) - (at + size) + 1
                out = out[:n] * np.uint64(pow(BASE, size, 1 << 64)) + have[at : at + n]
                at += size
        if size * 2 > q:
            return out
        n = len(have) - size
        have = have[:n] * np.uint64(pow(BASE, size, 1 << 64) & m) + have[size : size + n]
        size *= 2


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w keys, by doubling."""
    size = 1
    while size * 2 <= w:
        keys = np.minimum(keys[: len(keys) - size], keys[size:])
        size *= 2
    rest = w - size
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, in sorted columns."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the runs, and the run that each belongs to."""
    lengths = np.asarray(lengths, np.int64)
    of = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - first[of] + np.asarray(starts, np.int64)[of], of
