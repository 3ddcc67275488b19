"""Tables as streams in a stated order: slices written one after the other, a batch each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import temporary_path

#: What a state store keeps on disk, for operators with large state.
STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_slices(rows: DataFrame, path: str, slice_column: str, slices: range) -> None:
    """Writes the rows of each slice to a folder of its own, in the order of the numbers: a file stream reads older files first."""
    for k in slices:
        rows.where(F.col(slice_column) == k).coalesce(1).write.mode("overwrite").parquet(f"{path}/slice={k}")


def sliced_stream(rows: DataFrame, slice_column: str, slices: int, path: str | None = None) -> DataFrame:
    """The rows as a stream whose batches are the slices 0, 1, ... ; a file is a batch, so each slice is kept in one."""
    spark = rows.sparkSession
    path = path or temporary_path(spark, "slices")
    write_slices(rows, path, slice_column, range(slices))
    return read_slices(rows, path)


def read_slices(rows: DataFrame, path: str) -> DataFrame:
    """A stream of what write_slices() wrote, with the schema of rows."""
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/slice=*")


def drained(stream: DataFrame, checkpoint: str, put: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs a stream over all there is, and returns when the last batch is committed."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
