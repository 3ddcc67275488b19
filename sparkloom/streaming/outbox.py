"""Messages of a stream, each given out once: an outbox keyed by (batch, key), and a relay that remembers what it has sent.

A batch writes its messages to its own folder of the outbox. If it is repeated after a failure it overwrites them, so a
message is there once. The relay sends the folders that aren't in its log, and logs a folder when all of it is sent; a
message carries an id made of its batch and key, by which a receiver tells a repeated delivery.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

MESSAGE = "message_id string, kind string, key string, body string"


def message(kind: str, key: Column, body: Column) -> list[Column]:
    """The columns of a message."""
    return [F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.to_json(body).alias("body")]


class Outbox:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame, batch: int) -> None:
        """rows(kind, key, body): the messages of a batch; of several with one kind and key one stays."""
        ident = F.sha2(F.concat_ws("\x1f", F.lit(str(batch)), "kind", "key"), 256)
        once = rows.groupBy("kind", "key").agg(F.min("body").alias("body"))
        once.select(ident.alias("message_id"), "kind", "key", "body").write.mode("overwrite").parquet(f"{self.path}/messages/batch={batch}")

    def messages(self) -> DataFrame:
        return self.spark.read.schema(f"{MESSAGE}, batch long").option("basePath", f"{self.path}/messages").parquet(f"{self.path}/messages/batch=*")

    def sent(self) -> set[int]:
        """The batches that the relay has sent."""
        try:
            return {r[0] for r in self.spark.read.schema("batch long").parquet(f"{self.path}/sent").collect()}
        except AnalysisException:  # none yet
            return set()

    def relay(self, send: Callable[[Iterable[Row]], None]) -> list[int]:
        """Sends what isn't sent yet, batch by batch in order, in tasks; send gets the messages of a partition."""
        try:
            waiting = {r[0] for r in self.messages().select("batch").distinct().collect()} - self.sent()
        except AnalysisException:  # nothing was put
            return []
        for batch in sorted(waiting):
            self.messages().where(F.col("batch") == batch).foreachPartition(send)
            self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.path}/sent")
        return sorted(waiting)
