"""A polling loop as a stream: every micro-batch of a clock claims some pending documents, works on them, and commits.

Claims are an append-only table, a folder a poll. A poll that is repeated after a failure finds the claims it has made and
works on those, so no document is claimed twice and none is lost between claim and commit.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents of a poll, seconds between polls.
MOST_A_POLL, INTERVAL = 10, 30
CLAIM = "document_id string, owner string"


class Polls:
    """The claims on the pending documents of ``control()``(document_id, status, updated_at), kept under a path."""

    def __init__(self, spark: SparkSession, path: str, control: Callable[[], DataFrame], owner: str, most: int = MOST_A_POLL):
        self.spark, self.path, self.control, self.owner, self.most = spark, path, control, owner, most

    def claims(self) -> DataFrame:
        """document_id, owner, poll."""
        try:
            return self.spark.read.schema(f"{CLAIM}, poll long").option("basePath", f"{self.path}/claims").parquet(f"{self.path}/claims/poll=*")
        except AnalysisException:  # none yet
            return self.spark.createDataFrame([], f"{CLAIM}, poll long")

    def _of(self, poll: int) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims/poll={poll}/_SUCCESS")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema(CLAIM).parquet(f"{self.path}/claims/poll={poll}")

    def claim(self, poll: int) -> DataFrame:
        """The oldest unclaimed pending documents, ``most`` at most; of a poll that has claimed before, the same ones."""
        if (made := self._of(poll)) is not None:
            return made
        free = self.control().where("status = 'PENDING'").join(self.claims().select("document_id"), "document_id", "left_anti")
        oldest = free.orderBy("updated_at", "document_id").limit(self.most)
        oldest.select(F.col("document_id").cast("string").alias("document_id"), F.lit(self.owner).alias("owner")).write.mode("overwrite").parquet(f"{self.path}/claims/poll={poll}")
        return self._of(poll)

    def run(self, work: Callable[[DataFrame, int], None], polls: int, interval: float = INTERVAL) -> int:
        """Polls until ``polls`` are committed, or one finds nothing; returns how many ran here. work(claimed, poll) may be
        repeated for a poll. The loop ends between polls, never within one."""
        ran, over = [0], [False]

        def poll(_: DataFrame, number: int) -> None:
            if over[0]:
                return
            if number >= polls:
                over[0] = True
                return
            claimed = self.claim(number)
            if claimed.isEmpty():
                over[0] = True
                return
            work(claimed, number)
            ran[0] += 1
            over[0] = number + 1 >= polls

        clock = self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        query = clock.writeStream.option("checkpointLocation", f"{self.path}/checkpoint").trigger(processingTime=f"{interval} seconds").foreachBatch(poll).start()
        while query.isActive and not over[0]:
            time.sleep(min(0.1, interval / 4))
        if query.isActive:
            while query.status["isTriggerActive"]:  # the last poll's commit
                time.sleep(0.02)
            query.stop()
        if (error := query.exception()) is not None:
            raise error
        return ran[0]
