"""Step metrics of streams: what a step observes of each batch, appended to a table (run, step, batch, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

SERIES = "run string, step string, batch long, metric string, value double"


def observed(stream: DataFrame, step: str, /, **metrics: Column) -> DataFrame:
    """The stream with named counters that each batch reports."""
    return stream.observe(step, *[c.alias(name) for name, c in metrics.items()])


class Series(StreamingQueryListener):
    """Gathers what queries report and appends it to a table when they end, a file a query."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.held = spark, path, {}

    def onQueryStarted(self, event) -> None:
        self.held[str(event.runId)] = {}

    def onQueryProgress(self, event) -> None:
        own = self.held.setdefault(str(event.progress.runId), {})
        for step, row in event.progress.observedMetrics.items():
            for metric, value in row.asDict().items():
                # a batch reports again when it is repeated: the last report counts; an idle batch observes nothing
                own[event.progress.batchId, step, metric] = value

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run, own = str(event.runId), self.held.pop(str(event.runId), {})
        rows = [(run, step, batch, metric, float(value)) for (batch, step, metric), value in own.items() if value is not None]
        if rows:
            self.spark.createDataFrame(rows, SERIES).coalesce(1).write.mode("append").parquet(self.path)

    def __enter__(self) -> Series:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)  # reports come by the listeners' own queue
        self.spark.streams.removeListener(self)

    def table(self) -> DataFrame:
        return self.spark.read.schema(SERIES).parquet(self.path)
