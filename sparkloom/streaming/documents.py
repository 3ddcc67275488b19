"""The life of a document as a keyed state machine over a stream of changes, with an audit row for each change.

A document is created PENDING, claimed once (IN_PROGRESS), goes through stages, and ends COMPLETED or FAILED; a failed one may
be queued again ``MOST_RETRIES`` times. A change that the state doesn't allow is refused and changes nothing. A document
whose state hasn't changed for ``ttl`` seconds of event time expires: by a timer when the watermark has passed that time,
or by its next change if that comes first. Either way the audit says so once, at the time of expiry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkloom.streaming.replay import ON_DISK, STORE, drained

MOST_RETRIES = 3
#: change: (states that allow it, state after it)
ALLOWED = {
    "created": ((None,), "PENDING"),
    "claimed": (("PENDING",), "IN_PROGRESS"),
    "stage": (("IN_PROGRESS",), "IN_PROGRESS"),
    "completed": (("IN_PROGRESS",), "COMPLETED"),
    "failed": (("IN_PROGRESS",), "FAILED"),
    "retry": (("FAILED",), "PENDING"),
}
AUDIT = "document_id string, n long, change string, accepted boolean, status string, stage string, retries int, at timestamp"
STATE = "status string, stage string, retries int, changed_us long, n long"


class Life(StatefulProcessor):
    """One document's state, and what its changes and its timer make of it."""

    def __init__(self, ttl: int):
        self.ttl_us = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", STATE)

    def _read(self) -> list:
        return list(self.state.get() or (None, None, 0, 0, 0))

    def _audit(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        n, change, accepted, status, stage, retries, us = zip(*rows, strict=True)
        return pd.DataFrame({"document_id": [key[0]] * len(n), "n": n, "change": change, "accepted": accepted, "status": status, "stage": stage, "retries": retries, "at": np.array(us, "datetime64[us]")})

    def _due(self, now: list) -> int | None:
        """The time of the document's timer; there is one while it has a state."""
        return None if now[0] is None else -(-(now[3] + self.ttl_us) // 1000)

    def _schedule(self, was: int | None, now: list) -> None:
        due = self._due(now)
        self.state.update((None, None, 0, 0, now[4]) if due is None else tuple(now))
        if was != due:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changes = [x for frame in rows for x in zip(*[frame[c].tolist() for c in ("us", "change_id", "change", "stage")], strict=True)]
        changes.sort(key=lambda x: (x[0], x[1] != x[1], x[1]))  # one without an id comes last
        now, out = self._read(), []
        was = self._due(now)
        for us, _, change, stage in changes:
            if now[0] is not None and us - now[3] > self.ttl_us:
                out.append((now[4] + 1, "expired", True, None, None, 0, now[3] + self.ttl_us))
                now = [None, None, 0, 0, now[4] + 1]
            before, after = ALLOWED.get(change, ((), None))
            accepted = now[0] in before and not (change == "retry" and now[2] >= MOST_RETRIES)
            if accepted:
                now = [after, stage if change == "stage" else now[1], now[2] + (change == "retry"), us, now[4]]
            now[4] += 1
            out.append((now[4], change, bool(accepted), now[0], now[1], now[2], us))
        self._schedule(was, now)
        yield self._audit(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self._read()
        if now[0] is None:
            return
        n = now[4] + 1
        self.state.update((None, None, 0, 0, n))
        yield self._audit(key, [(n, "expired", True, None, None, 0, now[3] + self.ttl_us)])

    def close(self) -> None:
        pass


def audits(changes: DataFrame, ttl: int, late: str = "0 seconds") -> DataFrame:
    """changes(document_id, change_id, change, stage, at), a stream: the audit rows, as they come."""
    rows = changes.select(F.col("document_id").cast("string").alias("document_id"), F.col("change_id").cast("long").alias("change_id"), "change", F.col("stage").cast("string").alias("stage"), F.unix_micros("at").alias("us"), "at")
    return rows.withWatermark("at", late).groupBy("document_id").transformWithStateInPandas(Life(ttl), AUDIT, "Append", "EventTime")


def run(changes: DataFrame, path: str, ttl: int) -> None:
    """Follows a stream of changes to its present end. Audit rows are written by batch, so a repeated batch overwrites
    itself; the state is in the checkpoint, and the next run goes on from there."""
    changes.sparkSession.conf.set(STORE, ON_DISK)
    drained(audits(changes, ttl), f"{path}/checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/audit/batch={n}"))


def audit_table(spark, path: str) -> DataFrame:
    return spark.read.schema(f"{AUDIT}, batch long").parquet(f"{path}/audit")


def states(audit: DataFrame, now, ttl: int) -> DataFrame:
    """document_id, status, stage, retries, changes: each document that has a state at the time ``now``."""
    last = Window.partitionBy("document_id").orderBy(F.desc("n"))
    kept = Window.partitionBy("document_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    changed = F.max(F.when(F.col("accepted"), F.unix_micros("at"))).over(kept)
    rows = audit.withColumns({"changed": changed, "changes": F.count_if(F.col("accepted") & (F.col("change") != "expired")).over(Window.partitionBy("document_id")), "r": F.row_number().over(last)})
    alive = F.col("status").isNotNull() & (F.unix_micros(F.lit(now)) - F.col("changed") <= ttl * 1_000_000)
    return rows.where((F.col("r") == 1) & alive).select("document_id", "status", "stage", "retries", "changes")
