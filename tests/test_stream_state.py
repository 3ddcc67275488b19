import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import documents, events, outbox, polling, replay, series

START = datetime.datetime(2024, 5, 1)


def at(hours):
    return START + datetime.timedelta(hours=hours)


CHANGES = [  # document, change, stage, hours, batch
    ("a", "created", None, 0, 0), ("a", "claimed", None, 1, 0), ("a", "claimed", None, 1, 0), ("a", "stage", "chunking", 2, 1), ("a", "completed", None, 3, 1), ("a", "retry", None, 4, 2),
    ("b", "created", None, 0, 0), ("b", "completed", None, 1, 0), ("b", "claimed", None, 2, 1), ("b", "failed", None, 3, 1), ("b", "retry", None, 4, 2), ("b", "unknown", None, 5, 3),
    ("c", "created", None, 0, 0), ("c", "claimed", None, 40, 3), ("d", "claimed", None, 1, 0), ("e", "created", None, 0, 0), ("e", "created", None, 41, 3), ("f", "created", None, 39, 3),
]
TTL = 30 * 3600


def rows(spark):
    return spark.createDataFrame([(d, i, c, s, at(h), b) for i, (d, c, s, h, b) in enumerate(CHANGES)], "document_id string, change_id long, change string, stage string, at timestamp, slice int")


def test_document_states_after_a_restart(spark, tmp_path):
    """The stream is stopped after each batch and goes on from its checkpoint."""
    changes, path = rows(spark), str(tmp_path)
    for k in range(4):
        replay.write_slices(changes, f"{path}/in", "slice", range(k, k + 1))
        documents.run(replay.read_slices(changes, f"{path}/in"), path, TTL)
    audit = documents.audit_table(spark, path)
    got = {x.document_id: (x.status, x.stage, x.retries, x.changes) for x in documents.states(audit, at(41), TTL).collect()}
    # all that was there at first has expired; the last change of c then finds no document and that of e makes a new one
    assert got == {"e": ("PENDING", None, 0, 2), "f": ("PENDING", None, 0, 1)}
    at_four = {x.document_id: (x.status, x.stage, x.retries, x.changes) for x in documents.states(audit.where(F.col("at") <= at(5)), at(5), TTL).collect()}
    assert at_four["a"] == ("COMPLETED", "chunking", 0, 4) and at_four["b"] == ("PENDING", None, 1, 4) and at_four["c"] == ("PENDING", None, 0, 1) and "d" not in at_four
    log = [(x.n, x.change, x.accepted, x.status) for x in audit.where("document_id = 'c'").orderBy("n").collect()]
    assert log == [(1, "created", True, "PENDING"), (2, "expired", True, None), (3, "claimed", False, None)]
    assert [x.at for x in audit.where("document_id = 'c' and change = 'expired'").collect()] == [at(30)]
    assert audit.where("document_id = 'a' and not accepted").count() == 2 and audit.groupBy("document_id", "n").count().where("count > 1").isEmpty()


def test_idle_documents_expire_by_their_timer(spark, tmp_path):
    changes, path = rows(spark), str(tmp_path)
    documents.run(replay.sliced_stream(changes, "slice", 4, f"{path}/in"), path, 3600 * 10)
    expired = {x.document_id for x in documents.audit_table(spark, path).where("change = 'expired'").collect()}
    assert {"a", "b", "c", "e"} <= expired and "f" not in expired


def test_polls_claim_the_oldest_once_with_a_failure_between_claim_and_commit(spark, tmp_path):
    control = spark.createDataFrame([(f"d{i:02d}", "PENDING" if i % 3 else "COMPLETED", (i * 7) % 45) for i in range(45)], "document_id string, status string, updated_at int")
    polls, worked = polling.Polls(spark, str(tmp_path), lambda: control, "me", most=4), []

    def work(claimed, n):
        worked.append((n, sorted(x.document_id for x in claimed.collect())))
        if len(worked) == 2:
            raise RuntimeError("the second poll fails after its claim")

    with pytest.raises(Exception, match="second poll"):
        polls.run(work, 5, interval=0.05)
    assert polling.Polls(spark, str(tmp_path), lambda: control, "other", most=4).run(work, 5, interval=0.05) == 4
    want = [x.document_id for x in control.where("status = 'PENDING'").orderBy("updated_at", "document_id").collect()]
    assert worked[1] == worked[2] and [d for n, own in sorted({n: own for n, own in worked}.items()) for d in own] == [d for k in range(0, 20, 4) for d in sorted(want[k : k + 4])]
    claims = polls.claims().collect()
    assert len(claims) == 20 == len({x.document_id for x in claims}) and {x.owner for x in claims if x.poll == 1} == {"me"}


def test_polls_end_when_nothing_is_pending(spark, tmp_path):
    control = spark.createDataFrame([("a", "PENDING", 1), ("b", "FAILED", 0)], "document_id string, status string, updated_at int")
    polls = polling.Polls(spark, str(tmp_path), lambda: control, "me")
    assert polls.claims().isEmpty() and polls.run(lambda claimed, n: None, 9, interval=0.05) == 1


def test_messages_of_a_stream_that_is_killed_are_there_once(spark, tmp_path):
    changes, out = rows(spark), outbox.Outbox(spark, f"{tmp_path}/out")
    stream, failed = replay.sliced_stream(changes, "slice", 4), []

    def put(batch, n):
        made = batch.select(*outbox.message("change", F.concat_ws("-", "document_id", "change"), F.struct("change_id")))
        out.put(made, n)
        if n == 1 and not failed:
            failed.append(n)
            raise RuntimeError("killed before the commit")

    with pytest.raises(Exception, match="killed"):
        replay.drained(stream, f"{tmp_path}/state", put)
    sent = f"{tmp_path}/queue"
    first = out.relay(_sender(sent))
    replay.drained(stream, f"{tmp_path}/state", put)
    rest = out.relay(_sender(sent))
    assert first == [0, 1] and rest == [2, 3] and out.relay(_sender(sent)) == []
    want = {(d, c, b) for d, c, _, _, b in CHANGES}
    found = out.messages().collect()
    assert len(found) == len(want) == len({x.message_id for x in found}) and {(*x.key.split("-"), x.batch) for x in found} == want
    import os

    got = [line for name in os.listdir(sent) for line in open(f"{sent}/{name}").read().split()]
    assert sorted(got) == sorted(x.message_id for x in found)


def _sender(path):
    def send(messages):
        import os
        import uuid

        os.makedirs(path, exist_ok=True)
        lines = [m.message_id for m in messages]
        if lines:
            with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(lines) + "\n")

    return send


def test_closed_windows_and_late_rows_are_all_rows_of_closed_days(spark, tmp_path):
    data = [(i, START + datetime.timedelta(hours=i), "click" if i % 2 else "view", float(i), 3 if i % 7 == 0 else i // 40) for i in range(160)]
    df = spark.createDataFrame(data, "event_id long, at timestamp, event_type string, value double, slice int")
    stream = replay.sliced_stream(df, "slice", 4)
    late = {x.event_id for x in events.late_rows(stream, str(tmp_path)).collect()}
    windows = {(x.window_start, x.event_type): x.n for x in events.closed_windows(stream, str(tmp_path)).collect()}
    assert late and all(i % 7 == 0 for i in late)
    days = {w for w, _ in windows}
    assert sum(windows.values()) + sum(d[1].replace(hour=0) in days for d in data if d[0] in late) == sum(d[1].replace(hour=0) in days for d in data)
    assert max(d[1] for d in data).replace(hour=0) not in days


def test_series_of_a_repeated_batch_counts_once(spark, tmp_path):
    changes, failed = rows(spark), []
    stream = series.observed(replay.sliced_stream(changes, "slice", 4), "read", rows=F.count(F.lit(1)), created=F.count_if(F.col("change") == "created"))

    def put(batch, n):
        batch.write.format("noop").mode("overwrite").save()
        if n == 2 and not failed:
            failed.append(n)
            raise RuntimeError("killed")

    with series.Series(spark, f"{tmp_path}/series") as gathered:
        with pytest.raises(Exception, match="killed"):
            replay.drained(stream, f"{tmp_path}/state", put)
        replay.drained(stream, f"{tmp_path}/state", put)
    got = {(x.batch, x.metric): x.value for x in gathered.table().collect()}
    assert got == {(b, m): float(sum(c[4] == b and (m == "rows" or c[1] == "created") for c in CHANGES)) for b in range(4) for m in ("rows", "created")}
