"""Batched writes to a keyed store: a Spark data source whose tasks send puts and deletes in batches of 25.

A client takes a batch and gives back what it didn't process, which is sent again, a few times longer apart each time. The
client that is built in keeps a folder: a task's batches go to a file of its own, and the driver's commit names the files
that count, so a task that fails or runs twice leaves nothing behind. Reading folds the committed requests by key.
"""

from __future__ import annotations

import importlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Requests of a batch, and how often what wasn't processed is sent again.
BATCH, ATTEMPTS = 25, 8


class FolderClient:
    """Puts batches into one file of a folder."""

    def __init__(self, options: dict[str, str], name: str):
        self.fs, root = pafs.FileSystem.from_uri(options["path"]) if ":" in options["path"] else (pafs.LocalFileSystem(), options["path"])
        self.fs.create_dir(f"{root}/requests", recursive=True)
        self.out = self.fs.open_output_stream(f"{root}/requests/{name}.jsonl")

    def send(self, batch: list[dict]) -> list[dict]:
        """Returns the requests that weren't processed."""
        self.out.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in batch).encode())
        return []

    def close(self) -> None:
        self.out.close()


def client_of(options: dict[str, str], name: str):
    """The client that ``client`` names as module:class, or the built-in one."""
    if not (named := options.get("client")):
        return FolderClient(options, name)
    module, _, kind = named.partition(":")
    return getattr(importlib.import_module(module), kind)(options, name)


@dataclass
class Sent(WriterCommitMessage):
    name: str
    requests: int
    batches: int


class BatchWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], key: str):
        self.options, self.key, self.wait = options, key, float(options.get("wait", "0.05"))
        self.number = str(int(options["number"]))

    def write(self, rows: Iterator[Row]) -> Sent:
        name, held, counts = f"{self.number}-{uuid.uuid4().hex}", {}, [0, 0]
        client = client_of(self.options, name)

        def flush() -> None:
            batch = list(held.values())
            held.clear()
            counts[0] += len(batch)
            for attempt in range(ATTEMPTS):
                counts[1] += 1
                if not (batch := client.send(batch)):
                    return
                time.sleep(self.wait * 2**attempt)
            raise RuntimeError(f"{len(batch)} requests were not processed in {ATTEMPTS} attempts")

        for row in rows:
            item = row.asDict(recursive=True)
            deleted = item.pop("__delete", False)
            key = str(item[self.key])
            if len(held) == BATCH or key in held:  # a batch names a key once
                flush()
            held[key] = {"key": key, "delete": bool(deleted), "item": None if deleted else json.dumps(item, default=str, ensure_ascii=False)}
        if held:
            flush()
        client.close()
        return Sent(name, *counts)

    def _fs(self):
        path = self.options["path"]
        return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)

    def commit(self, messages: list[Sent | None]) -> None:
        fs, root = self._fs()
        fs.create_dir(f"{root}/commits", recursive=True)
        with fs.open_output_stream(f"{root}/commits/{self.number}-{uuid.uuid4().hex[:8]}.jsonl") as out:
            for m in messages:
                if m is not None:
                    out.write((json.dumps({"name": m.name, "requests": m.requests, "batches": m.batches}) + "\n").encode())

    def abort(self, messages: list[Sent | None]) -> None:
        fs, root = self._fs()
        for m in messages:
            if m is not None and fs.get_file_info(f"{root}/requests/{m.name}.jsonl").is_file:
                fs.delete_file(f"{root}/requests/{m.name}.jsonl")


class BatchStore(DataSource):
    """Options: path, key (the key's column), number (of this write; later ones win), client, wait. A true column __delete makes a
    row a delete of its key."""

    @classmethod
    def name(cls) -> str:
        return "batch_store"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(dict(self.options), self.options["key"])


def write(rows: DataFrame, path: str, key: str, number: int, **options: str) -> None:
    """Sends rows as puts, or as deletes where __delete is true; rows of one key go to one task."""
    rows.sparkSession.dataSource.register(BatchStore)
    rows.repartition(key).write.format("batch_store").mode("append").options(path=path, key=key, number=str(number), **options).save()


def commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, requests long, batches long").json(f"{path}/commits")


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, item (JSON): what the committed requests leave, the last write of a key by the number of its write."""
    lines = spark.read.schema("key string, delete boolean, item string").json(f"{path}/requests").withColumn("name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl", 1))
    counted = lines.join(commits(spark, path).select("name"), "name", "left_semi").withColumn("number", F.substring_index("name", "-", 1).cast("long"))
    last = Window.partitionBy("key").orderBy(F.desc("number"))
    return counted.withColumn("n", F.row_number().over(last)).where("n = 1 and not delete").select("key", "item")
