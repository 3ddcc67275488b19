"""Many small files in folders: tasks list the folders and read the files, so that no list of them goes through the driver."""

from __future__ import annotations

import re
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from sparkloom.session import spread

#: Files, and bytes of them, that a task holds at once.
FILES, BYTES = 500, 8_000_000
#: Folders or files that are listed at once.
NAMES = 10_000
WILD = re.compile(r"[*?\[]")


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    """What root names, and the path on it: a local path, or a URI of a file system that Arrow knows."""
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", root)
    return pafs.FileSystem.from_uri(root) if re.match(r"\w[\w+.-]*:", root) else (pafs.LocalFileSystem(), root)


def qualified(spark: SparkSession, root: str) -> str:
    """The URI that Spark takes root for."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def known(root: str) -> bool:
    """Whether Arrow has root's file system here."""
    try:
        file_system(root)
    except (pa.ArrowException, OSError):
        return False
    return True


def _below(rows: DataFrame, root: str, pattern: str, files: bool) -> DataFrame:
    """The files or else folders in each folder rows(path), which is relative to root, whose names fit; hidden ones don't count."""

    def scan(batches):
        fs, base = file_system(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                own = f"{path}/" if path else ""
                if not files and not WILD.search(pattern):
                    names = [own + pattern] if fs.get_file_info(f"{base}/{own}{pattern}").type == pafs.FileType.Directory else []
                else:
                    kind = pafs.FileType.File if files else pafs.FileType.Directory
                    infos = fs.get_file_info(pafs.FileSelector(f"{base}/{path}".rstrip("/") or "/", allow_not_found=True))
                    names = [own + x.base_name for x in infos if x.type == kind and fnmatchcase(x.base_name, pattern) and x.base_name[0] not in "_."]
                for at in range(0, len(names), NAMES):
                    yield pa.RecordBatch.from_pydict({"path": names[at : at + NAMES]})

    return rows.mapInArrow(scan, "path string")


def found(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path: the files under root that fit, relative to it. The folders that a level's pattern finds are dealt out among
    the tasks."""
    rows = spark.createDataFrame([("",)], "path string").coalesce(1)
    *folders, last = glob.split("/")
    for part in folders:
        rows = _below(rows, root, part, False)
        if WILD.search(part):
            rows = spread(rows, "path")
    return _below(rows, root, last, True)


def contents(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path, content of the files under root that fit."""
    rows = found(spark, root, glob)

    def scan(batches):
        fs, base = file_system(root)
        for batch in batches:
            paths, data, held = [], [], 0
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{path}", compression=None) as file:
                    content = file.read()
                paths.append(f"{root}/{path}")
                data.append(content)
                held += len(content)
                if len(paths) == FILES or held > BYTES:
                    yield pa.RecordBatch.from_pydict({"path": paths, "content": pa.array(data, pa.binary())})
                    paths, data, held = [], [], 0
            if paths:
                yield pa.RecordBatch.from_pydict({"path": paths, "content": pa.array(data, pa.binary())})

    return spread(rows, "path").mapInArrow(scan, "path string, content binary")
