"""Session factory and table access shared by every query."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def build_session(app: str = "sparkloom", cpus: int = 8, memory: str = "16g", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under: UTC, AQE on, few shuffle partitions."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made for local sessions that name none, by application.
_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is named, a local session gets a temporary one; on a cluster
    that is an error, as executors don't share local folders."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
    return _own_folders[app]


def temporary_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose files go when the interpreter ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def remove() -> None:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: the shared folder's owner clears it
            return

    atexit.register(remove)
    return path


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt out by a key for work that costs far more than its rows' bytes say: without a number, rows that are small once
    compressed would be put together again into few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: for what a plan reads several times, or to cut its lineage."""
    path, schema = temporary_path(df.sparkSession, name), df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
