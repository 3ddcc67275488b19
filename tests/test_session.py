import subprocess
import sys
from pathlib import Path

import pytest

from sparkloom import session

ROOT = str(Path(__file__).resolve().parent.parent)
SCRIPT = """
from pyspark.sql import SparkSession
from sparkloom.session import shared_dir
from sparkloom.streaming.events import run_to_table
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
assert shared_dir(spark).startswith("file:///") and shared_dir(spark) == shared_dir(spark)
print("fine")
"""


class _Fake:
    def __init__(self, named, master):
        self.conf = {"spark.checkpoint.dir": named}
        self.sparkContext = type("C", (), {"master": master, "applicationId": "app-1"})()


def test_shared_folder():
    assert session.shared_dir(_Fake("viewfs://x/y", "spark://m")) == "viewfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_Fake(None, "spark://m"))


def test_local_session_without_a_named_folder(tmp_path):
    """With an empty configuration folder, so no defaults of this machine apply."""
    env = {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    import os

    done = subprocess.run([sys.executable, "-c", SCRIPT], env=os.environ | env, capture_output=True, text=True, timeout=300, check=False)
    assert "fine" in done.stdout, done.stderr[-2000:]
