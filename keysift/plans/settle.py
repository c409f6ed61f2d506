"""Cut the lineage of a result several jobs read, so that a lost executor does not repeat the scan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"


@lru_cache
def _own_folder() -> str:
    """A temporary folder that goes when the process ends."""
    folder = tempfile.mkdtemp(prefix="keysift-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; only a session of one process may have none, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get(_DIR, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {_DIR} to a folder that all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


def settle(df: DataFrame, label: str, written: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; readers prune its columns.

    ``written`` gets the table's path, for ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keysift-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, written: list[str]) -> None:
    """Delete settled tables that nothing reads any more; findings hold unredacted lines."""
    while written:
        path = spark._jvm.org.apache.hadoop.fs.Path(written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
