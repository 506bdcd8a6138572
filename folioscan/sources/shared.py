"""Tables in the shared folder, which cut the lineage of iterations."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this machine that go with this process.
_own: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine, but
    only if the driver is the one executor; on a cluster that raises RuntimeError."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{tempfile.gettempdir()}/folioscan-{spark.sparkContext.applicationId}"
    if path not in _own:
        _own.add(path)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df as a table that is written and read again, and its path: a lost executor costs no rework."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
