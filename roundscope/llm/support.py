"""Shared folders and loading for the operators of this subpackage."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import importable

_FOLDERS: list[str] = []
_STORED: dict[int, tuple[DataFrame, str]] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Only a local session, where driver and executors are one process, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="roundscope-"))
        return sc.getCheckpointDir().rstrip("/")
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm-{uuid.uuid4().hex}/{label}"
    _FOLDERS.append(path.rpartition("/")[0])
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[id(out)] = (out, path.rpartition("/")[0])
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        _, folder = _STORED.pop(id(df))
        _FOLDERS.remove(folder)
        _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process; results that still read them can't be used afterwards."""
    _STORED.clear()
    while _FOLDERS:
        _delete(spark, _FOLDERS.pop())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tasks(spark: SparkSession) -> int:
    """How many tasks a shuffle of the texts is dealt to: the session's own setting, which follows the data's size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
