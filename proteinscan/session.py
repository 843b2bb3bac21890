"""What a session needs: the package in Python workers, and a folder that all of them share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local_dirs: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    """Whether driver and tasks run in one process on one machine."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once per application; in local mode not if PYTHONPATH has it."""
    root = Path(__file__).resolve().parent
    sc = spark.sparkContext
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if sc.applicationId in _shipped or (is_local(spark) and str(root.parent) in known):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*")):
            if path.is_file() and "__pycache__" not in path.parts:
                out.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; in local mode without that setting, a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not is_local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _local_dirs[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/proteinscan/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
