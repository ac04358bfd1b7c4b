"""Intermediate tables that outlive lost executors.

Iterative operators cut their lineage by writing a Parquet table under the
folder that the cluster names in ``spark.checkpoint.dir`` (shared storage).
Only a local session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session.

    Read from ``spark.checkpoint.dir`` (or a directory set on the context).
    Where none is set, a local master gets a temporary folder; on a cluster a
    machine-local folder would be wrong, so that raises ``ValueError``.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = sc.applicationId
    if key not in _local_dirs:
        _local_dirs[key] = "file://" + tempfile.mkdtemp(prefix="mediasift-")
    return _local_dirs[key]


class Scratch:
    """Tables written by one run of an operator; ``drop`` deletes one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        path, fs = self._fs(self.root)
        fs.deleteOnExit(path)

    def _fs(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame) -> DataFrame:
        """Runs the plan of ``df`` once and returns a DataFrame over the written table."""
        where = f"{self.root}/{self._n}"
        self._n += 1
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        self._paths[id(out)] = where
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            where = self._paths.pop(id(df), None)
            if where:
                path, fs = self._fs(where)
                fs.delete(path, True)
