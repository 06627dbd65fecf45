"""Tables that cut lineage: written once to the folder every executor shares, then read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A private one only where the session names none and everything runs on
    this machine (tests); a cluster without the setting is an error, as its executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="kinweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Parquet tables of one operator call. ``drop`` deletes those that no returned plan reads; the others go when
    the driver ends, as a returned DataFrame may read them until then."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/kinweave-{uuid.uuid4().hex}"
        self.count = 0

    def _path(self, path: str) -> tuple:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        if self.count == 1:
            root, files = self._path(self.root)
            files.deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kinweave_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [t._kinweave_path for t in tables] or [self.root]:
            p, files = self._path(path)
            files.delete(p, True)
