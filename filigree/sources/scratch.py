"""Shared scratch storage for jobs that must outlive an executor.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``;
only where that setting is missing on one machine (tests) is a local folder chosen.
"""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of narrow tables that one file takes.
ROWS_PER_FILE = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from the session. Where it is unset, a fresh local one for a local master, and an error for a cluster: its executors would not find the tables."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = Path(tempfile.mkdtemp(prefix="filigree-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables under one folder of the shared storage; a written table cuts lineage.

    Results read them lazily, so they stay until `drop`, the end of a `with` block or the end of the application."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/filigree/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        fs, at = self._fs(self.base)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.remove(self.base)

    def _fs(self, p: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write df and read it back; the returned frame depends on the files alone. `rows`, a bound of its rows where it is known, spares a small table from many small files."""
        p = self.path(name)
        if rows is not None and (files := -(-rows // ROWS_PER_FILE)) < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(max(1, files))
        df.write.mode("overwrite").parquet(p)
        back = self.spark.read.schema(df.schema).parquet(p)
        back._filigree_path = p
        return back

    def drop(self, df: DataFrame | None) -> None:
        """Delete the files of a kept frame that no plan will read again."""
        p = getattr(df, "_filigree_path", None)
        if p:
            self.remove(p)

    def remove(self, p: str) -> None:
        fs, at = self._fs(p)
        fs.delete(at, True)
