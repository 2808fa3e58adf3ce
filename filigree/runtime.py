"""What every job needs from its session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of a batch, which bound it where a row is a whole block of texts or vectors: Spark's default and the library's.
BYTES, SPARKS, OURS = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so their Python workers can import it.

    Texts can be long, and the buffers of two batches stay with each task, so a batch for Python is made smaller, in rows and in bytes, where its size is still the default.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "1000")
    if spark.conf.get(BYTES, SPARKS) == SPARKS:
        spark.conf.set(BYTES, OURS)
    if getattr(sc, "_filigree_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="filigree-code-"), "filigree_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("filigree") / p.relative_to(root))
    sc.addPyFile(target)
    sc._filigree_shipped = True


def session(app: str = "filigree", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect, on top of what the cluster sets."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
