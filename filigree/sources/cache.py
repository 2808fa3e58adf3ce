"""Model replies remembered by a hash of what was asked: as a table that a cluster shares, or as files for one machine."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filigree.sources.scratch import Scratch


def key(judge: bool, provider: str, model: str, system: str | None, prompt: str, json_mode: bool) -> str:
    """The name of a request; temperature is not part of it."""
    return hashlib.sha256(json.dumps([judge, provider, model, system, prompt, json_mode]).encode()).hexdigest()


def key_column(provider: str, model: str, prompt: Column) -> Column:
    return F.sha2(F.to_json(F.struct(F.lit(provider).alias("provider"), F.lit(model).alias("model"), prompt.alias("prompt"))), 256)


def misses(asked: DataFrame, have: DataFrame) -> DataFrame:
    """Distinct requests that the cache lacks."""
    return asked.dropDuplicates(["key"]).join(have.select("key"), "key", "left_anti")


class TableCache:
    """Replies as a table on shared storage, by the first two characters of their keys.

    A DataFrame of requests is answered by an anti-join with what is there, one call for each
    distinct request that is missing, wherever it runs, and an append; the parts of the table that no request falls in
    are not read. Two writers that answer one request leave two rows, of which any is the reply; `compact` leaves one."""

    SCHEMA = "key string, text string, made timestamp, part string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _current(self) -> str | None:
        """The folder of the newest compaction that is whole, or the first."""
        fs, p = self._fs(self.folder)
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        whole = [n for n in names if n.startswith("v") and fs.exists(self._fs(f"{self.folder}/{n}/_whole")[1])]
        return f"{self.folder}/{whole[-1]}" if whole else None

    def replies(self) -> DataFrame:
        """(key, text, made, part), one row per key but for races of writers."""
        at = self._current()
        return self.spark.read.schema(self.SCHEMA).parquet(at) if at else self.spark.createDataFrame([], self.SCHEMA)

    def _begin(self) -> str:
        at = self._current()
        if at is None:
            at = f"{self.folder}/v{0:08d}"
            fs, p = self._fs(f"{at}/_whole")
            fs.mkdirs(self._fs(at)[1])
            fs.create(p, True).close()
        return at

    def answered(self, asked: DataFrame, prompt: str, key: Column, complete) -> DataFrame:
        """asked with `r` (text, error, seconds), the reply to each row's prompt; null for a null prompt.

        complete is a column function like models.completed. Only replies without an error are kept; a kept one took 0 seconds."""
        rows = asked.withColumn("key", F.when(F.col(prompt).isNotNull(), key))
        part = F.substring("key", 1, 2)
        want = rows.where("key is not null").groupBy("key").agg(F.first(prompt).alias("_p")).withColumn("part", part)
        new = want.join(self.replies().select("part", "key"), ["part", "key"], "left_anti").withColumn("r", complete(F.col("_p")))
        with_scratch = Scratch(self.spark, "replies")
        new = with_scratch.keep(new.select("key", "r", "part"), "new")  # one call for each, however often it is read
        good = new.where("coalesce(r.error, '') = '' and coalesce(r.text, '') <> ''")
        if not good.isEmpty():
            good.select("key", F.col("r.text").alias("text"), F.current_timestamp().alias("made"), "part").write.mode("append").partitionBy("part").parquet(self._begin())
        had = self.replies().groupBy("part", "key").agg(F.min("text").alias("_had"))
        failed = new.where("not (coalesce(r.error, '') = '' and coalesce(r.text, '') <> '')").select("key", F.col("r").alias("_failed"))
        took = new.select("key", F.col("r.seconds").alias("_took"))
        out = rows.withColumn("part", part).join(had, ["part", "key"], "left").join(failed, "key", "left").join(took, "key", "left")
        reply = F.struct(F.col("_had").alias("text"), F.lit("").alias("error"), F.coalesce("_took", F.lit(0.0)).alias("seconds"))
        return out.withColumn("r", F.coalesce(F.when(F.col("_had").isNotNull(), reply), F.col("_failed"))).drop("_had", "_failed", "_took", "part", "key")

    def compact(self) -> None:
        """Write one file per part and one row per key beside the table, then let it take its place."""
        at = self._current()
        if at is None:
            return
        after = f"{self.folder}/v{int(at.rpartition('/v')[2]) + 1:08d}"
        self.replies().groupBy("part", "key").agg(F.min(F.struct("made", "text")).alias("x")).select("key", "x.text", "x.made", "part").repartition("part").write.mode("overwrite").partitionBy("part").parquet(after)
        fs, p = self._fs(f"{after}/_whole")
        fs.create(p, True).close()
        fs.delete(self._fs(at)[1], True)


class FileCache:
    """One file per reply, for interactive use; empty replies are not kept."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def get(self, k: str) -> str | None:
        p = self.folder / f"{k}.json"
        return json.loads(p.read_text())["text"] if p.exists() else None

    def put(self, k: str, text: str) -> None:
        if text:
            self.folder.mkdir(parents=True, exist_ok=True)
            part = self.folder / f"{k}.{os.getpid()}.part"
            part.write_text(json.dumps({"text": text}))
            part.rename(self.folder / f"{k}.json")
