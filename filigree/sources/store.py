"""The index on disk: chunk rows with vectors and their postings by ticker, corpus statistics and term weights."""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from filigree.functions.parsing import tokenize
from filigree.operators import index

#: Versions that a reader may have to bring together; beyond it an update writes all anew.
VERSIONS = 16
#: Bytes of chunks whose postings one task makes.
PIECE, SPLIT = "spark.sql.files.maxPartitionBytes", "16m"
#: Tables that lie by ticker, each ticker's part in the version that wrote it last.
BY_TICKER = ("chunks", "postings", "counts", "sizes")


class IndexStore:
    """Parquet tables under one folder, in versions that are written beside the ones before.

    `current` says, line by line, which version holds each ticker's chunks and postings, so an update
    writes the tickers that changed and nothing else, and readers and a failed writer never
    meet half a table. Versions that neither the current line nor the one before it names
    are deleted."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _history(self, most: int = 2) -> list[dict]:
        """The last states, newest first: {version, live: {ticker: version}}."""
        fs, p = self._fs(f"{self.folder}/current")
        if not fs.exists(p):
            return []
        rows = self.spark.read.schema("version string, at timestamp, live string").json(f"{self.folder}/current").orderBy(F.desc("at")).limit(most).collect()
        return [{"version": r.version, "live": json.loads(r.live)} for r in rows]

    def version(self) -> str | None:
        return next((h["version"] for h in self._history(1)), None)

    def read(self, table: str) -> DataFrame:
        """chunks, postings, df, idf or stats of the current version."""
        (now,) = self._history(1)
        return self._read(table, now)

    def _read(self, table: str, now: dict) -> DataFrame:
        if table not in BY_TICKER:
            return self.spark.read.parquet(f"{self.folder}/{now['version']}/{table}")
        by: dict[str, list[str]] = defaultdict(list)
        for ticker, version in now["live"].items():
            by[version].append(ticker)
        parts = [self._table(f"{self.folder}/{v}/{table}").where(F.col("ticker").isin(tickers)) for v, tickers in sorted(by.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self._table(f"{self.folder}/{now['version']}/{table}").where("false")

    def _table(self, path: str) -> DataFrame:
        """A table by ticker, which is a string whatever it looks like."""
        found = self.spark.read.parquet(path).schema
        kinds = StructType([StructField(f.name, StringType() if f.name == "ticker" else f.dataType) for f in found])
        return self.spark.read.schema(kinds).parquet(path)

    def get(self, ids: list[str]) -> DataFrame:
        """Chunks by id."""
        return self.read("chunks").where(F.col("id").isin(ids))

    def write(self, chunks: DataFrame, kept: dict[str, str] | None = None) -> None:
        """A version of chunks (vectors included) beside the tickers that earlier versions keep, and all that sparse search needs of them.

        Document frequencies are kept per ticker (counts: term, df; sizes: chunks with terms and their length), so those of the
        corpus are the last ones, less what the tickers written now had, plus what they have: no postings but their own are read.
        Postings are counted and sorted by term in the task that reads their chunks, so none is shuffled, and a reader of few terms skips row groups."""
        v = uuid.uuid4().hex[:12]
        base = f"{self.folder}/{v}"
        before = self._history(1)
        chunks.write.partitionBy("ticker").option("compression", "zstd").parquet(f"{base}/chunks")
        with self._splits():
            c = self.spark.read.schema(chunks.schema).parquet(f"{base}/chunks")
            post = index.counts(c.select("id", tokenize(index.search_text()).alias("terms"), "ticker"))
            post.sortWithinPartitions("ticker", "term").write.partitionBy("ticker").parquet(f"{base}/postings")
        live = (kept or {}) | {r.ticker: v for r in c.select("ticker").distinct().collect()}
        now = {"version": v, "live": live}
        own = self._table(f"{base}/postings")
        own.groupBy("ticker", "term").agg(F.count("*").alias("df")).write.partitionBy("ticker").parquet(f"{base}/counts")
        # a chunk's tf add up to its dl, so sums over postings are those over chunks; the sum of shares lies far nearer to a whole number than a half
        own.groupBy("ticker").agg(F.round(F.sum(F.col("tf") / F.col("dl"))).cast("bigint").alias("n_docs"), F.sum("tf").alias("total")).write.partitionBy("ticker").parquet(f"{base}/sizes")
        signed = self._table(f"{base}/counts").select("term", "df")
        if kept and before:
            left = {"version": before[0]["version"], "live": {t: x for t, x in before[0]["live"].items() if t not in kept}}
            signed = signed.unionByName(self._read("df", before[0])).unionByName(self._read("counts", left).select("term", (-F.col("df")).alias("df")))
        signed.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").write.parquet(f"{base}/df")
        sizes = self._read("sizes", now).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), (F.sum("total").cast("double") / F.sum("n_docs")).alias("avgdl"))
        sizes.write.parquet(f"{base}/stats")
        index.idf(self.spark.read.parquet(f"{base}/df"), self.spark.read.parquet(f"{base}/stats")).write.parquet(f"{base}/idf")
        line = self.spark.range(1).select(F.lit(v).alias("version"), F.current_timestamp().alias("at"), F.lit(json.dumps(live)).alias("live"))
        line.coalesce(1).write.mode("append").json(f"{self.folder}/current")
        self._clear([now, *before])

    @contextmanager
    def _splits(self):
        """Tables are read in pieces of SPLIT, whose postings a task can sort in memory."""
        had = self.spark.conf.get(PIECE)
        self.spark.conf.set(PIECE, SPLIT)
        try:
            yield
        finally:
            self.spark.conf.set(PIECE, had)

    def _clear(self, named: list[dict]) -> None:
        used = {"current"} | {v for h in named for v in (h["version"], *h["live"].values())}
        fs, p = self._fs(self.folder)
        for s in fs.listStatus(p):
            if s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)

    def update(self, new: DataFrame, embed=None, files: DataFrame | None = None) -> tuple[int, int]:
        """Bring the index to `new`, the chunks of all selected files; returns how many were embedded and deleted.

        What is unchanged keeps its vector, what is gone is purged. Tickers without a change are not written again, and without any nothing is.
        With files (file), as a batch of a stream has them, new holds the chunks of these files alone, and those of all other files stay."""
        (*now,) = self._history(1)
        if not now:
            self.write(index.merged(new.limit(0).withColumn("embedding", F.lit(None).cast("array<float>")), new, embed))
            return self.read("chunks").count(), 0
        old = whole = self._read("chunks", now[0])
        if files is not None:
            # ids of other files that the batch takes over count as its own
            mine = old.join(files.select("file").distinct(), "file", "left_semi").select("id").union(new.select("id")).distinct()
            old, rest = whole.join(mine, "id", "left_semi"), whole.join(mine, "id", "left_anti")
        up, gone = index.changed_ids(old, new).join(new.select("id", "ticker"), "id"), index.stale_ids(old, new).join(old.select("id", "ticker"), "id")
        each = up.select("ticker", F.lit(1).alias("up"), F.lit(0).alias("gone")).union(gone.select("ticker", F.lit(0), F.lit(1)))
        by = {r.ticker: (r.up, r.gone) for r in each.groupBy("ticker").agg(F.sum("up").alias("up"), F.sum("gone").alias("gone")).collect()}
        if by:
            kept = {t: v for t, v in now[0]["live"].items() if t not in by}
            if len(set(kept.values())) >= VERSIONS:
                kept = {}
            some = F.lit(True) if not kept else ~F.col("ticker").isin(list(kept))
            rows = index.merged(old.where(some), new.where(some), embed)
            self.write(rows if files is None else rows.unionByName(rest.where(some)), kept)
        return sum(u for u, _ in by.values()), sum(g for _, g in by.values())
