"""Filings, coverage, companies and evaluation sets as files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from filigree.operators.coverage import COLUMNS

COVERAGE = "ticker string, sector string, industry string, form string, fiscal_year int, fiscal_quarter string, fiscal_label string, period_end date, period_end_src string, filing_date date, header_quarter string, xbrl_period string, xbrl_mismatch boolean, status string, file string"
COMPANY = "map<string, struct<name:string, cik:string, sector:string, industry:string, aliases:array<string>, fiscal_year_end:string>>"
ITEM = "id string, type string, question string, expected_tickers array<string>, expected_sections array<string>, expected_years array<int>, expected_last_n int, expected_comparison boolean, template string, gold_chunk string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq): the names in {"files": [...]}, in their order."""
    return spark.read.schema("files array<string>").json(path, multiLine=True).select(F.posexplode("files").alias("seq", "file"))


def whole_texts(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """(file, seq, text) of the listed files, relative to folder; bytes that are no UTF-8 become replacement characters. Files that are absent are left out.

    Only listed files are opened: the names are those of one manifest, which the driver reads, so their paths are handed to the reader."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(Path(folder))
    wanted = {r.file for r in names.select("file").distinct().collect() if r.file}
    there = []
    for parent in sorted({n.rpartition("/")[0] for n in wanted}):
        at = Path(base, parent) if parent else base
        if fs.exists(at):
            there += [s.getPath().toString() for s in fs.listStatus(at) if f"{parent}/{s.getPath().getName()}".lstrip("/") in wanted and not s.isDirectory()]
    if not there:
        return names.withColumn("text", F.lit(None).cast("string")).where("false")
    raw = spark.read.format("binaryFile").load([re.sub(r"([*?{}\[\]\\])", r"\\\1", p) for p in there])
    file = F.substring("path", len(base.toString().rstrip("/")) + 2, 1 << 20)
    return names.join(raw.select(file.alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")), "file")


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COVERAGE).csv(path, header=True)


def write_coverage(cov: DataFrame, path: str) -> None:
    """The fixed columns, as CSV with a header; other columns are left out."""
    cov.select(*COLUMNS).write.mode("overwrite").csv(path, header=True)


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """The company dimension from a JSON object keyed by ticker."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", COMPANY)).alias("ticker", "c")).select("ticker", "c.*")


def write_companies(companies: DataFrame, path: str) -> None:
    """The same JSON shape: one object, keys sorted. The dimension has one row per company."""
    one = F.struct("name", "cik", "sector", "industry", "aliases", "fiscal_year_end")
    entries = F.array_sort(F.collect_list(F.struct(F.col("ticker").alias("key"), one.alias("value"))))
    companies.agg(F.to_json(F.map_from_entries(entries), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON array, or of a folder that write_items made."""
    return spark.read.schema(ITEM).json(path, multiLine=path.endswith(".json"))


def write_items(items: DataFrame, path: str) -> None:
    """Evaluation items as read_items reads them, one JSON object a line, in the order of their ids."""
    items.orderBy("id").coalesce(1).write.mode("overwrite").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """The summary of an evaluation as one CSV file with a header."""
    summary.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_results(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Evaluation results as CSV, in mode append beside what an earlier run left."""
    flat = [F.col(c) if not t.startswith("array") else F.array_join(c, " ").alias(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode(mode).csv(path, header=True, escape='"')


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    """Results that write_results wrote, arrays as the joined strings they are."""
    flat = ", ".join(f"{f.name} {'string' if f.dataType.typeName() == 'array' else f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(flat).csv(path, header=True, escape='"', multiLine=True)


def done_results(spark: SparkSession, path: str) -> DataFrame:
    """(id) of the items whose results lie at path without an error, each once; none where nothing was written yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or not any(s.getPath().getName().startswith("part-") for s in fs.listStatus(at)):
        return spark.createDataFrame([], "id string")
    return spark.read.csv(path, header=True, escape='"', multiLine=True).where("error is null or error = ''").select("id").distinct()


def settled(rows: DataFrame) -> DataFrame:
    """Results with one row for each item: of one that was tried again, the row without an error."""
    w = Window.partitionBy("id").orderBy(F.coalesce("error", F.lit("")) != "", F.desc("latency_s"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def select_filings(cov: DataFrame, files: list[str] | None = None) -> DataFrame:
    """Filings to ingest: status ok, of a list of files if given."""
    ok = cov.where("status = 'ok'")
    return ok.where(F.col("file").isin(files)) if files else ok
