"""A stand-in for indexed filings, made from the `documents` and `embeddings` tables.

No filings are at hand for the registered queries, so each document plays one chunk: its
attributes come from mixed bits of its id. This exercises the operators; it says nothing of
retrieval quality on filings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from filigree.runtime import ship
from filigree.settings import SECTIONS


#: The view for DuckDB, to stand in a WITH clause.
CHUNKS_SQL = f"""
select *, concat_ws('-', ticker, form, fiscal_year, fiscal_quarter, section, chunk) as id from (
  select *, cast(row_number() over (partition by ticker, form, fiscal_year, fiscal_quarter, section order by doc_id) - 1 as int) as chunk from (
    select *, case when fiscal_quarter = 'FY' then '10-K' else '10-Q' end as form from (
      select doc_id, text, 'SR' || chr(65 + cast(substr(source, 4) as int)) as ticker,
             ([{', '.join(f"'{s}'" for s in SECTIONS)}])[(h // 1024) % 8 + 1] as section,
             cast(2022 + (h // 65536) % 4 as int) as fiscal_year,
             (['FY', 'Q1', 'Q2', 'Q3'])[(h // 1048576) % 4 + 1] as fiscal_quarter,
             substr(md5(text), 1, 12) as hash
      from (select *, (doc_id * 1103515245 + 12345) % 2147483648 as h from documents))))"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    ship(spark)
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in chunks before they have numbers: doc_id, text, ticker, section, fiscal_year, fiscal_quarter, hash, form. Documents stay where they lie."""
    (docs,) = tables(spark, sf_dir, "documents")
    h = (F.col("doc_id") * F.lit(1103515245).cast("bigint") + 12345) % F.lit(2147483648).cast("bigint")
    bits = lambda shift, n: F.shiftright("h", shift) % n
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int") + 1)
    d = docs.select("doc_id", "text", "source", h.alias("h")).select(
        "doc_id",
        "text",
        F.concat(F.lit("SR"), F.char(65 + F.substring("source", 4, 9).cast("int"))).alias("ticker"),
        pick(SECTIONS, bits(10, 8)).alias("section"),
        (2022 + bits(16, 4)).cast("int").alias("fiscal_year"),
        pick(["FY", "Q1", "Q2", "Q3"], bits(20, 4)).alias("fiscal_quarter"),
        F.substring(F.md5("text"), 1, 12).alias("hash"),
    )
    return d.withColumn("form", F.when(F.col("fiscal_quarter") == "FY", "10-K").otherwise("10-Q"))


def numbered(d: DataFrame) -> DataFrame:
    """Stand-in chunks with `chunk` and `id`. Every column goes through a shuffle, so texts had better not be among them."""
    w = Window.partitionBy("ticker", "form", "fiscal_year", "fiscal_quarter", "section").orderBy("doc_id")
    d = d.withColumn("chunk", (F.row_number().over(w) - 1).cast("int"))
    return d.withColumn("id", F.concat_ws("-", "ticker", "form", "fiscal_year", "fiscal_quarter", "section", "chunk"))


def embedded(spark: SparkSession, sf_dir: str, d: DataFrame) -> DataFrame:
    """Rows (doc_id) with `embedding`, null without a vector."""
    (e,) = tables(spark, sf_dir, "embeddings")
    return d.join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """The stand-in chunks: doc_id, id, ticker, form, fiscal_year, fiscal_quarter, section, chunk, text, hash, and embedding (null without a vector) if asked for."""
    d = numbered(unnumbered(spark, sf_dir))
    return embedded(spark, sf_dir, d) if vectors else d


def with_texts(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    """hits (doc_id, hash) with `text`. Hits are few and distinct: they are sent to the documents, which stay where they lie. Of documents with one number the hash tells which is meant; of equal ones one is."""
    texts = unnumbered(spark, sf_dir).select(F.col("doc_id").alias("_doc"), F.col("hash").alias("_hash"), "text")
    on = (F.col("_doc") == F.col("doc_id")) & F.col("_hash").eqNullSafe(F.col("hash"))
    return texts.join(F.broadcast(hits), on).select(*hits.columns, "text").dropDuplicates(hits.columns)


def coverage(chunks_: DataFrame) -> DataFrame:
    """One row per filing of the stand-in: the filings that its chunks come from, with a period end by fiscal quarter."""
    month = F.when(F.col("fiscal_quarter") == "FY", 12).otherwise(3 * F.substring("fiscal_quarter", 2, 1).cast("int"))
    d = chunks_.select("ticker", "form", "fiscal_year", "fiscal_quarter").distinct()
    return d.withColumn("period_end", F.last_day(F.make_date("fiscal_year", month, F.lit(1))))


#: coverage() for DuckDB over a CTE `chunks`.
COVERAGE_SQL = "select *, last_day(make_date(fiscal_year, case when fiscal_quarter = 'FY' then 12 else 3 * cast(substr(fiscal_quarter, 2, 1) as int) end, 1)) as period_end from (select distinct ticker, form, fiscal_year, fiscal_quarter from chunks)"


def companies(spark: SparkSession) -> DataFrame:
    """A fabricated company dimension of 20 rows."""
    ends = ["12-31", "09-27", "01-26", "06-30"]
    rows = [(f"SR{chr(65 + k)}", f"Company {chr(65 + k)}", f"{k:010d}", f"Sector {k % 5}", f"Industry {k % 10}", [f"Co{chr(65 + k)}"], ends[k % 4], k) for k in range(20)]
    return spark.createDataFrame(rows, "ticker string, name string, cik string, sector string, industry string, aliases array<string>, fiscal_year_end string, k int")


#: companies() for DuckDB.
COMPANIES_SQL = "select 'SR' || chr(65 + k) as ticker, 'Company ' || chr(65 + k) as name, lpad(cast(k as varchar), 10, '0') as cik, 'Sector ' || (k % 5) as sector, 'Industry ' || (k % 10) as industry, ['Co' || chr(65 + k)] as aliases, (['12-31', '09-27', '01-26', '06-30'])[k % 4 + 1] as fiscal_year_end, k from (select cast(unnest(range(20)) as int) as k)"
