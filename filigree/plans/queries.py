"""Registered queries over whole tables, each with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from filigree.functions import cleaning, parsing
from filigree.functions.models import ExtractiveGenerator
from filigree.operators import chunks as chunk_ops, citations, coverage as cov_ops, evaluation, impact, index, search, sections
from filigree.plans import planning, standin
from filigree.plans.standin import tables
from filigree.sources.scratch import Scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
WITH = f"with chunks as ({standin.CHUNKS_SQL}), cov as ({standin.COVERAGE_SQL}), companies as ({standin.COMPANIES_SQL})"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# ------------------------------------------------------------------ search

_TERMS = r"[a-z0-9]+(?:[.''][a-z0-9]+)*"
_SEARCH = (
    WITH
    + f""", bags as (select id, regexp_extract_all(lower(concat_ws(' ', ticker, section, text)), '{_TERMS}') as terms from chunks),
 stats as (select count(*) as n_docs, avg(len(terms)) as avgdl from bags),
 post as (select term, id, dl, count(*) as tf from (select id, len(terms) as dl, unnest(terms) as term from bags) group by all),
 raw as (select term, ln((n_docs - df + 0.5) / (df + 0.5)) as raw from (select term, count(*) as df from post group by term), stats),
 idf as (select term, case when raw < 0 then (select 0.25 * avg(raw) from raw) else raw end as idf from raw),
 qterms as (select qid, term, count(*) as qf from (select item_id as qid, unnest(regexp_extract_all(lower(text), '{_TERMS}')) as term from benchmark) group by all),
 sparse as (select qid, id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from qterms join post using (term) join idf using (term), stats group by all),
 s as (select qid, id, row_number() over (partition by qid order by round(score, 6) desc, id) as bm25_rank from sparse where score > 0 qualify bm25_rank <= 20),
 vec as (select c.id, e.embedding from chunks c join embeddings e on e.vec_id = c.doc_id),
 dense as (select b.item_id as qid, v.id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: cast(p[1] as double) * cast(p[2] as double))) as score from benchmark b join embeddings q on q.vec_id = b.item_id, vec v),
 d as (select qid, id, row_number() over (partition by qid order by round(score, 6) desc, id) as dense_rank from dense qualify dense_rank <= 20),
 fused as (select qid, id, dense_rank, bm25_rank, coalesce(1.0::double / (60 + dense_rank), 0) + coalesce(1.0::double / (60 + bm25_rank), 0) as rrf from d full join s using (qid, id)),
 placed as (select *, row_number() over (partition by qid order by round(rrf, 9) desc, dense_rank nulls last, bm25_rank nulls last, id) as place from fused)"""
)


def _text():
    return index.search_text("ticker", F.lit(None), F.lit(None), "section", "text")


def _bags(spark: SparkSession, sf_dir: str):
    """Chunks, and the terms of each, written once, with the weights made of them."""
    scratch = Scratch(spark, "bags")
    bags = scratch.keep(index.bags(standin.chunks(spark, sf_dir), _text()).withColumn("dl", F.size("terms")), "bags")
    stats = index.corpus_stats(bags)
    return standin.chunks(spark, sf_dir, vectors=True), bags, index.idf(scratch.keep(index.frequencies(bags), "df"), stats), stats


def _impacts(spark: SparkSession, sf_dir: str):
    """Chunks, bags, an impact-ordered index of them, weights and statistics."""
    c = standin.chunks(spark, sf_dir, vectors=True)
    scratch = Scratch(spark, "impacts")
    bags = scratch.keep(index.bags(c, _text()), "bags")
    stats = scratch.keep(index.corpus_stats(bags), "stats", rows=1)
    blocks = scratch.keep(impact.build(impact.counts(bags), stats), "blocks")
    return c, bags, blocks, scratch.keep(index.idf(blocks, stats), "idf"), stats


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a company dimension."""
    (s,) = tables(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        F.col("s_name").alias("ticker"), F.concat(F.lit("Company "), key).alias("name"), F.lpad(key.cast("string"), 10, "0").alias("cik"), F.concat(F.lit("Sector "), "s_nationkey").alias("sector"), F.concat(F.lit("Industry "), key % 7).alias("industry"),
        F.array(F.concat(F.lit("Co \"'"), key), F.concat(F.lit("é"), "s_nationkey")).alias("aliases"), F.when(key % 3 == 0, "06-30").when(key % 3 == 1, "12-31").alias("fiscal_year_end"),
    )


def _index(spark: SparkSession, sf_dir: str):
    """Chunks with texts and vectors, all their postings, weights and statistics."""
    c, bags, idf, stats = _bags(spark, sf_dir)
    return c, index.postings(bags), idf, stats


def _asked_index(spark: SparkSession, sf_dir: str, asked: DataFrame):
    """Chunks without their texts, postings of the terms asked for, weights and statistics. Texts are read once, where they lie; what is numbered, joined and shuffled are narrow rows."""
    scratch = Scratch(spark, "asked")
    rows = standin.unnumbered(spark, sf_dir).withColumns({"row": F.monotonically_increasing_id(), "terms": parsing.tokenize(_text())}).drop("text")
    bags = scratch.keep(rows.withColumn("dl", F.size("terms")), "bags")
    stats = index.corpus_stats(bags)
    idf = index.idf(scratch.keep(index.frequencies(bags), "df"), stats)
    c = scratch.keep(standin.embedded(spark, sf_dir, standin.numbered(bags.drop("terms", "dl"))), "chunks")
    post = index.postings(bags.select(F.col("row").alias("id"), "terms"), only=asked).withColumnRenamed("id", "row")
    return c, post.join(c.select("row", "id", "ticker"), "row").drop("row"), idf, stats


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as queries; the vector of the same number where there is one."""
    b, e = tables(spark, sf_dir, "benchmark", "embeddings")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("query")).join(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), "qid", "left")


@query(_SEARCH + " select n_docs, round(avgdl, 6) as avgdl, (select count(*) from idf) as n_terms, (select round(sum(idf), 4) from idf) as idf_sum from stats")
def bm25_stats(spark, sf_dir):
    _, _, idf, stats = _bags(spark, sf_dir)
    terms = idf.agg(F.count("*").alias("n_terms"), F.round(F.sum("idf"), 4).alias("idf_sum"))
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl")).crossJoin(terms)


@query(_SEARCH + " select qid, id, bm25_rank from s")
def bm25_topk(spark, sf_dir):
    _, bags, idf, stats = _bags(spark, sf_dir)
    return search.sparse_topk(_questions(spark, sf_dir), bags, idf, stats, 20).select("qid", "id", "bm25_rank")


@query(_SEARCH + " select qid, id, bm25_rank from s")
def bm25_impact(spark, sf_dir):
    """The same ranks from the impact-ordered index, which suits few questions over many chunks."""
    _, bags, blocks, idf, stats = _impacts(spark, sf_dir)
    return search.sparse_topk(_questions(spark, sf_dir), bags, idf, stats, 20, blocks).select("qid", "id", "bm25_rank")


@query("""select q.vec_id as qid, v.vec_id as id, row_number() over (partition by q.vec_id order by round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: cast(p[1] as double) * cast(p[2] as double))), 6) desc, v.vec_id) as dense_rank
 from embeddings q, embeddings v where q.vec_id % 50 = 0 qualify dense_rank <= 20""")
def dense_topk(spark, sf_dir):
    (e,) = tables(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return search.dense_topk(q, e.select(F.col("vec_id").alias("id"), "embedding"), 20).select("qid", "id", "dense_rank")


@query(_SEARCH + " select qid, id, round(rrf, 5) as rrf, dense_rank, bm25_rank, place from placed")
def hybrid_search(spark, sf_dir):
    c, bags, idf, stats = _bags(spark, sf_dir)
    hits = search.hybrid(_questions(spark, sf_dir), c, bags, idf, stats)
    return hits.select("qid", "id", F.round("rrf", 5).alias("rrf"), "dense_rank", "bm25_rank", "place")


@query(_SEARCH + """ select qid, ticker, fiscal_year, id, quota from (
  select qid, c.ticker, c.fiscal_year, id, row_number() over (partition by qid, c.ticker, c.fiscal_year order by place) as quota from placed join chunks c using (id)) where quota <= 2""")
def hybrid_quota(spark, sf_dir):
    c, bags, idf, stats = _bags(spark, sf_dir)
    hits = search.hybrid(_questions(spark, sf_dir), c, bags, idf, stats).join(c.select("id", "ticker", "fiscal_year"), "id")
    w = Window.partitionBy("qid", "ticker", "fiscal_year").orderBy("place")
    return hits.withColumn("quota", long(F.row_number().over(w))).where("quota <= 2").select("qid", "ticker", "fiscal_year", "id", "quota")


@query("""with lists as (select label as qid, 1 as list, vec_id as id, row_number() over (partition by label order by embedding[1] desc, vec_id) as rank from embeddings
 union all select label, 2, vec_id, row_number() over (partition by label order by embedding[2] desc, vec_id) from embeddings)
 select qid, id, round(sum(1.0::double / (60 + rank)), 9) as score from lists group by all""")
def rrf_fusion(spark, sf_dir):
    """Two rankings of the vectors of each label, fused."""
    (e,) = tables(spark, sf_dir, "embeddings")
    rank = lambda k: F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.col("embedding")[k]), "vec_id"))
    lists = e.select(F.col("label").alias("qid"), F.lit(1).alias("list"), F.col("vec_id").alias("id"), rank(0).alias("rank")).union(e.select("label", F.lit(2), "vec_id", rank(1)))
    return search.rrf(lists).select("qid", "id", F.round("score", 9).alias("score"))


# ------------------------------------------------------------------ filings, periods, coverage

_FILINGS = """with companies as (%s), filed as (select o_orderkey as file, cast(o_orderdate as date) as period_end, o_orderkey as seq, k.*, case when o_orderkey %% 4 = 0 then '10-K' else '10-Q' end as form,
   case o_orderkey %% 5 when 0 then '' when 1 then 'FY' when 2 then cast(year(cast(o_orderdate as date)) as varchar) || 'Q1' when 3 then '2024FY' else cast(year(cast(o_orderdate as date)) + 1 as varchar) || 'Q3' end as tag
   from orders o join companies k on k.k = o.o_custkey %% 20),
 ends as (select *, cast(period_end - interval 10 day as date) as low, cast(substr(fiscal_year_end, 1, 2) as int) as mm, cast(substr(fiscal_year_end, 4, 2) as int) as dd from filed),
 ends2 as (select *, case when make_date(year(period_end) - 1, mm, dd) >= low then make_date(year(period_end) - 1, mm, dd) when make_date(year(period_end), mm, dd) >= low then make_date(year(period_end), mm, dd) else make_date(year(period_end) + 1, mm, dd) end as fye from ends),
 fiscal as (select *, cast(year(fye) as int) as fiscal_year, case when form = '10-K' then 'FY' else 'Q' || least(greatest(cast(round(date_diff('day', make_date(year(fye) - 1, mm, dd), period_end) / 91.3) as int), 1), 4) end as fiscal_quarter from ends2)""" % standin.COMPANIES_SQL


def _filed(spark, sf_dir):
    """Orders as a filing calendar: the order date is a period end, the customer a company."""
    (o,) = tables(spark, sf_dir, "orders")
    d = o.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("period_end"))
    key = F.col("o_orderkey")
    year = F.year("period_end")
    tag = F.when(key % 5 == 0, "").when(key % 5 == 1, "FY").when(key % 5 == 2, F.concat(year, F.lit("Q1"))).when(key % 5 == 3, "2024FY").otherwise(F.concat(year + 1, F.lit("Q3")))
    d = d.withColumns({"form": F.when(key % 4 == 0, "10-K").otherwise("10-Q"), "tag": tag, "k": (F.col("o_custkey") % 20).cast("int")})
    d = d.join(F.broadcast(standin.companies(spark)), "k").withColumns({"file": key, "seq": key})
    fy = parsing.fiscal_year(F.col("period_end"), F.col("fiscal_year_end"))
    return d.withColumns({"fiscal_year": fy, "fiscal_quarter": parsing.fiscal_quarter(F.col("period_end"), F.col("fiscal_year_end"), F.col("form"))})


@query(_FILINGS + " select file, fiscal_year, fiscal_quarter from fiscal")
def fiscal_period(spark, sf_dir):
    return _filed(spark, sf_dir).select("file", "fiscal_year", "fiscal_quarter")


@query(_FILINGS + """ select file, (case when fiscal_quarter = 'FY' then '' else fiscal_quarter || ' ' end) || 'FY' || (case when length(tag) > 3 and suffix(tag, fiscal_quarter) then substr(tag, 1, 4) else cast(fiscal_year as varchar) end) as fiscal_label from fiscal""")
def fiscal_label(spark, sf_dir):
    return _filed(spark, sf_dir).select("file", parsing.fiscal_label(F.col("fiscal_year"), F.col("fiscal_quarter"), F.col("tag")).alias("fiscal_label"))


@query(_FILINGS + " select file, tag <> '' and not (suffix(tag, fiscal_quarter) and (length(tag) <= 3 or prefix(tag, cast(fiscal_year as varchar)))) as mismatch from fiscal")
def xbrl_mismatch(spark, sf_dir):
    return _filed(spark, sf_dir).select("file", parsing.tag_mismatch(F.col("fiscal_year"), F.col("fiscal_quarter"), F.col("tag")).alias("mismatch"))


@query(_FILINGS + " select ticker, strftime(arg_max(period_end, (period_end, seq)), '%m-%d') as fye from filed where form = '10-K' group by ticker")
def year_ends(spark, sf_dir):
    return cov_ops.fiscal_year_ends(_filed(spark, sf_dir).withColumn("tag_fye", F.lit("")))


@query(_FILINGS + " select ticker, form, fiscal_year, fiscal_quarter, count(*) as n from fiscal group by all having count(*) > 1")
def dup_filings(spark, sf_dir):
    return cov_ops.duplicates(_filed(spark, sf_dir))


@query(_FILINGS + " select form, fiscal_quarter, count(*) as n from fiscal group by all")
def filing_counts(spark, sf_dir):
    return cov_ops.counts(_filed(spark, sf_dir), "form", "fiscal_quarter")


@query(_FILINGS + " select file from (select file, row_number() over (partition by ticker, form, fiscal_year, fiscal_quarter order by period_end desc, file desc) as n from fiscal) where n = 1")
def latest_filings(spark, sf_dir):
    return cov_ops.latest_wins(_filed(spark, sf_dir).withColumn("filing_date", F.col("period_end"))).select("file")


@query(
    """select o_orderkey as file, 'SR' || chr(65 + cast(o_custkey % 20 as int)) as ticker, case when o_orderkey % 4 = 0 then '10-K' else '10-Q' end as form, cast(o_orderdate as date) as filing_date,
 case o_orderkey % 3 when 2 then null when 1 then cast(o_orderdate + interval 180 month as date) else cast(o_orderdate as date) end as period_end, case o_orderkey % 3 when 0 then 'header' when 1 then 'url' else 'missing' end as period_end_src,
 'b: ' || o_orderpriority as header_quarter, case when o_orderkey % 2 = 0 then '2024Q3' else '' end as xbrl_period from orders"""
)
def header_parse(spark, sf_dir):
    """Header texts are written from orders and read back: a repeated key, a value with ': ', and three sources of the period."""
    (o,) = tables(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    key = F.col("o_orderkey")
    period = F.when(key % 3 == 0, F.concat(F.lit("Report Period: "), day)).when(key % 3 == 1, F.concat(F.lit("URL: https://host/a/x-"), F.date_format(F.add_months("o_orderdate", 180), "yyyyMMdd"), F.lit(".htm"))).otherwise("URL: https://host/20200101/x.htm")
    lines = [F.lit("Ticker: OLD"), F.concat(F.lit("Ticker:  SR"), F.char(65 + (F.col("o_custkey") % 20).cast("int"))), F.lit("Company: Some Company"), F.concat(F.lit("Filing Type: "), F.when(key % 4 == 0, "10-K annual").otherwise("10-Q")), F.concat(F.lit("Filing Date: "), day), F.concat(F.lit("Quarter: b: "), "o_orderpriority"), F.lit("no pair"), period, F.lit("=" * 24)]
    body = F.concat(F.when(key % 2 == 0, "x 2024Q3 y").otherwise("nothing"), F.lit("\nmore"))
    raw = o.select(key.alias("file"), key.alias("seq"), F.concat_ws("\n", *lines, body).alias("text"))
    return cov_ops.filings(raw).select("file", "ticker", "form", "filing_date", "period_end", "period_end_src", "header_quarter", "xbrl_period")


@query(WITH + """ select ticker, """ + ", ".join(f"coalesce(string_agg(q, '' order by q) filter (y = {y}), '') as fy{y}" for y in range(2022, 2026)) + """ from (
 select ticker, fiscal_year as y, substr(fiscal_quarter, 2, 1) as q from cov where form = '10-Q' union select ticker, null, null from cov) group by ticker""")
def coverage_grid(spark, sf_dir):
    """Quarters reported in each of the stand-in's four fiscal years, a column a year."""
    grid = cov_ops.grid(standin.coverage(standin.chunks(spark, sf_dir)), [2022, 2023, 2024, 2025])
    return grid.select("ticker", *[F.translate(c, ".", "").alias(c) for c in grid.columns[1:]])


@query(WITH + """ select ticker, string_agg(cell, ' ' order by y) as grid from (select ticker, y, string_agg(case when n is null then '.' else substr(q, 2, 1) end, '' order by q) as cell from
 (select distinct ticker from cov) cross join (select distinct fiscal_year as y from cov where fiscal_year >= 2022) cross join (select unnest(['Q1', 'Q2', 'Q3']) as q)
 left join (select ticker, fiscal_year as y, fiscal_quarter as q, count(*) as n from cov where form = '10-Q' group by all) using (ticker, y, q) group by ticker, y) group by ticker""")
def coverage_grid_all(spark, sf_dir):
    """The grid as the reference prints it: every fiscal year since 2022, a dot for each quarter without a report."""
    grid = cov_ops.grid(standin.coverage(standin.chunks(spark, sf_dir)))
    return grid.select("ticker", F.concat_ws(" ", *grid.columns[1:]).alias("grid"))


@query(WITH + " select ticker from cov where form = '10-Q' and fiscal_year between 2023 and 2025 and fiscal_quarter in ('Q1', 'Q2', 'Q3') group by ticker having count(distinct (fiscal_year, fiscal_quarter)) = 9")
def fully_covered(spark, sf_dir):
    return cov_ops.fully_covered(standin.coverage(standin.chunks(spark, sf_dir)))


@query("select 'Sector ' || s_nationkey as sector, 'Industry ' || (s_suppkey % 7) as industry, string_agg(s_name, ' ' order by s_name) as tickers from supplier group by all")
def group_lists(spark, sf_dir):
    """Suppliers as companies, listed by nation and industry."""
    return cov_ops.companies_by_industry(_suppliers(spark, sf_dir))


@query(WITH + """ select ticker, concat_ws(' | ', ticker, name, array_to_string(aliases, ', '), sector || ' / ' || industry, 'FYE ' || fiscal_year_end, fs) as line from companies join (
 select ticker, string_agg('FY' || fiscal_year || ': ' || qs, '; ' order by fiscal_year) as fs from (select ticker, fiscal_year, string_agg(fiscal_quarter, ',' order by period_end, fiscal_quarter) as qs from cov group by all) group by ticker) using (ticker)""")
def company_table(spark, sf_dir):
    return cov_ops.company_table(standin.companies(spark), standin.coverage(standin.chunks(spark, sf_dir)))


@query(WITH + " select distinct fiscal_year from cov where fiscal_year >= 2022")
def fiscal_years(spark, sf_dir):
    return cov_ops.fiscal_years(standin.coverage(standin.chunks(spark, sf_dir)))


@query(_FILINGS + """ select ticker, c.name, c.cik, c.sector, c.industry, case when ticker = 'SRA' then '11-11' else e.fye end as fiscal_year_end from companies c
 join (select ticker, strftime(arg_max(period_end, (period_end, seq)), '%m-%d') as fye from filed where form = '10-K' group by ticker) e using (ticker)""")
def draft_companies(spark, sf_dir):
    rows = _filed(spark, sf_dir).withColumns({"tag_fye": F.lit(""), "company": F.col("name")})
    had = standin.companies(spark).withColumn("fiscal_year_end", F.when(F.col("ticker") == "SRA", "11-11").otherwise(""))
    out = cov_ops.draft_companies(rows, cov_ops.fiscal_year_ends(rows), had)
    return out.select("ticker", "name", "cik", "sector", "industry", "fiscal_year_end")


# ------------------------------------------------------------------ cleaning, sections, chunks


@query(r"select doc_id, md5(replace(replace(replace(text || chr(160) || 'a' || chr(8203) || 'b' || chr(8201), chr(160), ' '), chr(8203), ''), chr(8201), ' ')) as h from documents")
def char_norm(spark, sf_dir):
    (d,) = tables(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(cleaning.plain_spaces(F.concat("text", F.lit("\u00a0a\u200bb\u2009")))).alias("h"))


@query(r"select doc_id, md5(regexp_replace(regexp_replace(text || E'\n 53Table of Contents' || E'\n 12 \nAcme Inc. | 2024 Form 10-K | 20 end', '\s*\d{0,3}\s*Table of Contents', E'\n', 'g'), '\n\s*\d{1,3}\s*\n', E'\n', 'g')) as h from documents")
def page_strip(spark, sf_dir):
    (d,) = tables(spark, sf_dir, "documents")
    t = F.concat("text", F.lit("\n 53Table of Contents\n 12 \nAcme Inc. | 2024 Form 10-K | 20 end"))
    return d.select("doc_id", F.md5(cleaning.drop_page_numbers(cleaning.drop_page_links(t))).alias("h"))


@query(r"select doc_id, md5(regexp_replace(text || ' 1. Acme Inc. | 2024 Form 10-K | 20 end', '[A-Z][A-Za-z0-9.,&’'' ]{1,40}\|\s*20\d\d Form 10-[KQ]\s*\|\s*\d{1,3}', ' ', 'g')) as h from documents")
def footer_strip(spark, sf_dir):
    (d,) = tables(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(cleaning.drop_footers(F.concat("text", F.lit(" 1. Acme Inc. | 2024 Form 10-K | 20 end")))).alias("h"))


@query(r"select doc_id, md5('UNITED  STATES SECURITIES AND EXCHANGE COMMISSION ' || text) as h from documents")
def preamble_strip(spark, sf_dir):
    (d,) = tables(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(cleaning.drop_preamble(F.concat(F.lit("tags\n"), F.lit("UNITED  STATES SECURITIES AND EXCHANGE COMMISSION "), "text"))).alias("h"))


@query("""select l_orderkey, l_linenumber, 'Row ' || l_linenumber || ' | $' || l_partkey || ' | (' || l_suppkey || ') | ' || l_linenumber || '%' || chr(10) || 'a b' as line from lineitem""")
def normalize_tables(spark, sf_dir):
    (l,) = tables(spark, sf_dir, "lineitem")
    raw = F.concat(F.lit("| Row  "), "l_linenumber", F.lit(" | | $ | "), "l_partkey", F.lit(" |  | ( | "), "l_suppkey", F.lit(" | ) | "), "l_linenumber", F.lit(" | % | |\n\n a \t b "))
    return l.select("l_orderkey", "l_linenumber", cleaning.normalize_tables(raw).alias("line"))


_ITEMS = "select l_orderkey as file, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos, case when l_orderkey % 2 = 0 then '10-K' else '10-Q' end as form, (['1','1A','2','3','4','5','7','8'])[l_partkey % 8 + 1] as item, case when l_suppkey % 9 = 0 then 'Item x. Legal Proceedings' else 'Item x' end as title from lineitem"


@query(f"""with items as ({_ITEMS}), r as (select *, (cast(regexp_extract(item, '^[0-9]+') as int), item) as rk from items),
 b as (select *, item in ('5','6') or coalesce(rk < lag(rk) over (partition by file order by pos), false) as back from r),
 p as (select *, bool_or(back) over (partition by file order by pos rows unbounded preceding) as part2 from b)
 select file, pos, case when form = '10-K' then coalesce(map {{'1':'business','1A':'risk_factors','3':'legal','7':'mdna','7A':'market_risk','8':'financials','9A':'controls','15':'financials'}}[item], 'other')
  when item in ('1','1A','2','3','4') and title like '%Legal%' then 'legal' when part2 then coalesce(map {{'1':'legal','1A':'risk_factors'}}[item], 'other') else coalesce(map {{'1':'financials','2':'mdna','3':'market_risk','4':'controls'}}[item], 'other') end as label from p""")
def label_items(spark, sf_dir):
    (l,) = tables(spark, sf_dir, "lineitem")
    item = F.element_at(F.array(*[F.lit(x) for x in ("1", "1A", "2", "3", "4", "5", "7", "8")]), (F.col("l_partkey") % 8 + 1).cast("int"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    d = l.select(F.col("l_orderkey").alias("file"), long(place).alias("pos"), F.when(F.col("l_orderkey") % 2 == 0, "10-K").otherwise("10-Q").alias("form"), item.alias("item"), F.when(F.col("l_suppkey") % 9 == 0, "Item x. Legal Proceedings").otherwise("Item x").alias("title"))
    return sections.label_items(d).select("file", "pos", "label")


_REPORT = ("PART I\n", "Item 1. Business\n", "\nItem 1A. Risk Factors\n", "\nItem 3. Legal Proceedings\n")


@query("""select doc_id, label, seq, md5(text) as h from (select doc_id, 'other' as label, 0 as seq, 'PART I' || chr(10) as text from documents
 union all select doc_id, 'business', 1, 'Item 1. Business' || chr(10) || text || chr(10) from documents
 union all select doc_id, 'risk_factors', 2, 'Item 1A. Risk Factors' || chr(10) || text || chr(10) from documents
 union all select doc_id, 'legal', 3, 'Item 3. Legal Proceedings' || chr(10) || text from documents)""")
def split_sections(spark, sf_dir):
    """Each text three times under the items of an annual report, split again."""
    (d,) = tables(spark, sf_dir, "documents")
    a, b, c, e = _REPORT
    text = F.concat(F.lit(a + b), "text", F.lit(c), "text", F.lit(e), "text")
    out = sections.split_sections(d.select("doc_id", text.alias("text"), F.lit("10-K").alias("form")), key="doc_id")
    return out.select("doc_id", "label", "seq", F.md5("text").alias("h"))


@query(r"select doc_id, cast(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\sA-Za-z0-9]')) as bigint) as n from documents")
def token_counts(spark, sf_dir):
    (d,) = tables(spark, sf_dir, "documents")
    return d.select("doc_id", chunk_ops.count_tokens(F.col("text")).alias("n"))


@query("""with lines as (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as line from documents),
 f as (select *, contains(s, ' | ') as t, lag(contains(s, ' | '), 1, false) over (partition by doc_id order by line) as was from lines),
 g as (select *, sum(case when t and was then 0 else 1 end) over (partition by doc_id order by line) - 1 as unit from f)
 select doc_id, cast(unit as bigint) as unit, t as is_table, md5(string_agg(s, chr(10) order by line)) as h from g group by doc_id, unit, t""")
def units(spark, sf_dir):
    (d,) = tables(spark, sf_dir, "documents")
    return chunk_ops.unit_rows(d, "doc_id", "text").select("doc_id", long("unit").alias("unit"), "is_table", F.md5("text").alias("h"))


@query(WITH + " select doc_id, id, chunk, hash from chunks")
def chunk_ids(spark, sf_dir):
    return standin.chunks(spark, sf_dir).select("doc_id", "id", "chunk", "hash")


@query(WITH + " select concat_ws('-', ticker, form, fiscal_year, fiscal_quarter) as file, section, count(*) as n from chunks group by rollup (concat_ws('-', ticker, form, fiscal_year, fiscal_quarter), section)")
def chunk_totals(spark, sf_dir):
    return chunk_ops.chunk_totals(standin.chunks(spark, sf_dir).withColumn("file", F.concat_ws("-", "ticker", "form", "fiscal_year", "fiscal_quarter")))


@query()
def chunk_text(spark, sf_dir):
    """Chunks of every document; greedy merging with carried tails has no SQL form."""
    (d,) = tables(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(chunk_ops.chunker(200, 25)(F.col("text"))).alias("part", "text"))


# ------------------------------------------------------------------ index upkeep

_OLD = WITH + ", old as (select id, case when doc_id % 10 = 0 then 'changed' else hash end as hash from chunks where fiscal_year < 2025), new as (select id, hash from chunks where fiscal_year > 2022)"


def _versions(spark, sf_dir):
    c = standin.chunks(spark, sf_dir)
    old = c.where("fiscal_year < 2025").withColumn("hash", F.when(F.col("doc_id") % 10 == 0, "changed").otherwise(F.col("hash")))
    return old, c.where("fiscal_year > 2022")


@query(_OLD + " select id from old anti join new using (id)")
def stale_ids(spark, sf_dir):
    return index.stale_ids(*_versions(spark, sf_dir))


@query(_OLD + " select n.id from new n left join old o using (id) where n.hash is distinct from o.hash")
def changed_ids(spark, sf_dir):
    return index.changed_ids(*_versions(spark, sf_dir))


@query(_OLD + " select (select count(*) from new n left join old o using (id) where n.hash is distinct from o.hash) as upserted, (select count(*) from old anti join new using (id)) as deleted")
def index_changes(spark, sf_dir):
    return index.changes(*_versions(spark, sf_dir))


@query(_OLD + " select n.id, n.hash, n.hash is not distinct from o.hash as had_vector from new n left join old o using (id)")
def upsert_merge(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    old = old.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    return index.merged(old, new).select("id", "hash", F.col("embedding").isNotNull().alias("had_vector"))


# ------------------------------------------------------------------ planning and retrieval

_PLANS = [
    ("SRA", "that and onesen", ["mdna"], [], [], None, ["FY"]),
    ("SRB", "erblest it hein", [], [2023, 2030], [], None, []),
    ("SRC", "than heoron", ["risk_factors"], [], [2022, 2024], None, ["Q1"]),
    ("SRD", "the thonen of", [], [], [], 2, []),
    ("SRE", "in therha", ["legal"], [], [], None, ["Q2", "Q3"]),
    ("SRF", "eaea ndorea", ["controls"], [1999], [], None, []),
]


def _plan_sql() -> str:
    arr = lambda v, t: "[" + ", ".join(repr(x) for x in v) + f"]::{t}[]"
    rows = ", ".join(f"({k}, '{t}', '{q}', {arr(s, 'varchar')}, {arr(o, 'int')}, {arr(p, 'int')}, {n if n else 'null'}::int, {arr(pt, 'varchar')})" for k, (t, q, s, o, p, n, pt) in enumerate(_PLANS))
    return f"subq as (select * from (values {rows}) v(sq, ticker, query, sections, own_years, plan_years, last_n_years, periods))"


_RESOLVED = (
    WITH
    + ", "
    + _plan_sql()
    + """, both_ as (select s.sq, s.periods, s.last_n_years, c.fiscal_year, c.fiscal_quarter, c.period_end, max(c.period_end) over (partition by s.sq) as latest from subq s join cov c using (ticker)),
 by_sq as (select sq, list_sort(list(distinct fiscal_year) filter (period_end > latest - to_months(12 * last_n_years))) as span,
   coalesce(arg_max(fiscal_year, (period_end, fiscal_year)) filter (len(periods) = 0 or list_contains(periods, fiscal_quarter)), arg_max(fiscal_year, (period_end, fiscal_year))) as last from both_ group by sq),
 resolved as (select subq.*, case when len(own_years) > 0 then own_years when len(plan_years) > 0 then plan_years when len(span) > 0 then span when last is not null then [last] else []::int[] end as fiscal_years from subq left join by_sq using (sq)),
 asked as (select *, unnest(fiscal_years) as fiscal_year from resolved),
 gaps as (select sq, ticker, fiscal_year, ticker || ': no ' || (case when len(periods) = 0 then 'filing' else array_to_string(list_transform(periods, lambda p: case when p = 'FY' then '10-K' else p || ' 10-Q' end), '/') end) || ' for FY' || fiscal_year || ' in the corpus' as gap
   from asked a where not exists (select 1 from cov c where c.ticker = a.ticker and c.fiscal_year = a.fiscal_year and (len(a.periods) = 0 or list_contains(a.periods, c.fiscal_quarter)))),
 years_ as (select a.* from asked a where exists (select 1 from cov c where c.ticker = a.ticker and c.fiscal_year = a.fiscal_year))"""
)


def _subqueries(spark, sf_dir):
    rows = [(k, *p) for k, p in enumerate(_PLANS)]
    d = spark.createDataFrame(rows, "sq int, ticker string, query string, sections array<string>, own_years array<int>, plan_years array<int>, last_n_years int, periods array<string>")
    cov = standin.coverage(standin.chunks(spark, sf_dir))
    return planning.resolve_years(d, cov), cov


@query(_RESOLVED + " select sq, ticker, array_to_string(fiscal_years, ',') as years from resolved")
def resolve_years(spark, sf_dir):
    subq, _ = _subqueries(spark, sf_dir)
    return subq.select("sq", "ticker", F.array_join("fiscal_years", ",").alias("years"))


@query(_RESOLVED + " select sq, fiscal_year, gap from gaps")
def coverage_gaps(spark, sf_dir):
    return planning.coverage_gaps(*_subqueries(spark, sf_dir)).select("sq", "fiscal_year", "gap")


@query(_RESOLVED + """ select y.sq, y.fiscal_year, c.id, case when (len(periods) = 0 or list_contains(periods, c.fiscal_quarter)) then case when len(sections) = 0 or list_contains(sections, c.section) then 0 else 1 end else 2 end as own_tier
 from years_ y join chunks c using (ticker, fiscal_year)""")
def relax_tiers(spark, sf_dir):
    subq, cov = _subqueries(spark, sf_dir)
    years = planning.search_years(subq, cov).withColumn("vector", F.lit(None).cast("array<float>"))
    c = standin.chunks(spark, sf_dir, vectors=True)
    return search.relevant(years, c).select("sq", "fiscal_year", "id", "own_tier")


_RETRIEVED = (
    _RESOLVED
    + _SEARCH[len(WITH) :].replace("item_id as qid, unnest(regexp_extract_all(lower(text)", "sq as qid, unnest(regexp_extract_all(lower(query)").replace("from benchmark) group by all", "from subq) group by all")
    + """, seen as (select y.sq, y.fiscal_year, c.id, t.tier from years_ y join chunks c using (ticker, fiscal_year) cross join (select unnest([0, 1, 2]) as tier) t
   where t.tier >= case when (len(periods) = 0 or list_contains(periods, c.fiscal_quarter)) then case when len(sections) = 0 or list_contains(sections, c.section) then 0 else 1 end else 2 end),
 rd as (select x.sq, x.fiscal_year, x.tier, x.id, row_number() over (partition by x.sq, x.fiscal_year, x.tier order by round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: cast(p[1] as double) * cast(p[2] as double))), 6) desc, x.id) as dense_rank
   from seen x join vec v using (id) join embeddings q on q.vec_id = x.sq qualify dense_rank <= 20),
 rs as (select x.sq, x.fiscal_year, x.tier, x.id, row_number() over (partition by x.sq, x.fiscal_year, x.tier order by round(score, 6) desc, x.id) as bm25_rank from seen x join sparse p on p.qid = x.sq and p.id = x.id where score > 0 qualify bm25_rank <= 20),
 rf as (select sq, fiscal_year, tier, id, dense_rank, bm25_rank, coalesce(1.0::double / (60 + dense_rank), 0) + coalesce(1.0::double / (60 + bm25_rank), 0) as rrf, min(tier) over (partition by sq, fiscal_year) as best from rd full join rs using (sq, fiscal_year, tier, id)),
 kept as (select *, row_number() over (partition by sq, fiscal_year order by round(rrf, 9) desc, dense_rank nulls last, bm25_rank nulls last, id) as place from rf where tier = best qualify place <= 5)"""
)


def _retrieved(spark, sf_dir):
    """Sub-queries, chunks without their texts, and hits. All three are written once: what follows reads them again and again."""
    scratch = Scratch(spark, "retrieved")
    subq, cov = _subqueries(spark, sf_dir)
    subq = scratch.keep(subq, "subqueries", rows=len(_PLANS))
    (e,) = tables(spark, sf_dir, "embeddings")
    years = planning.search_years(subq, cov).join(e.select(F.col("vec_id").cast("int").alias("sq"), F.col("embedding").alias("vector")), "sq", "left")
    years = scratch.keep(years, "years")
    asked = subq.select(F.explode(parsing.tokenize(F.col("query"))).alias("term"))
    c, post, idf, stats = _asked_index(spark, sf_dir, asked)
    return subq, c, scratch.keep(search.relaxed(years, c, post, idf, stats), "hits")


@query(_RETRIEVED + " select sq, fiscal_year, tier, id, place from kept")
def retrieve_full(spark, sf_dir):
    return _retrieved(spark, sf_dir)[2].select("sq", "fiscal_year", "tier", "id", "place")


@query(_RETRIEVED + " select s.sq, s.ticker || ': no matching chunks' as gap from subq s anti join kept k on k.sq = s.sq")
def empty_gaps(spark, sf_dir):
    subq, _, hits = _retrieved(spark, sf_dir)
    return planning.empty_gaps(subq, hits).select("sq", "gap")


@query(_RETRIEVED + """ select distinct k.sq, k.fiscal_year, s.ticker || ' ' || k.fiscal_year || ': relaxed filters to sections=any, periods=' || (case when k.tier = 1 and len(periods) > 0 then array_to_string(periods, ',') else 'any' end) as note
 from kept k join subq s on s.sq = k.sq where k.tier > 0 and (len(sections) > 0 or len(periods) > 0)""")
def relaxation_notes(spark, sf_dir):
    subq, _, hits = _retrieved(spark, sf_dir)
    return planning.relaxation_notes(subq, hits)


# ------------------------------------------------------------------ citations


@query(_RETRIEVED + " select k.sq, k.id, s.ticker || '-' || row_number() over (partition by k.sq order by k.fiscal_year, k.place) as label from kept k join subq s on s.sq = k.sq")
def label_chunks(spark, sf_dir):
    subq, _, hits = _retrieved(spark, sf_dir)
    return citations.labels(hits.join(subq.select("sq", "ticker"), "sq"), by=("sq",)).select("sq", "id", "label")


@query(_RETRIEVED + """, l as (select k.sq, k.id, s.ticker, row_number() over (partition by k.sq order by k.fiscal_year, k.place) as n from kept k join subq s on s.sq = k.sq)
 select l.sq, md5(string_agg('[' || l.ticker || '-' || n || '] (' || o.name || ', ' || c.form || ' FY' || c.fiscal_year || ', period ending ' || v.period_end || ', section ' || c.section || ')' || chr(10) || c.text, chr(10) || chr(10) order by n)) as h
 from l join chunks c using (id) join companies o on o.ticker = l.ticker join cov v on v.ticker = c.ticker and v.fiscal_year = c.fiscal_year and v.fiscal_quarter = c.fiscal_quarter group by l.sq""")
def prompt_blocks(spark, sf_dir):
    subq, c, hits = _retrieved(spark, sf_dir)
    rows = citations.labels(hits.join(subq.select("sq", "ticker"), "sq"), by=("sq",)).select("sq", "id", "label")
    cov = standin.coverage(c)
    rows = standin.with_texts(spark, sf_dir, rows.join(c.select("id", "doc_id", "hash", "ticker", "form", "fiscal_year", "fiscal_quarter", "section"), "id")).join(cov, ["ticker", "form", "fiscal_year", "fiscal_quarter"])
    rows = rows.join(standin.companies(spark).select("ticker", F.col("name").alias("company")), "ticker").withColumn("fiscal_label", F.concat(F.lit("FY"), "fiscal_year"))
    return citations.prompt_block(rows, by=("sq",)).select("sq", F.md5("block").alias("h"))


_ANSWERS = WITH + ", answers as (select doc_id as aid, 'See [' || id || '] and [' || id || ', SRZ-10-K-2020-FY-mdna-9] but not [note 1].' as text, id from chunks)"


def _answers(spark, sf_dir):
    c = standin.chunks(spark, sf_dir)
    said = F.concat(F.lit("See ["), "id", F.lit("] and ["), "id", F.lit(", SRZ-10-K-2020-FY-mdna-9] but not [note 1]."))
    return c.select(F.col("doc_id").alias("aid"), said.alias("text"), "id")


@query(_ANSWERS + " select aid, id || ' SRZ-10-K-2020-FY-mdna-9' as ids from answers")
def extract_citations(spark, sf_dir):
    return _answers(spark, sf_dir).select("aid", F.array_join(citations.citations(F.col("text")), " ").alias("ids"))


@query(_ANSWERS + " select aid, id as valid, 'SRZ-10-K-2020-FY-mdna-9' as invalid from answers")
def validate_citations(spark, sf_dir):
    a = _answers(spark, sf_dir)
    out = citations.validated(a.select("aid", "text"), a.select("aid", "id"))
    return out.select("aid", F.array_join("valid", " ").alias("valid"), F.array_join("invalid", " ").alias("invalid"))


@query(WITH + " select doc_id as aid, 'Up [' || id || ', ' || ticker || '-7] in [note 1], [' || ticker || '-1 odd].' as text, ticker || '-7' as unknown from chunks")
def resolve_labels(spark, sf_dir):
    c = standin.chunks(spark, sf_dir)
    said = F.concat(F.lit("Up ["), "ticker", F.lit("-1; "), "ticker", F.lit("-7] in [note 1], ["), "ticker", F.lit("-1 odd]."))
    known = F.create_map(F.concat("ticker", F.lit("-1")), F.col("id"))
    return c.select(F.col("doc_id").alias("aid"), citations.resolve(said, known).alias("text"), F.array_join(citations.unknown_labels(said, known), " ").alias("unknown"))


# ------------------------------------------------------------------ evaluation, models

_ROWS = """with rows_ as (select conv_id || '-' || turn as id, (['example','template','synthetic','unanswerable'])[(conv_id + turn) % 4 + 1] as type, case when length(text) % 7 = 0 then 'late' else '' end as error,
  case when length(text) % 3 = 0 then null else cast(length(text) % 2 as double) end as recall_at_5, cast(length(text) % 100 as double) / 10 as latency_s from conversations)"""


@query(_ROWS + " select coalesce(type, 'all') as type, count(*) as n, count(nullif(error, '')) as errors, round(avg(recall_at_5), 3) as recall_at_5, round(avg(latency_s), 3) as latency_s from rows_ group by grouping sets ((type), ())")
def eval_summary(spark, sf_dir):
    (c,) = tables(spark, sf_dir, "conversations")
    n = F.length("text")
    kind = F.element_at(F.array(*[F.lit(t) for t in evaluation.TYPES]), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    rows = c.select(kind.alias("type"), F.when(n % 7 == 0, "late").otherwise("").alias("error"), F.when(n % 3 != 0, (n % 2).cast("double")).alias("recall_at_5"), ((n % 100).cast("double") / 10).alias("latency_s"))
    return evaluation.summary(rows, ["recall_at_5", "latency_s"])


@query(_SEARCH + " select qid, cast(max(case when place <= 5 and list_contains([id], g) then 1 else 0 end) as int) as recall from (select p.qid, p.id, p.place, first(p.id) over (partition by p.qid order by p.bm25_rank nulls last, p.id) as g from placed p) group by qid")
def recall_at_5(spark, sf_dir):
    """Gold is the best sparse hit of each question; is it among the first five fused ones?"""
    c, bags, idf, stats = _bags(spark, sf_dir)
    hits = search.hybrid(_questions(spark, sf_dir), c, bags, idf, stats)
    by = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"), F.min_by("id", F.struct(F.coalesce("bm25_rank", F.lit(1 << 40)), F.col("id"))).alias("gold"))
    return by.select("qid", evaluation.recall_at(F.col("ids"), F.col("gold")).alias("recall"))


@query("""select doc_id, round((1 + (case when s then 1 else 0 end) + (case when y then 1 else 0 end) + (case when c then 1 else 0 end)) / 4.0::double, 6) as accuracy, concat_ws(' ', case when not s then 'sections' end, case when not y then 'years' end, case when not c then 'comparison' end) as misses
 from (select doc_id, doc_id % 3 <> 1 as s, doc_id % 2 = 0 as y, doc_id % 5 <> 0 as c from documents)""")
def planner_scores(spark, sf_dir):
    (d,) = tables(spark, sf_dir, "documents")
    k = F.col("doc_id")
    a = lambda *xs: F.array(*[F.lit(x) for x in xs])
    none = F.array().cast("array<string>")
    d = d.select("doc_id", a("B", "A").alias("plan_tickers"), a("A", "B").alias("expected_tickers"), a("mdna").alias("expected_sections"), F.when(k % 3 == 0, none).when(k % 3 == 1, a("legal")).otherwise(a("legal", "mdna")).alias("plan_sections"))
    d = d.withColumns({"expected_years": a(2023), "plan_years": F.when(k % 2 == 0, a(2022, 2023)).otherwise(a(2022)), "expected_last_n": F.lit(None).cast("int"), "plan_last_n": F.lit(2), "expected_comparison": F.lit(True), "plan_comparison": k % 5 != 0})
    accuracy, misses = evaluation.planner_checks()
    return d.select("doc_id", F.round(accuracy, 6).alias("accuracy"), F.array_join(misses, " ").alias("misses"))


@query(WITH + " select doc_id, case when chunk % 2 = 0 then 1.0::double else 0.5::double end as score from chunks")
def company_coverage(spark, sf_dir):
    c = standin.chunks(spark, sf_dir)
    gaps = F.when(F.col("chunk") % 2 == 0, F.array(F.lit("SRZ: no filing for FY2020 in the corpus"))).otherwise(F.array(F.lit("SRZZ: not in the corpus")))
    return c.select("doc_id", evaluation.company_coverage(F.array("ticker", F.lit("SRZ")), F.array("id"), gaps).alias("score"))


@query(WITH + " select doc_id, chunk % 2 = 0 or doc_id % 3 = 0 as abstained from chunks")
def abstained(spark, sf_dir):
    c = standin.chunks(spark, sf_dir)
    gaps = F.when(F.col("chunk") % 2 == 0, F.array(F.concat("ticker", F.lit(": no filing")))).otherwise(F.array(F.concat("ticker", F.lit("Z: no filing"))))
    said = F.when(F.col("doc_id") % 3 == 0, "The excerpts do not cover it. Gaps: two").otherwise("All is said. Gaps:\nnone")
    return c.select("doc_id", evaluation.abstained(F.col("ticker"), gaps, said).alias("abstained"))


@query()
def eval_sample(spark, sf_dir):
    """Chunks to ask about: the order is by a hash that SQL of another engine lacks."""
    c = standin.chunks(spark, sf_dir)
    return evaluation.synthetic_chunks(c, chunk_ops.count_tokens(F.col("text")), n=10)


@query()
def eval_items(spark, sf_dir):
    """Items of all four types over the stand-in companies; the offline model writes the synthetic questions."""
    c, comp = standin.chunks(spark, sf_dir), standin.companies(spark)
    cov = standin.coverage(c)
    label = F.concat(F.when(F.col("fiscal_quarter") == "FY", "").otherwise(F.concat("fiscal_quarter", F.lit(" "))), F.lit("FY"), "fiscal_year")
    named = c.join(comp.select("ticker", F.col("name").alias("company")), "ticker").withColumn("fiscal_label", label)
    return evaluation.build_set(comp, cov, cov_ops.fully_covered(cov), named, chunk_ops.count_tokens(F.col("text")), ExtractiveGenerator())


@query("select doc_id, case when doc_id % 2 = 0 then '{\"a\": {\"b\": ' || doc_id || '}}' else 'no object ' || doc_id end as obj from documents")
def json_object(spark, sf_dir):
    (d,) = tables(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('```json\n{"a": {"b": '), "doc_id", F.lit("}}\n``` done"))).otherwise(F.concat(F.lit("no object "), "doc_id"))
    return d.select("doc_id", parsing.json_object(raw).alias("obj"))


@query("select sha256('m|' || text) as key from conversations where turn > 0 except select sha256('m|' || text) from conversations where turn = 0")
def cache_misses(spark, sf_dir):
    from filigree.sources.cache import misses

    (c,) = tables(spark, sf_dir, "conversations")
    key = F.sha2(F.concat(F.lit("m|"), "text"), 256).alias("key")
    return misses(c.where("turn > 0").select(key), c.where("turn = 0").select(key)).select("key")


# more of them, over made-up filings, register themselves here
from filigree.plans import filing_queries  # noqa: E402, F401
