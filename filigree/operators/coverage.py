"""Filing coverage: periods and labels of filings, the company dimension, and reports on both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from filigree.functions import parsing as P

#: Columns of the coverage table (fixed values).
COLUMNS = ["ticker", "sector", "industry", "form", "fiscal_year", "fiscal_quarter", "fiscal_label", "period_end", "period_end_src", "filing_date", "header_quarter", "xbrl_period", "xbrl_mismatch", "status", "file"]


def filings(raw: DataFrame) -> DataFrame:
    """Header facts of raw filings (file, seq, text). Ticker, Company, Filing Type and Filing Date must be there; other keys default to empty."""
    d = raw.select("file", "seq", P.header_map(F.col("text")).alias("meta"), P.header_body(F.col("text")).alias("body"))

    def need(k):
        v = F.try_element_at("meta", F.lit(k))
        return F.when(v.isNull(), F.raise_error(F.concat(F.lit(f"no {k} in the header of "), F.col("file")))).otherwise(v)

    soft = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit(""))
    d = d.withColumn("p", P.period_end(F.col("meta"), F.col("body")))
    return d.select(
        "file",
        "seq",
        need("Ticker").alias("ticker"),
        need("Company").alias("company"),
        soft("CIK").alias("cik"),
        P.form(need("Filing Type")).alias("form"),
        F.try_to_date(need("Filing Date"), "yyyy-MM-dd").alias("filing_date"),
        F.col("p.date").alias("period_end"),
        F.col("p.src").alias("period_end_src"),
        soft("Quarter").alias("header_quarter"),
        F.coalesce(P.xbrl_period(F.col("body")), F.lit("")).alias("xbrl_period"),
        F.regexp_extract(F.substr("body", F.lit(1), F.lit(3000)), r"--(\d\d-\d\d)", 1).alias("tag_fye"),
    )


def fiscal_year_ends(rows: DataFrame) -> DataFrame:
    """(ticker, fye): month-day of the latest annual period end (a later row wins a tie), else of the tag in the ticker's first filing, else 12-31."""
    mmdd = F.date_format("period_end", "MM-dd")
    annual = (F.col("form") == "10-K") & F.col("period_end").isNotNull()
    best = F.max_by(F.when(annual, mmdd), F.when(annual, F.struct("period_end", "seq")))
    tag = F.min_by("tag_fye", "seq")
    return rows.groupBy("ticker").agg(best.alias("a"), tag.alias("t")).select("ticker", F.coalesce("a", F.nullif("t", F.lit("")), F.lit("12-31")).alias("fye"))


def draft_companies(rows: DataFrame, ends: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Company dimension of the tickers in rows: name and number of the last row; edits of an existing dimension are kept, its other tickers go."""
    named = rows.groupBy("ticker").agg(F.max_by("company", "seq").alias("name"), F.max_by("cik", "seq").alias("cik")).join(ends, "ticker")
    if existing is None:
        none = F.lit(None).cast("string")
        return named.select("ticker", "name", "cik", none.alias("sector"), none.alias("industry"), F.array().cast("array<string>").alias("aliases"), F.col("fye").alias("fiscal_year_end"))
    kept = existing.select("ticker", "sector", "industry", "aliases", F.nullif("fiscal_year_end", F.lit("")).alias("own"))
    return named.join(kept, "ticker", "left").select("ticker", "name", "cik", "sector", "industry", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("own", "fye").alias("fiscal_year_end"))


def coverage(rows: DataFrame, companies: DataFrame, excluded: dict[str, str] | None = None, tolerance: int = 10, per_quarter: float = 91.3) -> DataFrame:
    """The coverage table; tolerance and per_quarter are the days that fiscal_year and fiscal_quarter go by. A filing without a period end has status `missing_period`; excluded maps files to reasons."""
    d = rows.join(companies.select("ticker", "sector", "industry", "fiscal_year_end"), "ticker")
    fy, fq = P.fiscal_year(F.col("period_end"), F.col("fiscal_year_end"), tolerance), P.fiscal_quarter(F.col("period_end"), F.col("fiscal_year_end"), F.col("form"), per_quarter, tolerance)
    d = d.withColumns({"fiscal_year": fy, "fiscal_quarter": fq})
    reason = F.lit(None).cast("string")
    if excluded:
        reason = F.try_element_at(F.create_map(*[F.lit(x) for kv in excluded.items() for x in kv]), F.col("file"))
    d = d.withColumns(
        {
            "fiscal_label": P.fiscal_label(F.col("fiscal_year"), F.col("fiscal_quarter"), F.col("xbrl_period")),
            "xbrl_mismatch": P.tag_mismatch(F.col("fiscal_year"), F.col("fiscal_quarter"), F.col("xbrl_period")),
            "status": F.coalesce(reason, F.when(F.col("period_end").isNull(), "missing_period"), F.lit("ok")),
            "sector": F.coalesce("sector", F.lit("")),
            "industry": F.coalesce("industry", F.lit("")),
        }
    )
    return d.select(*COLUMNS)


def ordered(cov: DataFrame) -> DataFrame:
    return cov.orderBy("ticker", "period_end", "form", "file")


def counts(cov: DataFrame, *by: str) -> DataFrame:
    """Number of filings by form, source, status or any columns."""
    return cov.groupBy(*by).agg(F.count("*").alias("n"))


def companies_by_industry(companies: DataFrame) -> DataFrame:
    """Sorted tickers of each (sector, industry)."""
    return companies.groupBy(F.coalesce(F.nullif("sector", F.lit("")), F.lit("(unfilled)")).alias("sector"), F.coalesce("industry", F.lit("")).alias("industry")).agg(F.array_join(F.array_sort(F.collect_list("ticker")), " ").alias("tickers"))


def duplicates(cov: DataFrame) -> DataFrame:
    """Periods that several filings claim."""
    return cov.groupBy("ticker", "form", "fiscal_year", "fiscal_quarter").agg(F.count("*").alias("n")).where("n > 1")


def mismatches(cov: DataFrame) -> DataFrame:
    return cov.where("xbrl_mismatch")


def relabelled(cov: DataFrame) -> DataFrame:
    """Filings whose own label names another year."""
    return cov.where(~F.col("fiscal_label").endswith(F.col("fiscal_year").cast("string")))


def fiscal_years(cov: DataFrame, since: int = 2022) -> DataFrame:
    return cov.where(F.col("fiscal_year") >= since).select("fiscal_year").distinct()


def grid(cov: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Per ticker and year a string of the quarters Q1 to Q3 that have a quarterly report, a dot for one without; without years, all of fiscal_years."""
    years = sorted(r.fiscal_year for r in fiscal_years(cov).collect()) if years is None else years
    q = cov.where(F.col("form") == "10-Q").groupBy("ticker").pivot("fiscal_year", years)
    cell = F.concat(*[F.coalesce(F.max(F.when(F.col("fiscal_quarter") == f"Q{k}", str(k))), F.lit(".")) for k in (1, 2, 3)])
    found = q.agg(cell)
    every = cov.select("ticker").distinct().join(found, "ticker", "left")
    return every.select("ticker", *[F.coalesce(F.col(f"`{y}`"), F.lit("...")).alias(f"fy{y}") for y in years])


def fully_covered(cov: DataFrame, years: tuple[int, ...] = (2023, 2024, 2025)) -> DataFrame:
    """Tickers with a quarterly report for Q1 to Q3 of every year: a relational division by a fixed list."""
    have = cov.where((F.col("form") == "10-Q") & F.col("fiscal_year").isin(*years) & F.col("fiscal_quarter").isin("Q1", "Q2", "Q3"))
    return have.groupBy("ticker").agg(F.countDistinct("fiscal_year", "fiscal_quarter").alias("n")).where(F.col("n") == 3 * len(years)).select("ticker")


def company_table(companies: DataFrame, cov: DataFrame) -> DataFrame:
    """(ticker, line): companies with coverage and their filings by fiscal year, in words."""
    years = cov.groupBy("ticker", "fiscal_year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("period_end", "fiscal_quarter"))), lambda x: x["fiscal_quarter"]), ",").alias("qs"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fiscal_year", "qs"))), lambda x: F.concat(F.lit("FY"), x["fiscal_year"], F.lit(": "), x["qs"])), "; ")
    by = years.groupBy("ticker").agg(text.alias("filings"))
    said = F.concat_ws(" | ", "ticker", "name", F.array_join("aliases", ", "), F.concat_ws(" / ", "sector", "industry"), F.concat(F.lit("FYE "), "fiscal_year_end"), "filings")
    return companies.join(by, "ticker").select("ticker", said.alias("line"))


def latest_wins(cov: DataFrame) -> DataFrame:
    """One filing per (ticker, form, fiscal year, quarter): the last filed."""
    w = Window.partitionBy("ticker", "form", "fiscal_year", "fiscal_quarter").orderBy(F.desc("filing_date"), F.desc("file"))
    return cov.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
