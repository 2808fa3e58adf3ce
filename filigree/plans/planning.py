"""Retrieval plans: validation, a rule-based planner, year resolution and coverage gaps."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from filigree.settings import PERIODS, SECTIONS


@dataclass
class SubQuery:
    ticker: str
    query: str | None = None
    sections: list[str] = field(default_factory=list)
    fiscal_years: list[int] = field(default_factory=list)


@dataclass
class Plan:
    tickers: list[str]
    sub_queries: list[SubQuery]
    needs_comparison: bool = False
    unknown_companies: list[str] = field(default_factory=list)
    fiscal_years: list[int] = field(default_factory=list)
    last_n_years: int | None = None
    period_types: list[str] = field(default_factory=list)
    sections: list[str] = field(default_factory=list)


def _members(name: str, values, known) -> list:
    odd = [v for v in values if v not in known]
    if odd:
        raise ValueError(f"{name} not known: {odd}; known are {list(known)}")
    return values


def validate(raw: object, tickers: set[str]) -> Plan:
    """A checked and completed plan, or ValueError that says what is wrong."""
    if not isinstance(raw, dict):
        raise ValueError("a plan is a JSON object")
    for key, kind in {"tickers": list, "sub_queries": list, "needs_comparison": bool}.items():
        if not isinstance(raw.get(key), kind):
            raise ValueError(f"{key} must be a {kind.__name__}")
    several = lambda d, key: list(d.get(key) or [])
    named = _members("tickers", [str(t).upper() for t in raw["tickers"]], sorted(tickers))
    plan = Plan(
        tickers=named,
        sub_queries=[],
        needs_comparison=raw["needs_comparison"],
        unknown_companies=several(raw, "unknown_companies"),
        fiscal_years=[int(y) for y in several(raw, "fiscal_years")],
        last_n_years=int(raw["last_n_years"]) if raw.get("last_n_years") else None,
        period_types=_members("period_types", [str(p).upper() for p in several(raw, "period_types")], PERIODS),
        sections=_members("sections", several(raw, "sections"), SECTIONS),
    )
    for s in raw["sub_queries"]:
        if not isinstance(s, dict) or not s.get("query") or str(s.get("ticker", "")).upper() not in named:
            raise ValueError(f"a sub-query needs a text and one of the plan's tickers: {s}")
        plan.sub_queries.append(SubQuery(str(s["ticker"]).upper(), s["query"], _members("sections", several(s, "sections"), SECTIONS), [int(y) for y in several(s, "fiscal_years")]))
    asked = {s.ticker for s in plan.sub_queries}
    plan.sub_queries += [SubQuery(t) for t in named if t not in asked]
    return plan


class Generator(Protocol):
    def complete(self, prompt: str, system: str | None = None, json_mode: bool = False) -> str: ...


PLANNER = (
    "Plan a search over company reports. Reply with one JSON object with the keys tickers, unknown_companies, fiscal_years, "
    "last_n_years, period_types, sections, needs_comparison and sub_queries (ticker, query, sections, fiscal_years). "
    "Use only tickers of the table; name other companies in unknown_companies. Give fiscal_years only if the question names "
    "years, last_n_years for a span back from now. Sections: {sections}. Period types: {periods}.\n\n{table}"
)


def plan_question(question: str, tickers: set[str], table: str, model: Generator, tries: int = 2) -> Plan:
    """A plan from a model's reply; an invalid one is sent back once with what is wrong."""
    system = PLANNER.format(sections=SECTIONS, periods=PERIODS, table=table)
    wrong = ""
    for _ in range(tries):
        reply = model.complete(f"Question: {question}{wrong}", system=system, json_mode=True)
        try:
            return validate(json.loads(reply), tickers)
        except (ValueError, TypeError) as e:
            wrong = f"\n\nThe last plan was invalid: {e}. Correct it."
    raise ValueError(f"no valid plan after {tries} tries:{wrong}")


#: Words that point to sections (fixed values).
HINTS = {"risk": ["risk_factors"], "regulat": ["risk_factors", "business", "legal"], "legal": ["legal"], "litigation": ["legal"], "revenue": ["mdna", "financials"], "growth": ["mdna", "financials"], "outlook": ["mdna", "financials"], "margin": ["mdna", "financials"], "control": ["controls"]}


#: Endings of company names that questions leave out (fixed values).
LEGAL = r"(?i)[\s,]+(?:inc|corp|corporation|company|co|ltd|limited|plc|llc|group|holdings|sa|ag|nv)\.?$"


def spoken(name: str) -> str:
    """A company's name without its legal ending."""
    while (short := re.sub(LEGAL, "", name.strip())) != name:
        name = short
    return name


def rule_plan(question: str, companies: list[dict]) -> Plan:
    """The offline planner: companies by ticker, name, alias or industry; years, spans and sections by their words."""
    low = question.lower()
    has = lambda phrase: bool(phrase) and re.search(rf"(?<!\w){re.escape(phrase.lower())}(?!\w)", low) is not None
    named = [c["ticker"] for c in companies if re.search(rf"(?<!\w){re.escape(c['ticker'])}(?!\w)", question) or has(c["name"]) or has(spoken(c["name"])) or any(has(a) for a in c.get("aliases") or [])]
    if not named:
        named = [c["ticker"] for c in companies if has(c.get("industry") or "")]
    years = sorted({int(y) for y in re.findall(r"\b(20\d\d)\b", question)})
    span = re.search(r"last (\d+|one|two|three|four|five) years?", low)
    n = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}.get(span[1]) or int(span[1]) if span else 3 if "over time" in low else 1 if "recent" in low else None
    sections = list(dict.fromkeys(s for k, v in HINTS.items() if k in low for s in v))
    text = {c["ticker"]: f"{c['name']} {question}" for c in companies}
    return Plan(named, [SubQuery(t, text[t]) for t in named], len(named) > 1 or len(years) > 1 or bool(span), [], years, None if years else n, ["FY"] if sections[:1] == ["risk_factors"] or sections == ["legal"] else [], sections)


def plan_rows(spark, plans: list[Plan]) -> DataFrame:
    """Plans as rows (plan, sq, ticker, query, sections, own_years, plan_years, last_n_years, periods), one per sub-query; each has an id of its own, so several for one ticker stay apart."""
    rows = [(p, 1000 * p + k, s.ticker, s.query, s.sections or plan.sections, s.fiscal_years, plan.fiscal_years, plan.last_n_years, plan.period_types) for p, plan in enumerate(plans) for k, s in enumerate(plan.sub_queries)]
    return spark.createDataFrame(rows, "plan int, sq int, ticker string, query string, sections array<string>, own_years array<int>, plan_years array<int>, last_n_years int, periods array<string>")


def resolve_years(subq: DataFrame, cov: DataFrame) -> DataFrame:
    """subq with `fiscal_years`: its own, else the plan's, else those of filings within the last N years of the company's latest, else the year of the latest filing of the asked types (of any type if there is none)."""
    latest = cov.groupBy("ticker").agg(F.max("period_end").alias("latest"))
    both = subq.select("sq", "ticker", "periods", "last_n_years").join(cov.select("ticker", "fiscal_year", "fiscal_quarter", "period_end"), "ticker").join(latest, "ticker")
    typed = (F.size("periods") == 0) | F.array_contains("periods", F.col("fiscal_quarter"))
    late = F.col("period_end") > F.add_months("latest", -12 * F.col("last_n_years"))
    key = F.struct("period_end", "fiscal_year")
    by = both.groupBy("sq").agg(
        F.array_sort(F.collect_set(F.when(late, F.col("fiscal_year")))).alias("span"),
        F.coalesce(F.max_by("fiscal_year", F.when(typed, key)), F.max_by("fiscal_year", key)).alias("last"),
    )
    d = subq.join(by, "sq", "left")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    years = F.coalesce(some("own_years"), some("plan_years"), some("span"), F.when(F.col("last").isNotNull(), F.array("last")), F.array().cast("array<int>"))
    return d.withColumn("fiscal_years", years).drop("span", "last")


def period_words(periods: Column) -> Column:
    """The kinds of report that period types stand for."""
    said = F.array_join(F.transform(periods, lambda p: F.when(p == "FY", "10-K").otherwise(F.concat(p, F.lit(" 10-Q")))), "/")
    return F.when(F.size(periods) > 0, said).otherwise("filing")


def coverage_gaps(subq: DataFrame, cov: DataFrame) -> DataFrame:
    """(sq, ticker, fiscal_year, gap): asked years without a filing of the asked types."""
    asked = subq.select("sq", "ticker", "periods", F.explode("fiscal_years").alias("fiscal_year"))
    a, c = asked.alias("a"), cov.alias("c")
    on = (F.col("a.ticker") == F.col("c.ticker")) & (F.col("a.fiscal_year") == F.col("c.fiscal_year")) & ((F.size("a.periods") == 0) | F.array_contains("a.periods", F.col("c.fiscal_quarter")))
    missing = a.join(c, on, "left_anti")
    return missing.select("sq", "ticker", "fiscal_year", F.concat("ticker", F.lit(": no "), period_words(F.col("periods")), F.lit(" for FY"), "fiscal_year", F.lit(" in the corpus")).alias("gap"))


def unknown_gaps(companies: DataFrame) -> DataFrame:
    """Gaps of companies (name) that the corpus lacks."""
    return companies.select(F.concat("name", F.lit(": not in the corpus")).alias("gap"))


def search_years(subq: DataFrame, cov: DataFrame) -> DataFrame:
    """Sub-queries by year of search: years with any filing of the ticker, one row each; asked years that all lack filings give no row; no asked year gives one row with a null year."""
    asked = subq.withColumn("fiscal_year", F.explode_outer("fiscal_years"))
    have = cov.select("ticker", "fiscal_year").distinct()
    dated = asked.where("fiscal_year is not null").join(have, ["ticker", "fiscal_year"], "left_semi")
    return dated.unionByName(asked.where("fiscal_year is null"))


def empty_gaps(subq: DataFrame, hits: DataFrame) -> DataFrame:
    """Gaps of sub-queries that found nothing."""
    return subq.join(hits.select("sq"), "sq", "left_anti").select("sq", "ticker", F.concat("ticker", F.lit(": no matching chunks")).alias("gap"))


def relaxation_notes(subq: DataFrame, hits: DataFrame) -> DataFrame:
    """(sq, fiscal_year, note) where a search had to drop filters that were asked for."""
    tiers = hits.select("sq", "fiscal_year", "tier").distinct().where("tier > 0").join(subq.select("sq", "ticker", "sections", "periods"), "sq")
    tiers = tiers.where((F.size("sections") > 0) | (F.size("periods") > 0))
    periods = F.when((F.col("tier") == 1) & (F.size("periods") > 0), F.array_join("periods", ",")).otherwise("any")
    return tiers.select("sq", "fiscal_year", F.concat_ws(" ", "ticker", F.concat(F.coalesce(F.col("fiscal_year").cast("string"), F.lit("")), F.lit(": relaxed filters to sections=any, periods="), periods)).alias("note"))
