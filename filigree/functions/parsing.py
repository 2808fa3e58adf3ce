"""Header, period and fiscal-calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Cover-page and tag patterns (fixed values).
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
COVER = rf"(?i)for the (?:fiscal year|quarterly period|year) ended\s*({MONTHS})\s+(\d{{1,2}})\s*,\s*(\d{{4}})"
TAG = r"(20\d\d)(FY|Q[1-4])|(FY|Q[1-4])(20\d\d)|(FY|Q[1-4])--\d\d-\d\d"
RULE = "\n" + "=" * 10


def header_map(text: Column) -> Column:
    """Key/value pairs of the lines above the rule, split at their first ': '; a repeated key keeps its last value."""
    head = F.when(F.instr(text, RULE) > 0, F.substr(text, F.lit(1), F.instr(text, RULE) - 1)).otherwise(text)
    lines = F.filter(F.split(head, r"\r\n|\r|\n"), lambda x: F.instr(x, ": ") > 0)
    pair = F.transform(lines, lambda x, i: F.struct(F.trim(F.substr(x, F.lit(1), F.instr(x, ": ") - 1)).alias("k"), i.alias("i"), F.trim(F.substr(x, F.instr(x, ": ") + 2, F.length(x))).alias("v")))
    # in order of key and line, the last of a key is the one before another key; a lambda's variable is computed once
    last = F.transform(F.array(F.sort_array(pair)), lambda ps: F.filter(ps, lambda p, j: ~p["k"].eqNullSafe(F.get(ps, j + 1)["k"])))
    return F.map_from_entries(F.transform(F.get(last, F.lit(0)), lambda p: F.struct(p["k"], p["v"])))


def header_body(text: Column) -> Column:
    """What follows the line of the rule; empty without one."""
    rest = F.substr(text, F.instr(text, RULE) + len(RULE), F.length(text))
    return F.when((F.instr(text, RULE) > 0) & (F.instr(rest, "\n") > 0), F.substr(rest, F.instr(rest, "\n") + 1, F.length(rest))).otherwise("")


def period_end(meta: Column, body: Column) -> Column:
    """struct(date, src): header date, else a date in the file name of the URL, else on the cover page; src is `missing` and the date null without any. Impossible dates are passed over."""
    given = F.try_to_date(F.nullif(F.try_element_at(meta, F.lit("Report Period")), F.lit("")), "yyyy-MM-dd")
    name = F.element_at(F.split(F.coalesce(F.try_element_at(meta, F.lit("URL")), F.lit("")), "/"), -1)
    linked = F.try_to_date(F.nullif(F.regexp_extract(name, r"(20\d{6})", 1), F.lit("")), "yyyyMMdd")
    top = F.substr(body, F.lit(1), F.lit(200_000))
    cover = F.try_to_date(F.nullif(F.initcap(F.concat_ws(" ", *[F.regexp_extract(top, COVER, k) for k in (1, 2, 3)])), F.lit("  ")), "MMMM d yyyy")
    src = F.when(given.isNotNull(), "header").when(linked.isNotNull(), "url").when(cover.isNotNull(), "cover").otherwise("missing")
    return F.struct(F.coalesce(given, linked, cover).alias("date"), src.alias("src"))


def xbrl_period(body: Column) -> Column:
    """Fiscal tag in the first 400 characters as year and period (`2024Q3`, `FY`); null without one."""
    top = F.substr(body, F.lit(1), F.lit(400))
    part = lambda k: F.regexp_extract(top, TAG, k)
    return F.nullif(F.concat(part(1), part(4), part(2), part(3), part(5)), F.lit(""))


def form(filing_type: Column) -> Column:
    """First word."""
    return F.regexp_extract(filing_type, r"^\s*(\S+)", 1)


def fiscal_year_end(period: Column, fye: Column, tolerance: int = 10) -> Column:
    """First fiscal year end (month-day fye, Feb 29 as Feb 28 in common years) not over `tolerance` days before the period end."""
    month, day = F.substr(fye, F.lit(1), F.lit(2)).cast("int"), F.substr(fye, F.lit(4), F.lit(2)).cast("int")

    def on(k):
        first = F.make_date(F.year(period) + k, month, F.lit(1))
        return F.least(F.date_add(first, day - 1), F.last_day(first))

    floor = F.date_sub(period, tolerance)
    return F.when(on(-1) >= floor, on(-1)).when(on(0) >= floor, on(0)).otherwise(on(1))


def fiscal_year(period: Column, fye: Column, tolerance: int = 10) -> Column:
    """Calendar year in which the fiscal year of the period ends."""
    return F.year(fiscal_year_end(period, fye, tolerance))


def fiscal_quarter(period: Column, fye: Column, form_: Column, per_quarter: float = 91.3, tolerance: int = 10) -> Column:
    """FY for annual reports, else Q1 to Q4 by the days since the previous fiscal year end."""
    previous = F.add_months(fiscal_year_end(period, fye, tolerance), -12)
    q = F.least(F.greatest(F.round(F.datediff(period, previous) / per_quarter).cast("int"), F.lit(1)), F.lit(4))
    return F.when(form_ == "10-K", "FY").otherwise(F.concat(F.lit("Q"), q.cast("string")))


def fiscal_label(year: Column, quarter: Column, tag: Column) -> Column:
    """The company's own name of the period: the tag's year if the tag has one and ends with the quarter."""
    own = (F.length(tag) > 3) & tag.endswith(quarter)
    named = F.concat(F.lit("FY"), F.when(own, F.substr(tag, F.lit(1), F.lit(4))).otherwise(year.cast("string")))
    return F.when(quarter == "FY", named).otherwise(F.concat(quarter, F.lit(" "), named))


def tag_mismatch(year: Column, quarter: Column, tag: Column) -> Column:
    """Whether a tag is there and disagrees with the derived period."""
    x = F.coalesce(tag, F.lit(""))
    return (x != "") & ~(x.endswith(quarter) & ((F.length(x) <= 3) | x.startswith(year.cast("string"))))


def json_object(text: Column) -> Column:
    """From the first { to the last }; unchanged without them in this order."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), text)


def tokenize(text: Column) -> Column:
    """Lower-case search terms: letters and digits, joined by inner dots or apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:[.'][a-z0-9]+)*"), F.lit(0))
