"""Headers, periods, cleaning, sections and chunks on small filings."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from filigree.functions import cleaning, parsing
from filigree.operators import chunks, coverage, sections
from filigree.settings import Settings


def one(spark, expr, *values, names=("a", "b", "c")):
    types = {str: "string", dt.date: "date", int: "int"}
    schema = ", ".join(f"{n} {types.get(type(v), 'string')}" for n, v in zip(names, values))
    return spark.createDataFrame([values], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "day,fye,form,want",
    [
        ("2024-06-29", "09-27", "10-Q", (2024, "Q3")),
        ("2024-04-28", "01-26", "10-Q", (2025, "Q1")),
        ("2024-01-28", "01-26", "10-K", (2024, "FY")),
        ("2022-04-01", "12-31", "10-Q", (2022, "Q1")),
        ("2023-03-01", "02-29", "10-K", (2023, "FY")),
        ("2024-12-31", "12-31", "10-Q", (2024, "Q4")),
    ],
)
def test_fiscal_periods(spark, day, fye, form, want):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    x = F.struct(parsing.fiscal_year(a, b), parsing.fiscal_quarter(a, b, c))
    assert tuple(one(spark, x, dt.date.fromisoformat(day), fye, form)) == want


def test_header(spark):
    text = "Ticker: OLD\nNote: a: b\nno pair\nTicker:  NEW \n" + "=" * 30 + "\nbody\nline"
    x = F.struct(parsing.header_map(F.col("a")).alias("m"), parsing.header_body(F.col("a")).alias("b"))
    got = one(spark, x, text)
    assert got.m == {"Ticker": "NEW", "Note": "a: b"} and got.b == "body\nline"
    bare = one(spark, x, "Key: v\nno rule")
    assert bare.m == {"Key": "v"} and bare.b == ""
    assert one(spark, x, "A: b\n" + "=" * 12).b == ""


def test_period_sources(spark):
    rows = [
        ({"Report Period": "2024-03-30", "URL": "x/a-20230101.htm"}, "", dt.date(2024, 3, 30), "header"),
        ({"URL": "http://h/20200101/a-20251231.htm"}, "", dt.date(2025, 12, 31), "url"),
        ({"URL": "http://h/20200101/a.htm"}, "For the quarterly period ended  June 5, 2024", dt.date(2024, 6, 5), "cover"),
        ({}, "FOR THE FISCAL YEAR ENDED DECEMBER 31 , 2022", dt.date(2022, 12, 31), "cover"),
        ({"URL": "x/20249999.htm"}, "nothing", None, "missing"),
    ]
    df = spark.createDataFrame([(k, m, b) for k, (m, b, _, _) in enumerate(rows)], "k int, m map<string,string>, b string")
    got = df.select("k", parsing.period_end(F.col("m"), F.col("b")).alias("p")).orderBy("k").collect()
    assert [(r.p.date, r.p.src) for r in got] == [(d, s) for _, _, d, s in rows]


def test_tags_and_labels(spark):
    tag = lambda s: one(spark, parsing.xbrl_period(F.col("a")), s)
    assert [tag(s) for s in ("x 2024Q3 y", "FY2023", "Q2--09-28", "none", "x" * 400 + "2024Q3")] == ["2024Q3", "2023FY", "Q2", None, None]
    label = parsing.fiscal_label(F.col("a"), F.col("b"), F.col("c"))
    assert one(spark, label, 2025, "FY", "2024FY") == "FY2024" and one(spark, label, 2025, "Q1", "FY") == "Q1 FY2025"
    bad = parsing.tag_mismatch(F.col("a"), F.col("b"), F.col("c"))
    assert [one(spark, bad, 2025, "Q1", t) for t in ("", "Q1", "2025Q1", "2024Q1", "2025Q2")] == [False, False, False, True, True]


def test_missing_header_keys_stop_the_job(spark):
    raw = spark.createDataFrame([("f", 0, "Ticker: A\n" + "=" * 10 + "\nb")], "file string, seq int, text string")
    with pytest.raises(Exception, match="Company"):
        coverage.filings(raw).collect()


def test_coverage_table(spark):
    head = "Ticker: {}\nCompany: {} Inc\nCIK: 7\nFiling Type: {} x\nFiling Date: {}\nReport Period: {}\n" + "=" * 12 + "\n{}"
    files = [("k", "AA", "10-K", "2024-11-01", "2024-09-28", ""), ("q", "AA", "10-Q", "2024-02-02", "2023-12-30", "2024Q1"), ("b", "BB", "10-Q", "2024-05-02", "2024-03-31", "x Q1--06-30"), ("old", "AA", "10-K", "2015-01-01", "2014-09-27", "")]
    raw = spark.createDataFrame([(f, n, head.format(t, t, form, filed, end, body)) for n, (f, t, form, filed, end, body) in enumerate(files)], "file string, seq int, text string")
    rows = coverage.filings(raw)
    ends = coverage.fiscal_year_ends(rows)
    assert {r.ticker: r.fye for r in ends.collect()} == {"AA": "09-28", "BB": "06-30"}
    had = spark.createDataFrame([("AA", "Tech", "Chips", ["Alpha"], ""), ("ZZ", "Gone", "", [], "")], "ticker string, sector string, industry string, aliases array<string>, fiscal_year_end string")
    comp = coverage.draft_companies(rows, ends, had)
    assert {r.ticker: (r.sector, r.aliases, r.fiscal_year_end) for r in comp.collect()} == {"AA": ("Tech", ["Alpha"], "09-28"), "BB": (None, [], "06-30")}
    cov = {r.file: r for r in coverage.coverage(rows, comp, {"old": "excluded: old"}).collect()}
    assert [(cov[f].fiscal_label, cov[f].xbrl_mismatch, cov[f].status) for f in ("k", "q", "b", "old")] == [("FY2024", False, "ok"), ("Q1 FY2024", False, "ok"), ("Q3 FY2024", True, "ok"), ("FY2014", False, "excluded: old")]


def test_page_furniture(spark):
    run = "NOTES TO CONSOLIDATED FINANCIAL STATEMENTS"
    text = f"xbrl junk UNITED STATES SECURITIES AND EXCHANGE COMMISSION\nITEM 7. MANAGEMENT’S DISCUSSION AND ANALYSIS OF FINANCIAL CONDITION AND RESULTS OF OPERATIONS first\n12\n{run} one\nACME INC. {run} (Continued) two\xa053Table of Contents three Acme Corp. | 2024 Form 10-K | 20 four\nAcme Corporation and Subsidiaries Notes to Consolidated Financial Statements (Continued) five"
    got = one(spark, cleaning.clean(F.col("a")), text)
    assert got.startswith("UNITED STATES") and got.count(run) == 1 and "ITEM 7. MANAGEMENT’S" in got
    for gone in ("Table of Contents", "Form 10-K", "Continued", "\n12\n"):
        assert gone not in got
    assert "Acme Corporation" not in got and all(w in got for w in "first one two three four five".split())


def test_table_rows(spark):
    rows = {"Revenue | $ | 1,200 | | |": "Revenue | $1,200", "Margin | 45.2 | % |": "Margin | 45.2%", "Loss | ( | 31 | ) |": "Loss | (31)", "a   b\t\tc": "a b c", "| |": "", "x | $ | ( | 5 | )%": "x | $(5)%"}
    for raw, want in rows.items():
        assert one(spark, cleaning.normalize_tables(F.col("a")), raw) == want
    assert one(spark, cleaning.normalize_tables(F.col("a")), "\n\n a \n\nb\n") == "a\nb"


WORDS = "Some plain words that fill a paragraph of this report. " * 40
ANNUAL = f"""Annual report
Item 1. Business | 3
Item 1A. Risk Factors | 9
Item 7. Management | 20
PART I
Item 1. Business
{WORDS}see the "Item 1A. Risk Factors" part, and Part II, Item 7 below.{WORDS}end of information.Item 1A. Risk Factors
{WORDS}
Item 7. Management’s Discussion and Analysis
{WORDS}
FINANCIAL SECTION
{WORDS}
REPORT OF INDEPENDENT REGISTERED PUBLIC ACCOUNTING FIRM
{WORDS}"""
QUARTER = f"""PART I
Item 1. Financial Statements
{WORDS}
Item 2. Management’s Discussion and Analysis
{WORDS}
PART II
Item 1. Legal Proceedings
{WORDS}
Item 1A. Risk Factors
{WORDS}
"""


def test_sections(spark):
    docs = spark.createDataFrame([("a", ANNUAL, "10-K"), ("q", QUARTER, "10-Q"), ("n", None, "10-K"), ("e", " \n", "10-K"), ("p", "No headings at all.", "10-K")], "file string, text string, form string")
    got = sections.split_sections(docs).orderBy("file", "seq").collect()
    names = lambda f: [r.label for r in got if r.file == f]
    assert names("a") == ["other", "business", "risk_factors", "mdna", "financials"]
    assert names("q") == ["other", "financials", "mdna", "legal", "risk_factors"]
    assert names("n") == names("e") == [] and names("p") == ["other"]
    assert "".join(r.text for r in got if r.file == "q") == QUARTER
    assert "see the" in next(r.text for r in got if r.file == "a" and r.label == "business")


def test_neighbours_of_one_label_are_joined(spark):
    text = "Front.\nItem 9B. Other\nx\nItem 5. Market\ny"
    docs = spark.createDataFrame([("a", text, "10-K")], "file string, text string, form string")
    assert [h.label for h in sections.find_headings(docs).first().heads] == ["other", "other"]
    assert [r.label for r in sections.split_sections(docs).collect()] == ["other"]


def test_units():
    assert chunks.units("a\nb | c\nd | e\n\nf") == [("a", False), ("b | c\nd | e", True), ("", False), ("f", False)]


class Numbers:
    """Counts what a piece says it weighs."""

    def count(self, text):
        return sum(int(w) for w in text.split())

    def windows(self, text, limit):
        return [text]


def test_chunks_lose_nothing_and_keep_their_size():
    text = "751\n61"
    assert chunks.chunk_text(text, 800, 100, Numbers(), compat=True) == ["751"]  # the known loss, on request
    assert chunks.chunk_text(text, 800, 100, Numbers()) == ["751", "61"]
    got = chunks.chunk_text("700\n100\n801\n50", 800, 150, Numbers())
    assert got == ["700", "100", "801", "50"]


@pytest.mark.parametrize("seed", range(6))
def test_chunk_properties(seed):
    r = random.Random(seed)
    lines = [" | ".join(["cell"] * 4) if r.random() < 0.3 else " ".join(r.choice(["word", "U.S.", "done.", "No. 5", "x.Next"]) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    size, overlap = 120, 20
    got = chunks.chunk_text("\n".join(lines), size, overlap)
    count = chunks.RegexCounter().count
    assert all(c and count(c) <= size for c in got)
    bare = lambda t: "".join(t.split())
    text, reached = bare("".join(lines)), 0
    for c in got:  # chunks are stretches of the text, in order, without a hole between them
        at = text.find(bare(c), max(0, reached - len(bare(c))))
        assert 0 <= at <= reached
        reached = at + len(bare(c))
    assert reached == len(text)


def test_long_text_with_a_table():
    text = " ".join(f"The U.S. sentence number {k} ends here." for k in range(400)) + "\n" + "\n".join(f"row {k} | {k} | {k}" for k in range(10))
    got = chunks.chunk_text(text, 300, 40)
    assert len(got) > 3 and any(all(f"row {k} |" in c for k in range(10)) for c in got)
    assert got[1].split(".")[0] in got[0] or got[1][:20] in got[0]


def test_filing_chunks(spark):
    sec = spark.createDataFrame([("f", 0, "mdna", "w " * 100), ("f", 1, "legal", "too short"), ("f", 2, "mdna", "v " * 50), ("g", 0, "mdna", "u " * 60)], "file string, seq int, label string, text string")
    fil = spark.createDataFrame([(f, "AA", "10-K", 2024, "FY", "FY2024", dt.date(2024, 12, 31), d) for f, d in (("f", dt.date(2025, 2, 2)), ("g", dt.date(2025, 1, 1)))], "file string, ticker string, form string, fiscal_year int, fiscal_quarter string, fiscal_label string, period_end date, filing_date date")
    comp = spark.createDataFrame([("AA", "Alpha", "S", "I")], "ticker string, name string, sector string, industry string")
    got = sorted(r.id for r in chunks.filing_chunks(sec, fil, comp, Settings(chunk_tokens=80, chunk_overlap=10)).collect())
    assert got == [f"AA-10-K-2024-FY-mdna-{k}" for k in range(4)]  # 40, 40 and 30 words, and the 50 of the third section
    row = chunks.filing_chunks(sec, fil, comp).where("chunk = 0").first()
    assert row.embed_text.startswith("[AA Alpha | 10-K | FY2024 | mdna]\n") and len(row.hash) == 12


def test_settings():
    s = Settings.from_env({"TOP_K": "7", "RERANK": "1", "FALLBACK_MODELS": "a,b", "LLM_TIMEOUT": "2.5"})
    assert (s.top_k, s.rerank, s.fallback_models, s.llm_timeout, s.rrf_k) == (7, True, ("a", "b"), 2.5, 60)
