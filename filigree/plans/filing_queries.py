"""Registered queries over made-up filings: texts of stated shapes, whose results are known from how they are built."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from filigree.functions import cleaning
from filigree.functions.models import ExtractiveGenerator
from filigree.operators import answering, chunks as chunk_ops, citations, coverage as cov_ops, evaluation, search, sections
from filigree.plans import standin
from filigree.plans.queries import _FILINGS, _OLD, _RETRIEVED, _SEARCH, WITH, _filed, _retrieved, _suppliers, _versions, long, query
from filigree.plans.standin import tables
from filigree.settings import Settings
from filigree.sources import files
from filigree.sources.scratch import Scratch
from filigree.sources.store import IndexStore

# ------------------------------------------------------------------ sections

_LINE = "Plain words fill this part of the report. "
#: Filings by shape: form, and the parts that they are made of with the label each must get. {n} stands for n lines of filler, {id} for the document's number.
SHAPES = [
    # contents rows, one wrapped, one without a page
    ("10-K", [("other", "Annual report\nItem 1. Business | 3\nItem 1A. |\nRisk Factors | 9\nItem 7. Discussion | N/A\n"), ("business", "Item 1. Business\n{60}No {id}.\n"), ("risk_factors", "Item 1A. Risk Factors\n{60}\n"), ("mdna", "Item 7. Discussion of results\n{60}\n"), ("financials", "Item 8. Financial Statements\n{60}")]),
    # mentions inside sentences; headings glued to a page number and to a part's title
    ("10-K", [("other", "Front page.\n"), ("business", 'Item 1. Business\n{40}as told in the Item 7. Discussion part, under "Item 8. Statements" and (Item 3. Proceedings). {40}No {id} 17'), ("other", "Item 2. Properties\n{40}\nPART II"), ("mdna", "Item 7. Discussion\n{60}")]),
    # statements behind item 16
    ("10-K", [("other", "Front page.\n"), ("business", "Item 1. Business\n{60}No {id}.\n"), ("other", "Item 16. Form Summary\nNone.\n{40}\n"), ("financials", "INDEX TO CONSOLIDATED FINANCIAL STATEMENTS\n{60}")]),
    # a financial section behind the items
    ("10-K", [("other", "Front page.\n"), ("business", "Item 1. Business\n{60}No {id}.\n"), ("other", "Item 16. Form Summary\n{40}\n"), ("mdna", "FINANCIAL SECTION\n{60}\n"), ("financials", "REPORT OF INDEPENDENT REGISTERED PUBLIC ACCOUNTING FIRM\n{60}")]),
    # titles alone, in three ways to write them
    ("10-K", [("other", "{40}No {id}.\n"), ("risk_factors", "Risk Factors\n{60}\n"), ("mdna", "MANAGEMENT’S DISCUSSION AND ANALYSIS\n{60}\n"), ("market_risk", "Quantitative and qualitative disclosures about market risk\n{60}\n"), ("legal", "Legal Proceedings\n{60}\n"), ("controls", "CONTROLS AND PROCEDURES\n{60}\n"), ("financials", "Consolidated Statements of Income\n{60}")]),
    # an item that only refers to a section elsewhere
    ("10-K", [("other", "Front page.\n"), ("business", "Item 1. Business\n{60}No {id}.\n"), ("mdna", "Item 7. Discussion\nSee the annual report.\n"), ("financials", "Item 8. Statements\n{60}\n"), ("mdna", "Management’s Discussion and Analysis\n{60}")]),
    # two parts that number anew
    ("10-Q", [("other", "Front page.\n"), ("financials", "Item 1. Financial Statements\n{60}\n"), ("mdna", "Item 2. Management’s Discussion\n{60}\n"), ("controls", "Item 4. Controls\n{20}\n"), ("legal", "Item 1. Legal Proceedings\n{20}\n"), ("risk_factors", "Item 1A. Risk Factors\n{20}\n"), ("other", "Item 6. Exhibits\n{20}No {id}.")]),
    # items out of order, told by their titles
    ("10-Q", [("other", "Front page.\n"), ("mdna", "Item 2. Management’s Discussion\n{60}\n"), ("financials", "Item 1. Financial Statements\n{60}No {id}.")]),
    # a discussion without a heading
    ("10-Q", [("mdna", "{100}No {id}.\n"), ("financials", "Item 1. Financial Statements\n{60}")]),
]


def _filled(template: str, number, text, repeat, lit, concat):
    """A part's text as an expression of either engine."""
    out, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            out.append(lit(head))
        name, _, rest = tail.partition("}") if brace else ("", "", "")
        if name == "id":
            out.append(text(number))
        elif name:
            out.append(repeat(lit(_LINE), int(name)))
    return concat(out)


def _sql(template: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return _filled(template, "doc_id", lambda c: f"cast({c} as varchar)", lambda x, n: f"repeat({x}, {n})", quoted, " || ".join)


def _spark(template: str) -> F.Column:
    return _filled(template, "doc_id", lambda c: F.col(c).cast("string"), lambda x, n: F.repeat(x, F.lit(n)), F.lit, lambda xs: F.concat(*xs))


_SHAPED = " union all ".join(
    f"select doc_id, {seq} as seq, '{label}' as label, md5({_sql(part)}) as h from documents where doc_id % {len(SHAPES)} = {k}" for k, (_, parts) in enumerate(SHAPES) for seq, (label, part) in enumerate(parts)
)


@query(_SHAPED)
def filing_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a filing of one of SHAPES; its sections must be the parts it is made of."""
    (d,) = tables(spark, sf_dir, "documents")
    text = form = None
    for k, (kind, parts) in enumerate(SHAPES):
        here, whole = F.col("doc_id") % len(SHAPES) == k, F.concat(*[_spark(p) for _, p in parts])
        text = F.when(here, whole) if text is None else text.when(here, whole)
        form = F.when(here, kind) if form is None else form.when(here, kind)
    out = sections.split_sections(d.select("doc_id", text.alias("text"), form.alias("form")), key="doc_id")
    return out.select("doc_id", "seq", "label", F.md5("text").alias("h"))


# ------------------------------------------------------------------ cleaning

_NOTES, _TALK = "NOTES TO CONSOLIDATED FINANCIAL STATEMENTS", "MANAGEMENT’S DISCUSSION AND ANALYSIS OF FINANCIAL CONDITION AND RESULTS OF OPERATIONS"


@query(f"""select doc_id, '{_NOTES} a' || doc_id || chr(10) || '  b' || chr(10) || 'ITEM 7. {_TALK} c' || chr(10) || ' d' || chr(10) || 'Item 7. {_TALK} e' as t from documents""")
def running_headers(spark, sf_dir):
    """A header's first place and item titles stay, its repeats do not."""
    (d,) = tables(spark, sf_dir, "documents")
    raw = F.concat(F.lit(f"{_NOTES} a"), "doc_id", F.lit(f"\nACME CORP. {_NOTES} (Continued) b\nITEM 7. {_TALK} c\n{_TALK} d\nItem 7. {_TALK} e"))
    return d.select("doc_id", cleaning.strip_running(raw).alias("t"))


@query(r"""select doc_id, md5(regexp_replace(text || ' Acme Corp and Subsidiaries Notes to Condensed Consolidated Financial Statements (Continued) (Unaudited) end',
 '(?:[A-Z][A-Za-z.,&’'' -]{2,60}?(?:and|AND) (?:Subsidiaries|SUBSIDIARIES)\s*)?(?i:notes to (?:the )?(?:condensed )?consolidated financial statements|management[’'']s discussion and analysis(?: of financial condition and results of operations)?)\s*\((?i:continued)\)(?:\s*\((?i:unaudited)\))?', ' ', 'g')) as h from documents""")
def continued_strip(spark, sf_dir):
    (d,) = tables(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(cleaning.drop_continued(F.concat("text", F.lit(" Acme Corp and Subsidiaries Notes to Condensed Consolidated Financial Statements (Continued) (Unaudited) end")))).alias("h"))


@query(f"""select doc_id, 'UNITED STATES SECURITIES AND EXCHANGE COMMISSION' || chr(10) || 'ITEM 7. {_TALK} one' || doc_id || chr(10) || '{_NOTES} two' || chr(10) || ' three' || chr(10) || ' four   five   six' as t from documents""")
def clean_text(spark, sf_dir):
    """All steps on one page: preamble, spaces, page link, footer, continued and running headers, page number."""
    (d,) = tables(spark, sf_dir, "documents")
    head = F.lit(f"tags here UNITED STATES SECURITIES AND EXCHANGE COMMISSION\nITEM 7. {_TALK} one")
    rest = F.lit(f"\n 12 \n{_NOTES} two\n{_NOTES} three 53Table of Contents four Acme Corp. | 2024 Form 10-K | 20 five​ Acme Corporation and Subsidiaries Notes to Consolidated Financial Statements (Continued) six")
    return d.select("doc_id", cleaning.clean(F.concat(head, "doc_id", rest)).alias("t"))


# ------------------------------------------------------------------ chunks


@query("""with d as (select doc_id, 20 + doc_id % 30 as n from documents),
 k as (select doc_id, n, unnest(range(case when n <= 10 then 1 else cast(ceil((n - 10) / 8.0) as bigint) + 1 end)) as part from d),
 l as (select doc_id, part, unnest(range(8 * part, least(8 * part + 10, n))) as line from k)
 select doc_id, part, string_agg('w' || line || ' x ' || doc_id, chr(10) order by line) as text from l group by doc_id, part""")
def chunk_lines(spark, sf_dir):
    """Lines of three tokens (four with their separator), ten to a chunk, two of them carried."""
    (d,) = tables(spark, sf_dir, "documents")
    lines = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(19) + F.col("doc_id") % 30), lambda i: F.concat(F.lit("w"), i, F.lit(" x "), "doc_id"))
    out = d.select("doc_id", F.posexplode(chunk_ops.chunker(40, 8)(F.array_join(lines, "\n"))).alias("part", "text"))
    return out.select("doc_id", long("part").alias("part"), "text")


@query("""with d as (select doc_id, unnest(range(12 + doc_id % 5)) as i from documents)
 select doc_id, i // 2 as part, string_agg('The U.S. sale number ' || i || ' of ' || doc_id || ' ended.', ' ' order by i) as text from d group by doc_id, i // 2""")
def chunk_sentences(spark, sf_dir):
    """One long line of sentences with an abbreviation inside, two to a chunk."""
    (d,) = tables(spark, sf_dir, "documents")
    said = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(11) + F.col("doc_id") % 5), lambda i: F.concat(F.lit("The U.S. sale number "), i, F.lit(" of "), "doc_id", F.lit(" ended.")))
    out = d.select("doc_id", F.posexplode(chunk_ops.chunker(26, 0)(F.array_join(said, " "))).alias("part", "text"))
    return out.select("doc_id", long("part").alias("part"), "text")


@query("""with d as (select doc_id, unnest([0, 1, 2, 3]) as n from documents)
 select 'SR' || chr(65 + cast(doc_id % 20 as int)) || '-10-K-' || (1000 + doc_id // 20) || '-FY-mdna-' || n as id, ([40, 40, 30, 50])[n + 1] as words, doc_id as file from d""")
def filing_chunk_ids(spark, sf_dir):
    """Chunks of three sections per filing: numbered by label over sections, stubs dropped."""
    (d,) = tables(spark, sf_dir, "documents")
    part = lambda n, label, text: F.struct(F.lit(n).alias("seq"), F.lit(label).alias("label"), F.lit(text).alias("text"))
    parts = d.select(F.col("doc_id").alias("file"), F.explode(F.array(part(0, "mdna", "w " * 100), part(1, "legal", "too short"), part(2, "mdna", "v " * 50))).alias("p")).select("file", "p.*")
    ticker = F.concat(F.lit("SR"), F.char(65 + (F.col("doc_id") % 20).cast("int")))
    filed = d.select(F.col("doc_id").alias("file"), ticker.alias("ticker"), F.lit("10-K").alias("form"), F.expr("cast(1000 + doc_id div 20 as int)").alias("fiscal_year"), F.lit("FY").alias("fiscal_quarter"), F.lit("FY").alias("fiscal_label"), F.current_date().alias("period_end"), F.current_date().alias("filing_date"))
    out = chunk_ops.filing_chunks(parts, filed, standin.companies(spark), Settings(chunk_tokens=80, chunk_overlap=10))
    return out.select("id", F.size(F.split(F.trim("text"), " ")).alias("words"), "file")


# ------------------------------------------------------------------ coverage, files, index

_COVERED = (
    _FILINGS
    + """, cov_ as (select cast(file as varchar) as file, ticker, form, fiscal_year, fiscal_quarter, period_end,
  (case when fiscal_quarter = 'FY' then '' else fiscal_quarter || ' ' end) || 'FY' || (case when length(tag) > 3 and suffix(tag, fiscal_quarter) then substr(tag, 1, 4) else cast(fiscal_year as varchar) end) as fiscal_label,
  tag <> '' and not (suffix(tag, fiscal_quarter) and (length(tag) <= 3 or prefix(tag, cast(fiscal_year as varchar)))) as xbrl_mismatch,
  case file when 1 then 'excluded: one' when 3 then 'excluded: three' else 'ok' end as status from fiscal)"""
)


def _covered(spark, sf_dir) -> DataFrame:
    d = _filed(spark, sf_dir).withColumns({"file": F.col("file").cast("string"), "xbrl_period": F.col("tag"), "period_end_src": F.lit("header"), "header_quarter": F.lit(""), "filing_date": F.col("period_end")})
    rows = d.select("file", "ticker", "form", "period_end", "period_end_src", "filing_date", "header_quarter", "xbrl_period")
    return cov_ops.coverage(rows, standin.companies(spark), {"1": "excluded: one", "3": "excluded: three"})


@query(_COVERED + " select file, ticker, fiscal_year, fiscal_label, xbrl_mismatch, status from cov_")
def coverage_csv(spark, sf_dir):
    """The coverage table, written as CSV and read back."""
    path = Scratch(spark, "coverage").path("csv")
    files.write_coverage(_covered(spark, sf_dir), path)
    return files.read_coverage(spark, path).select("file", "ticker", "fiscal_year", "fiscal_label", "xbrl_mismatch", "status")


@query(_COVERED + " select file from cov_ where xbrl_mismatch")
def mismatched_filings(spark, sf_dir):
    return cov_ops.mismatches(_covered(spark, sf_dir)).select("file")


@query(_COVERED + " select file, fiscal_label from cov_ where not suffix(fiscal_label, cast(fiscal_year as varchar))")
def relabelled_filings(spark, sf_dir):
    return cov_ops.relabelled(_covered(spark, sf_dir)).select("file", "fiscal_label")


@query(_COVERED + " select file from cov_ where status = 'ok' and file in ('1', '2', '3', '4', '5')")
def selected_filings(spark, sf_dir):
    return files.select_filings(_covered(spark, sf_dir), ["1", "2", "3", "4", "5"]).select("file")


@query(_COVERED + " select file, row_number() over (order by ticker, period_end, form, file) as place from cov_")
def coverage_order(spark, sf_dir):
    """Places in the coverage report's order, numbered from the sorted partitions: the only window has a row per partition."""
    d = cov_ops.ordered(_covered(spark, sf_dir)).select("file", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    d = Scratch(spark, "order").keep(d, "ordered")
    sizes = d.groupBy("p").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    before = sizes.select("p", "first", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return d.join(before, "p").select("file", (F.col("before") + F.col("i") - F.col("first") + 1).alias("place"))


@query("""select s_name as ticker, 'Company ' || s_suppkey as name, lpad(s_suppkey::varchar, 10, '0') as cik, 'Sector ' || s_nationkey as sector, 'Industry ' || (s_suppkey % 7) as industry,
 'Co "''' || s_suppkey || ',é' || s_nationkey as aliases, case s_suppkey % 3 when 0 then '06-30' when 1 then '12-31' end as fiscal_year_end from supplier""")
def company_json(spark, sf_dir):
    """A company dimension made of the suppliers, written as one JSON object and read back."""
    path = Scratch(spark, "companies").path("json")
    files.write_companies(_suppliers(spark, sf_dir), path)
    return files.read_companies(spark, path).withColumn("aliases", F.array_join("aliases", ","))


@query("select cast(row_number() over (order by item_id) - 1 as int) as seq, 'filing-' || item_id || '.txt' as file from benchmark")
def manifest_files(spark, sf_dir):
    """A manifest of as many files as there are items, read in its order."""
    (b,) = tables(spark, sf_dir, "benchmark")
    path = Scratch(spark, "manifest").path("json")
    names = F.transform(F.array_sort(F.collect_list("item_id")), lambda i: F.concat(F.lit("filing-"), i, F.lit(".txt")))
    b.agg(F.to_json(F.struct(names.alias("files"))).alias("value")).coalesce(1).write.text(path)
    return files.manifest(spark, path)


def _store(spark, sf_dir, rows: DataFrame) -> IndexStore:
    store = IndexStore(spark, Scratch(spark, "store").path("index"))
    store.write(rows)
    return store


def _indexed(rows: DataFrame, vector=None) -> DataFrame:
    none = F.lit(None).cast("string")
    out = rows.select("id", "text", F.col("text").alias("embed_text"), "ticker", none.alias("company"), none.alias("fiscal_label"), "section", "hash")
    return out if vector is None else out.withColumn("embedding", vector)


@query(_OLD + " select n.id, n.hash, n.hash is not distinct from o.hash as had_vector from new n left join old o using (id)")
def store_update(spark, sf_dir):
    """An index on disk, brought to new chunks: what changed has no vector yet, for no embedder is given."""
    old, new = _versions(spark, sf_dir)
    store = _store(spark, sf_dir, _indexed(old, F.array(F.lit(1.0).cast("float"))))
    store.update(_indexed(new))
    return store.read("chunks").select("id", "hash", F.col("embedding").isNotNull().alias("had_vector"))


@query(_SEARCH + " select term, count(*) as df, sum(tf) as n, min(dl) as least from post group by term")
def store_postings(spark, sf_dir):
    """Postings as the index on disk holds them, by term."""
    store = _store(spark, sf_dir, _indexed(standin.chunks(spark, sf_dir), F.lit(None).cast("array<float>")))
    return store.read("postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"), F.min("dl").alias("least"))


@query(WITH + " select id, text from chunks where doc_id % 50 = 0")
def store_get(spark, sf_dir):
    """Point reads of the index by id."""
    c = standin.chunks(spark, sf_dir)
    ids = [r.id for r in c.where("doc_id % 50 = 0").select("id").collect()]
    return _store(spark, sf_dir, _indexed(c, F.lit(None).cast("array<float>"))).get(ids).select("id", "text")


# ------------------------------------------------------------------ search, answers, evaluation


@query(WITH + " select id from chunks where ticker in ('SRA', 'SRB', 'SRC') and fiscal_year = 2023 and section in ('mdna', 'legal')")
def filter_predicate(spark, sf_dir):
    return standin.chunks(spark, sf_dir).where(search.predicate({"ticker": ["SRA", "SRB", "SRC"], "fiscal_year": 2023, "section": ("mdna", "legal")})).select("id")


@query("select item_id, case when item_id % 3 = 0 then text else 'Company ' || item_id || ' What changed?' end as query from benchmark")
def query_defaults(spark, sf_dir):
    """Sub-queries without text ask the question about their company; empty ones too."""
    (b,) = tables(spark, sf_dir, "benchmark")
    said = F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, "")
    return b.select("item_id", search.query_text(said, F.concat(F.lit("Company "), "item_id"), F.lit("What changed?")).alias("query"))


@query("select label, vec_id as id, row_number() over (partition by label order by cast(embedding[1] as double) desc, vec_id) as place from embeddings")
def rerank_order(spark, sf_dir):
    """Rows of each label in the order of another score."""
    (e,) = tables(spark, sf_dir, "embeddings")
    hits = e.select("label", F.col("vec_id").alias("id"), "embedding")
    return search.rerank(hits, F.col("embedding")[0].cast("double"), ["label"]).select("label", "id", "place")


@query(_RETRIEVED + """, n as (select sq, count(*) as n, string_agg(id, ' ' order by fiscal_year, place) as ids from kept group by sq)
 select s.sq, case when n.n is null then 0 else 1 end as calls, coalesce(n.n, 0) as cited, 0 as invalid from subq s left join n using (sq)""")
def answer_records(spark, sf_dir):
    """Answers of the offline writer to every sub-query: one call where something was found, every excerpt cited, nothing invented."""
    subq, c, hits = _retrieved(spark, sf_dir)
    rows = citations.labels(hits.join(subq.select("sq", "ticker"), "sq"), by=("sq",)).select("sq", "id", "label")
    rows = standin.with_texts(spark, sf_dir, rows.join(c.select("id", "doc_id", "hash", "ticker", "form", "fiscal_year", "section"), "id"))
    rows = rows.withColumn("text", F.translate("text", "\n[]", " ()")).select(F.col("sq").alias("aid"), "ticker", F.col("ticker").alias("company"), "id", "label", "form", F.concat(F.lit("FY"), "fiscal_year").alias("fiscal_label"), F.lit("2024-12-31").cast("date").alias("period_end"), "section", "text")
    rows = Scratch(spark, "excerpts").keep(rows, "rows")
    asked = subq.select(F.col("sq").alias("aid"), F.lit("What changed?").alias("question"), F.lit(False).alias("needs_comparison"))
    gaps = spark.createDataFrame([], "aid int, gap string")
    out = answering.answers(asked, rows, gaps, ExtractiveGenerator())
    return out.select(F.col("aid").alias("sq"), "calls", long(F.size("valid")).alias("cited"), F.size("invalid").alias("invalid"))


@query("""select type, id from (select *, row_number() over (partition by type order by id) as n from (select (['example', 'template', 'synthetic', 'unanswerable'])[(conv_id + turn) % 4 + 1] as type, lpad(cast(conv_id as varchar), 9, '0') || '-' || lpad(cast(turn as varchar), 4, '0') as id from conversations) where type in ('example', 'synthetic')) where n <= 3""")
def first_items(spark, sf_dir):
    """The first three items of two types, which is what the option asks for."""
    (c,) = tables(spark, sf_dir, "conversations")
    kind = F.element_at(F.array(*[F.lit(t) for t in evaluation.TYPES]), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    name = F.concat(F.lpad(F.col("conv_id").cast("string"), 9, "0"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    return evaluation.first_of_each(c.select(kind.alias("type"), name.alias("id")), 3, ["example", "synthetic"]).select("type", "id")
