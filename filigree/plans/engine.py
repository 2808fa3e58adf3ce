"""End to end: filings to an index, questions to hits, hits to checked answers, answers to scores."""

from __future__ import annotations

import time
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from filigree.functions import cleaning, models, parsing
from filigree.operators import answering, chunks, citations, coverage, evaluation, index, search, sections
from filigree.plans import planning
from filigree.runtime import ship
from filigree.settings import Settings
from filigree.sources import files
from filigree.sources.cache import TableCache
from filigree.sources.scratch import Scratch
from filigree.sources.store import IndexStore


@dataclass
class Retrieval:
    """What a search found: plans, sub-queries, hits with their chunks, gaps and notes, by question (aid)."""

    plans: list[planning.Plan]
    subqueries: DataFrame
    hits: DataFrame
    gaps: DataFrame
    notes: DataFrame


class Engine:
    """Tables under one folder: coverage, companies and the index. The company dimension is small and is read by planners on the driver."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = Settings(), embedder=None, generator=None, judge=None, planner=None, counter=None, reranker=None, replies: TableCache | None = None):
        ship(spark)
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings
        self.embedder = embedder or models.embedder(settings)
        self.generator = generator or models.generator(settings)
        self.judge = judge or models.judge(settings)
        self.planner, self.counter, self.replies = planner, counter, replies
        self.reranker = (reranker or models.OverlapReranker()) if settings.rerank else None
        self.store = IndexStore(spark, f"{self.folder}/index")

    def coverage(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/coverage")

    def companies(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/companies")

    def build(self, raw: DataFrame, existing: DataFrame | None = None, excluded: dict[str, str] | None = None) -> None:
        """Coverage and company dimension of raw filings (file, seq, text), as files.whole_texts gives them."""
        rows = coverage.filings(raw)
        comp = coverage.draft_companies(rows, coverage.fiscal_year_ends(rows), existing)
        comp.write.mode("overwrite").parquet(f"{self.folder}/companies")
        coverage.coverage(rows, self.companies(), excluded, self.settings.fiscal_tolerance_days, self.settings.days_per_quarter).write.mode("overwrite").parquet(f"{self.folder}/coverage")

    def chunked(self, raw: DataFrame, only: list[str] | None = None) -> DataFrame:
        """Chunks of the filings of status ok, of some files alone if given."""
        cov = files.select_filings(self.coverage(), only)
        texts = raw.join(cov.select("file", "form"), "file").select("file", "form", cleaning.clean(parsing.header_body(F.col("text"))).alias("text"))
        parts = sections.split_sections(texts)
        return chunks.filing_chunks(parts, cov.drop("sector", "industry"), self.companies(), self.settings, self.counter)

    def ingest(self, raw: DataFrame, only: list[str] | None = None, partial: bool = False) -> tuple[int, int]:
        """Bring the index to the filings of raw; returns how many chunks were embedded and deleted. If partial, filings that raw does not have keep their chunks."""
        with Scratch(self.spark, "ingest") as scratch:
            new = scratch.keep(self.chunked(raw, only), "chunks")
            held = scratch.keep(raw.select("file").distinct(), "files") if partial else None
            return self.store.update(new, self.embedder.column("document", self.settings.embed_batch), held)

    def plan(self, question: str) -> planning.Plan:
        """A plan by the planner model, or by rules without one."""
        return self.checked([question])[0]

    def checked(self, questions: list[str]) -> list[planning.Plan]:
        """Plans of all questions, or the first error."""
        made = self.plans(questions)
        for _, wrong, _ in made:
            if wrong:
                raise ValueError(wrong)
        return [p for p, _, _ in made]

    def plans(self, questions: list[str]) -> list[tuple[planning.Plan, str, float]]:
        """(plan, error, seconds) of each question; the companies are read once. A question that no plan can be made for gets an empty one."""
        comp = [r.asDict() for r in self.companies().collect()]
        table = ""
        if self.planner is not None:
            ok = self.coverage().where("status = 'ok'")
            table = "\n".join(r.line for r in coverage.company_table(self.companies(), ok).orderBy("ticker").collect())
        out = []
        for q in questions:
            began, wrong = time.time(), ""
            try:
                plan = planning.rule_plan(q, comp) if self.planner is None else planning.plan_question(q, {c["ticker"] for c in comp}, table, self.planner)
            except Exception as e:  # a model may fail on one question alone
                plan, wrong = planning.Plan([], []), models.said(e)
            out.append((plan, wrong, time.time() - began))
        return out

    def retrieve(self, questions: list[str], plans: list[planning.Plan] | None = None) -> Retrieval:
        """Hits of all questions in one plan."""
        s = self.settings
        plans = plans if plans is not None else self.checked(questions)
        cov = self.coverage().where("status = 'ok'")
        asked = self.spark.createDataFrame(list(enumerate(questions)), "plan int, question string")
        names = self.companies().select("ticker", "name")
        subq = planning.plan_rows(self.spark, plans).join(asked, "plan").join(names, "ticker", "left")
        subq = subq.withColumn("query", search.query_text(F.col("query"), F.col("name"), F.col("question"))).drop("question", "name")
        subq = planning.resolve_years(subq, cov)
        # written once: a query is embedded once, and all that follows rests on the same hits
        scratch = Scratch(self.spark, "retrieve")
        subq = scratch.keep(subq, "subqueries")
        years = scratch.keep(planning.search_years(subq, cov).withColumn("vector", self.embedder.column("query")(F.col("query"))), "asked")
        rows = self.store.read("chunks")
        hits = search.relaxed(years, rows, self.store.read("postings"), self.store.read("idf"), self.store.read("stats"), top=s.top_k, rrf_k=s.rrf_k, quota=s.per_ticker, reranker=self.reranker and self.reranker.column())
        hits = scratch.keep(hits, "hits")
        found = hits.drop("fiscal_year").join(rows.drop("embedding", "embed_text", "hash"), "id").join(subq.select("sq", F.col("plan").alias("aid")), "sq")
        by_sq = subq.select("sq", F.col("plan").alias("aid"))
        gaps = planning.coverage_gaps(subq, cov).select("sq", "gap").union(planning.empty_gaps(subq, hits).select("sq", "gap")).join(by_sq, "sq").select("aid", "gap")
        lost = [(k, c) for k, p in enumerate(plans) for c in p.unknown_companies]
        if lost:
            unknown = self.spark.createDataFrame(lost, "aid int, name string")
            gaps = gaps.union(unknown.select("aid", F.concat("name", F.lit(": not in the corpus"))))
        notes = planning.relaxation_notes(subq, hits).join(by_sq, "sq").select("aid", "note")
        return Retrieval(plans, subq, found, gaps, notes)

    def labelled(self, found: Retrieval) -> DataFrame:
        """Hits with labels by question and company, an excerpt once."""
        once = found.hits.groupBy("aid", "id").agg(F.min_by(F.struct(*[c for c in found.hits.columns if c not in ("aid", "id")]), F.struct("sq", "place")).alias("h")).select("aid", "id", "h.*")
        return citations.labels(once, by=("aid", "ticker"), order=("sq", "fiscal_year", "place"))

    def answer(self, questions: list[str], plans: list[planning.Plan] | None = None) -> tuple[DataFrame, Retrieval]:
        """One record per question (aid), and what it rests on."""
        found = self.retrieve(questions, plans)
        rows = [(k, q, p.needs_comparison) for k, (q, p) in enumerate(zip(questions, found.plans))]
        q = self.spark.createDataFrame(rows, "aid int, question string, needs_comparison boolean")
        return answering.answers(q, self.labelled(found), found.gaps, self.generator, self.settings.answer_mode, self.replies), found

    def eval_set(self, n: int = 10) -> DataFrame:
        """Evaluation items of all four types over the index; the generator writes the n synthetic questions."""
        cov = self.coverage().where("status = 'ok'")
        return evaluation.build_set(self.companies(), cov, coverage.fully_covered(cov), self.store.read("chunks"), chunks.count_tokens(F.col("text")), self.generator, n)

    def evaluate(self, items: DataFrame, judged: bool = True) -> DataFrame:
        """Scores of evaluation items (see evaluation.item, with id). What fails for one question, in planning, writing or judging, is an error of its own row; latency_s is the time that its plan and its answer took."""
        rows = items.orderBy("id").collect()
        made = self.plans([r.question for r in rows])
        plans = [p for p, _, _ in made]
        out, found = self.answer([r.question for r in rows], plans)
        planned = [(k, r.id, w, s, p.tickers, sorted(set(p.sections) | {s for q in p.sub_queries for s in q.sections}), sorted(set(p.fiscal_years) | {y for q in p.sub_queries for y in q.fiscal_years}), p.last_n_years, p.needs_comparison) for k, (r, (p, w, s)) in enumerate(zip(rows, made))]
        d = self.spark.createDataFrame(planned, "aid int, id string, wrong string, spent double, plan_tickers array<string>, plan_sections array<string>, plan_years array<int>, plan_last_n int, plan_comparison boolean")
        order = F.transform(F.array_sort(F.collect_list(F.struct("sq", "fiscal_year", "place", "id"))), lambda x: x["id"])
        first = found.hits.groupBy("aid", "ticker").agg(order.alias("ids")).groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "ids"))).alias("by_ticker"))
        texts = found.hits.groupBy("aid").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("id", "text")))).alias("texts"))
        d = d.join(items, "id").join(out.select("aid", F.col("text").alias("answer"), "valid", "invalid", "gaps", F.col("error").alias("unwritten"), F.col("seconds").alias("wrote")), "aid").join(first, "aid", "left").join(texts, "aid", "left")
        judge = self.judge

        @F.arrow_udf("struct<score: double, unsupported: string, error: string>")
        def faithful(answers: pa.Array, excerpts: pa.Array) -> pa.Array:
            out = []
            for a, e in zip(answers.to_pylist(), excerpts.to_pylist()):
                try:
                    (score, bad), wrong = judge.verdict(a, e) if e else (None, []), ""
                except Exception as x:  # a model may fail on one answer alone
                    score, bad, wrong = None, [], f"judge: {models.said(x)}"
                out.append({"score": score, "unsupported": " | ".join(bad), "error": wrong})
            return pa.array(out, pa.struct([("score", pa.float64()), ("unsupported", pa.string()), ("error", pa.string())]))

        accuracy, misses = evaluation.planner_checks()
        is_ = lambda *types: F.col("type").isin(*types)
        ticker = F.try_element_at("expected_tickers", F.lit(1))
        hits = F.coalesce(F.try_element_at("by_ticker", ticker), F.array().cast("array<string>"))
        cited = F.transform("valid", lambda i: F.concat(*([F.lit("["), i, F.lit("]\n")] if getattr(judge, "labelled", False) else []), F.try_element_at("texts", i)))
        d = d.withColumn("said", F.when(~is_("unanswerable"), faithful("answer", cited)) if judged else F.lit(None).cast("struct<score: double, unsupported: string, error: string>"))
        return d.select(
            "id",
            "type",
            "question",
            "expected_tickers",
            "plan_tickers",
            F.when(is_("synthetic"), evaluation.recall_at(hits, F.col("gold_chunk"))).alias("recall_at_5"),
            F.when(F.size("expected_tickers") > 1, F.round(evaluation.company_coverage(F.col("expected_tickers"), F.col("valid"), F.col("gaps")), 3)).alias("company_coverage"),
            F.when(is_("template", "example"), F.round(accuracy, 3)).alias("planner_accuracy"),
            F.when(is_("template", "example"), F.array_join(misses, " ")).alias("planner_misses"),
            F.col("said.score").alias("faithfulness"),
            F.col("said.unsupported").alias("unsupported"),
            F.when(is_("unanswerable"), evaluation.abstained(ticker, F.col("gaps"), F.col("answer")).cast("int")).alias("abstained"),
            F.size("valid").alias("n_citations"),
            F.array_join("invalid", " ").alias("invalid_citations"),
            F.array_join("gaps", " | ").alias("gaps"),
            F.round(F.col("spent") + F.col("wrote"), 1).alias("latency_s"),
            F.coalesce(*[F.nullif(c, F.lit("")) for c in ("wrong", "unwritten", "said.error")], F.lit("")).alias("error"),
            "answer",
        )

    def evaluate_into(self, items: DataFrame, path: str, judged: bool = True, batch: int = 20) -> int:
        """Append the results of items to path, batch by batch, and return how many were made.

        Items whose result lies there without an error are done and not asked again, so a run that was stopped goes on where it
        ended, and a finished one asks nothing; a batch is appended as a whole or not at all."""
        left = items.select("id").join(files.done_results(self.spark, path), "id", "left_anti")
        todo = sorted(r.id for r in left.collect())
        for k in range(0, len(todo), batch):
            files.write_results(self.evaluate(items.where(F.col("id").isin(todo[k : k + batch])), judged), path)
        return len(todo)

    @staticmethod
    def summary(rows: DataFrame) -> DataFrame:
        return evaluation.summary(rows, ["recall_at_5", "company_coverage", "planner_accuracy", "faithfulness", "abstained", "latency_s"])
