"""Answers from retrieved excerpts: one prompt per question, or one per company and a comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filigree.functions.models import completed
from filigree.operators import citations
from filigree.sources.cache import key_column
from filigree.sources.scratch import Scratch

#: Instructions to a writer model.
WRITE = "Answer from the excerpts alone. End every statement with the labels of the excerpts that support it, in square brackets. Name periods by their fiscal label. Close with the known gaps, or with Gaps: none."
SUMMARISE = "Summarise what the excerpts say about the question for this company alone. End every statement with the labels of the excerpts that support it, in square brackets. Say what is missing."
COMPARE = "Answer the question from the summaries alone, keep their labels, then compare the companies. Close with the known gaps, or with Gaps: none."


def replied(asked: DataFrame, prompt: str, model, system: str, cache=None) -> DataFrame:
    """asked with `r`, the model's reply to column prompt; through a table of replies (sources.cache.TableCache) where one is given, so that a request is made once."""
    if cache is None:
        return asked.withColumn("r", completed(model, system)(F.col(prompt)))
    return cache.answered(asked, prompt, key_column(getattr(model, "provider", type(model).__name__), getattr(model, "model", ""), F.concat(F.lit(system + "\n\n"), F.col(prompt))), completed(model, system))


def answers(questions: DataFrame, hits: DataFrame, gaps: DataFrame, model, mode: str = "single", cache=None) -> DataFrame:
    """One record per question (aid, question, needs_comparison): text, valid and invalid citations, calls made, the error of a call that failed and the seconds that calls took.

    hits: labelled excerpts (aid, ticker, company, id, label, form, fiscal_label,
    period_end, section, text); gaps: (aid, gap). A question without any excerpt gets a
    fixed text and no call. In mode `multi` each company is summarised by a call of its
    own, and a last call compares them where the plan asks for it and there are several.
    With a cache (a TableCache) requests that it holds make no call.
    """
    gap = gaps.groupBy("aid").agg(F.array_sort(F.collect_set("gap")).alias("gaps"))
    q = questions.join(gap, "aid", "left").withColumn("gaps", F.coalesce("gaps", F.array().cast("array<string>")))
    said = F.when(F.size("gaps") > 0, F.array_join(F.transform("gaps", lambda g: F.concat(F.lit("- "), g)), "\n")).otherwise("none")
    blocks = citations.prompt_block(hits, by=("aid", "ticker", "company"))
    head = F.concat(F.lit("## "), "company", F.lit(" ("), "ticker", F.lit(")\n\n"))
    if mode == "single":
        body = blocks.groupBy("aid").agg(F.array_join(F.array_sort(F.collect_list(F.concat(head, "block"))), "\n\n").alias("body"))
        d = q.join(body, "aid", "left").withColumn("prompt", F.when(F.col("body").isNotNull(), F.concat(F.lit("Question: "), "question", F.lit("\n\nKnown gaps:\n"), said, F.lit("\n\nExcerpts:\n\n"), "body")))
        d = replied(d, "prompt", model, WRITE, cache).withColumns({"raw": F.col("r.text"), "error": F.col("r.error"), "seconds": F.col("r.seconds"), "calls": F.when(F.col("prompt").isNotNull(), 1).otherwise(0)})
    else:
        parts = blocks.join(questions.select("aid", "question"), "aid")
        ask = F.concat(F.lit("Question: "), "question", F.lit("\n\nCompany: "), "company", F.lit("\n\nExcerpts:\n\n"), "block")
        parts = replied(parts.withColumn("prompt", ask), "prompt", model, SUMMARISE, cache).select("aid", "ticker", F.coalesce("r.text", F.lit("")).alias("summary"), "r.error", "r.seconds")
        by = parts.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("ticker", "summary"))).alias("s"), F.max("error").alias("e"), F.sum("seconds").alias("t"))
        d = q.join(by, "aid", "left")
        several = F.col("needs_comparison") & (F.size("s") > 1)
        body = F.array_join(F.transform("s", lambda x: F.concat(F.lit("## "), x["ticker"], F.lit("\n"), x["summary"])), "\n\n")
        d = d.withColumn("prompt", F.when(several, F.concat(F.lit("Question: "), "question", F.lit("\n\nPer-company summaries:\n\n"), body, F.lit("\n\nKnown gaps:\n"), said)))
        joined = F.concat(F.array_join(F.transform("s", lambda x: x["summary"]), "\n\n"), F.when(F.size("gaps") > 0, F.concat(F.lit("\n\nGaps:\n"), said)).otherwise(""))
        d = replied(d, "prompt", model, COMPARE, cache)
        d = d.withColumns({"raw": F.coalesce("r.text", joined), "error": F.coalesce(F.nullif("e", F.lit("")), "r.error"), "seconds": F.coalesce("t", F.lit(0.0)) + F.col("r.seconds")})
        d = d.withColumn("calls", F.greatest(F.size("s"), F.lit(0)) + several.cast("int"))
    none = F.concat(F.lit("The corpus has no filings that can answer this question.\n\nGaps:\n"), F.when(F.size("gaps") > 0, said).otherwise("- no matching companies"))
    known = hits.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("label", "id"))).alias("known"))
    # written once, for what follows reads the replies twice and every call costs
    d = Scratch(questions.sparkSession, "answers").keep(d.select("aid", "question", "gaps", "error", "seconds", "calls", "raw").withColumn("none", none), "replies")
    d = d.join(known, "aid", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,string>")))
    d = d.select("aid", "question", "gaps", "error", "seconds", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce(citations.resolve(F.col("raw"), F.col("known")), F.col("none")).alias("text"), F.coalesce(citations.unknown_labels(F.col("raw"), F.col("known")), F.array().cast("array<string>")).alias("odd"))
    checked = citations.validated(d.select("aid", "text"), hits.select("aid", "id")).drop("text")
    return d.join(checked, "aid").select("aid", "question", "text", "valid", F.array_distinct(F.concat("odd", "invalid")).alias("invalid"), "gaps", "calls", "error", "seconds")
