"""Jobs that a review found cut short."""

import json
import random
import sys
import zlib

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from filigree.functions import models
from filigree.operators import chunks, coverage, evaluation, search
from filigree.plans import planning, queries
from filigree.plans.engine import Engine
from filigree.settings import Settings


def test_grid_has_every_year_and_its_dots(spark):
    rows = [("A", "10-Q", 2024, "Q1"), ("A", "10-Q", 2025, "Q3"), ("A", "10-Q", 2025, "Q2"), ("A", "10-Q", 2021, "Q1"), ("B", "10-K", 2022, "FY")]
    cov = spark.createDataFrame(rows, "ticker string, form string, fiscal_year int, fiscal_quarter string")
    got = coverage.grid(cov)
    assert got.columns == ["ticker", "fy2022", "fy2024", "fy2025"]
    assert sorted(map(tuple, got.collect())) == [("A", "...", "1..", ".23"), ("B", "...", "...", "...")]


class Scripted:
    """Gives replies in turn and remembers what it was asked."""

    def __init__(self, *replies):
        self.replies, self.asked = list(replies), []

    def complete(self, prompt, system=None, json_mode=False):
        assert json_mode
        self.asked.append(prompt)
        return self.replies.pop(0)


class ByChunk:
    """Replies by the chunk that a prompt holds, in the tasks that ask."""

    def __init__(self, replies):
        self.replies = replies

    def complete(self, prompt, system=None, json_mode=False):
        assert json_mode and "FY2024" in prompt and "10-K" in prompt
        return self.replies[prompt.split(" word ")[0].split()[-1]]


def test_synthetic_items_replace_bad_replies(spark):
    """Asked in rounds, the items are those of a walk through all chunks in order, one after the other."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = [(f"{t}-{k}", t, f"{t} Inc", "10-K", "FY2024", "mdna", f"{t}{k} word " * 200) for t in ("A", "B", "C", "F") for k in range(3)]
    rows += [("D-0", "D", "D Inc", "10-K", "FY2024", "controls", "word " * 400), ("E-0", "E", "E Inc", "10-K", "FY2024", "mdna", "too short")]
    c = spark.createDataFrame(rows, "id string, ticker string, company string, form string, fiscal_label string, section string, text string")
    tokens = chunks.count_tokens(F.col("text"))
    order = [r.id for r in c.where("section = 'mdna' and ticker <> 'E'").orderBy(evaluation.shuffled(7, "id"), "id").collect()]
    bad = ["no json", '{"q": 1}', '["x"]', '{"question": " "}']
    r = random.Random(3)
    for n, share in ((2, 0.5), (3, 0.7), (10, 0.3), (4, 1.0)):
        replies = {i.replace("-", ""): r.choice(bad) if r.random() < share else f'So: {{"question": "About {i}?"}} there' for i in order}
        want, seen = [], set()
        for i in order:
            if i[0] not in seen and len(want) < n and evaluation.asked(replies[i.replace("-", "")]):
                seen.add(i[0])
                want.append((f"About {i}?", [i[0]], ["mdna"], i, "synthetic"))
        got = evaluation.synthetic_items(c, tokens, ByChunk(replies), n=n).collect()
        assert [(x.question, x.expected_tickers, x.expected_sections, x.gold_chunk, x.type) for x in got] == want
    assert evaluation.synthetic_items(c, tokens, ByChunk({}), n=0).count() == 0


def test_item_set_has_all_types(spark, small):
    rows = queries.eval_items(spark, small).collect()
    assert {"example", "template", "synthetic"} <= {r.type for r in rows} and len({r.id for r in rows}) == len(rows)
    assert [r.expected_last_n for r in rows if r.type == "example"].count(2) == 1 and sum(r.type == "example" for r in rows) == 3
    assert all((r.gold_chunk is not None) == (r.type == "synthetic") for r in rows)


def test_model_judge():
    model = Scripted('{"supported": 2, "total": 3, "unsupported_claims": ["c"]}', '{"supported": 5, "total": 4}', '{"total": 0}', "none")
    judge = models.ModelJudge(model)
    assert [judge.faithfulness("- a", ["[X-1]\ntext"]) for _ in range(3)] == [0.667, 1.0, 0.0]
    assert "[X-1]\ntext" in model.asked[0] and judge.faithfulness("- a", []) is None
    with pytest.raises(json.JSONDecodeError):
        judge.faithfulness("- a", ["x"])
    assert isinstance(models.judge(Settings()), models.OverlapJudge)
    assert isinstance(models.judge(Settings(judge_provider="openai", judge_model="m")), models.ModelJudge)


def test_reranker_orders_before_the_quota(spark, small):
    subq, cov = queries._subqueries(spark, small)
    vector = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("sq"), F.col("embedding").alias("vector"))
    years = planning.search_years(subq, cov).join(vector, "sq", "left")
    c, post, idf, stats = queries._index(spark, small)
    score = lambda query, text: F.crc32(text.cast("binary")).cast("double")
    every = search.relaxed(years, c, post, idf, stats, quota=10_000).join(c.select("id", "text"), "id").collect()
    want = {}
    for r in every:
        want.setdefault((r.sq, r.fiscal_year), []).append((-float(zlib.crc32(r.text.encode())), r.id))
    got = search.relaxed(years, c, post, idf, stats, quota=2, reranker=score).collect()
    assert max(map(len, want.values())) > 2
    assert {(r.sq, r.fiscal_year, r.place, r.id) for r in got} == {(*k, n, i) for k, v in want.items() for n, (_, i) in enumerate(sorted(v)[:2], 1)}


def test_settings_reach_reranker_and_cache(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), Settings(rerank=True))
    assert Engine(spark, str(tmp_path)).reranker is None
    rows = spark.createDataFrame([("red fox", "a red fox"), ("red fox", "a fox"), ("red fox", None), (None, "x")], "q string, t string")
    assert [r.s for r in rows.select(engine.reranker.column()("q", "t").alias("s")).collect()] == [1.0, 0.5, 0.0, 0.0]
    hosted = models.generator(Settings(llm_provider="openai", llm_model="m", llm_cache_dir=str(tmp_path / "replies")))
    calls = []
    hosted.inner.call = lambda *a, **b: calls.append(a) or {"choices": [{"message": {"content": "said"}}]}
    assert [hosted.complete("x"), hosted.complete("x")] == ["said", "said"] and len(calls) == 1
    assert isinstance(models.generator(Settings(llm_provider="openai", llm_model="m", llm_cache=False)), models.HttpGenerator)


def test_retrieval_without_texts_in_shuffles(spark, small, tmp_path):
    """Hits over narrow rows are those of the wide form, with the texts of their own documents, also where numbers and whole documents repeat; their plan reads written tables alone."""
    rows = [(1, "the thonen of one", "src0"), (1, "the other thonen", "src0"), (2, "of of the", "src0"), (2, "of of the", "src0"), (3, None, "src0"), (4, "the thonen", "src1"), (5, "nothing", "src3")]
    d = spark.createDataFrame(rows + [(20 + k, f"the thonen {k} of", "src3") for k in range(9)], "doc_id bigint, text string, source string")
    d.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, [1.0, float(k)]) for k in range(25)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = spark.createDataFrame([("the",), ("thonen",), ("thonen",), ("absent",)], "term string")
    kept = lambda p: sorted(map(tuple, p.where("term in ('the', 'thonen', 'absent')").groupBy("term", "ticker", "dl", "tf").count().collect()))
    for folder in (str(tmp_path), small):
        wide, post, idf, stats = queries._index(spark, folder)
        c, few, weights, sizes = queries._asked_index(spark, folder, asked)
        assert "text" not in c.columns and {r.term for r in few.select("term").distinct().collect()} <= {"the", "thonen"}
        cols = ["id", "doc_id", "ticker", "form", "fiscal_year", "fiscal_quarter", "section", "chunk", "embedding"]
        assert sorted(map(repr, c.select(cols).collect())) == sorted(map(repr, wide.select(cols).collect()))
        assert kept(few.select("term", "ticker", "dl", "tf")) == kept(post.join(wide.select("id", "ticker"), "id").select("term", "ticker", "dl", "tf"))
        assert {r.term: round(r.idf, 9) for r in weights.collect()} == {r.term: round(r.idf, 9) for r in idf.collect()} and sizes.collect() == stats.collect()
        texts = queries.standin.with_texts(spark, folder, c.select("id", "doc_id", "hash")).select("id", "doc_id", "text")
        assert sorted(map(repr, texts.select("doc_id", "text").collect())) == sorted(map(repr, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()))
        assert texts.select("id").distinct().count() == c.count()
    subq, _, hits = queries._retrieved(spark, small)
    for d in (subq, hits):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan
