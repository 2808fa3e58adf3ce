"""Search, plans, citations, evaluation, models and storage."""

import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from filigree.functions import models
from filigree.operators import answering, citations, evaluation, index, search
from filigree.plans import planning
from filigree.settings import Settings
from filigree.sources import cache, files, store


def test_rrf(spark):
    lists = [["a", "b", "c"], ["c", "a", "d"]]
    rows = spark.createDataFrame([(1, n, i, r) for n, x in enumerate(lists) for r, i in enumerate(x, 1)], "qid int, list int, id string, rank int")
    got = sorted(search.rrf(rows).collect(), key=lambda r: r.place)
    assert [r.id for r in got] == ["a", "c", "b", "d"]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62) and got[1].score == pytest.approx(1 / 63 + 1 / 61)


def test_filters(spark):
    df = spark.createDataFrame([("A", 2024), ("A", 2023), ("B", 2024)], "ticker string, fiscal_year int")
    n = lambda f: df.where(search.predicate(f)).count()
    assert (n({}), n({"ticker": "A"}), n({"ticker": "A", "fiscal_year": [2024, 2025]})) == (3, 2, 1)


def test_bm25_scores_by_hand(spark):
    from math import log

    docs = {"1": "red red blue", "2": "blue sky", "3": "green"}
    c = spark.createDataFrame([(i, t) for i, t in docs.items()], "id string, text string")
    post, stats = index.postings(c, F.col("text")), index.corpus_stats(c, F.col("text"))
    idf = {r.term: r.idf for r in index.idf(post, stats).collect()}
    raw = {t: log((3 - n + 0.5) / (n + 0.5)) for t, n in {"red": 1, "blue": 2, "sky": 1, "green": 1}.items()}
    assert idf["red"] == pytest.approx(raw["red"]) and idf["blue"] == pytest.approx(0.25 * sum(raw.values()) / 4)
    q = spark.createDataFrame([(1, "Red red sky")], "qid int, query string")
    got = {r.id: r.score for r in search.sparse_scores(q, post, index.idf(post, stats), stats).collect()}
    norm = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2))
    assert got["1"] == pytest.approx(2 * raw["red"] * norm(2, 3)) and got["2"] == pytest.approx(raw["sky"] * norm(1, 2)) and "3" not in got


def test_plans():
    known = {"AA", "BB"}
    raw = {"tickers": ["aa", "BB"], "sub_queries": [{"ticker": "aa", "query": "q"}], "needs_comparison": True, "period_types": ["q4"]}
    plan = planning.validate(raw, known)
    assert plan.tickers == ["AA", "BB"] and [(s.ticker, s.query) for s in plan.sub_queries] == [("AA", "q"), ("BB", None)] and plan.period_types == ["Q4"]
    for bad in ([], {**raw, "tickers": "AA"}, {**raw, "tickers": ["ZZ"]}, {**raw, "sections": ["x"]}, {**raw, "period_types": ["H1"]}, {**raw, "sub_queries": [{"ticker": "AA"}]}):
        with pytest.raises(ValueError):
            planning.validate(bad, known)


def test_planner_sends_errors_back():
    class Model:
        asked = []

        def complete(self, prompt, system=None, json_mode=False):
            self.asked.append(prompt)
            return "{" if len(self.asked) == 1 else json.dumps({"tickers": ["AA"], "sub_queries": [], "needs_comparison": False})

    m = Model()
    assert planning.plan_question("what", {"AA"}, "", m).tickers == ["AA"] and "invalid" in m.asked[1]
    with pytest.raises(ValueError):
        planning.plan_question("what", {"BB"}, "", m)


def test_rule_planner():
    comp = [{"ticker": "AA", "name": "Alpha Inc", "aliases": ["Alpha"], "industry": "Banking"}, {"ticker": "BB", "name": "Beta", "aliases": [], "industry": "Banking"}]
    p = planning.rule_plan("What risks does Alpha face over the last two years?", comp)
    assert (p.tickers, p.last_n_years, p.sections, p.period_types) == (["AA"], 2, ["risk_factors"], ["FY"])
    assert planning.rule_plan("Compare the banking companies in 2023 and 2024", comp).fiscal_years == [2023, 2024]


def test_two_subqueries_of_one_ticker_stay_apart(spark):
    plan = planning.validate({"tickers": ["AA"], "sub_queries": [{"ticker": "AA", "query": "x"}, {"ticker": "AA", "query": "y"}], "needs_comparison": False}, {"AA"})
    rows = planning.plan_rows(spark, [plan, plan]).collect()
    assert len({r.sq for r in rows}) == 4


ID = "AA-10-K-2024-FY-mdna-0"


def test_citations(spark):
    text = f"x [{ID}] [BB.A-10-Q-2023-Q4-risk_factors-12] [{ID}] [AA-10-K-24-FY-mdna-0] [AA-1; AA-123] [see note] [AA-1, or so]"
    df = spark.createDataFrame([(text, {"AA-1": ID})], "t string, m map<string,string>")
    r = df.select(citations.citations(F.col("t")).alias("c"), citations.resolve(F.col("t"), F.col("m")).alias("r"), citations.unknown_labels(F.col("t"), F.col("m")).alias("u")).first()
    assert r.c == [ID, "BB.A-10-Q-2023-Q4-risk_factors-12"] and r.u == ["AA-123"]
    assert f"[{ID}, AA-123] [see note] [AA-1, or so]" in r.r


def test_answers_offline(spark):
    q = spark.createDataFrame([(1, "What?", True), (2, "Nothing?", False)], "aid int, question string, needs_comparison boolean")
    hits = spark.createDataFrame([(1, "AA", "Alpha", ID, "AA-1", "10-K", "FY2024", "2024-12-31", "mdna", "Sales rose. More."), (1, "BB", "Beta", ID.replace("AA", "BB"), "BB-1", "10-K", "FY2024", "2024-12-31", "mdna", "Sales fell.")], "aid int, ticker string, company string, id string, label string, form string, fiscal_label string, period_end string, section string, text string")
    gaps = spark.createDataFrame([(1, "CC: not in the corpus")], "aid int, gap string")
    for mode, calls in (("single", 1), ("multi", 3)):
        out = {r.aid: r for r in answering.answers(q, hits, gaps, models.ExtractiveGenerator(), mode).collect()}
        assert out[2].calls == 0 and "no filings" in out[2].text and out[2].valid == []
        assert out[1].calls == calls and "CC: not in the corpus" in out[1].text
    out = answering.answers(q, hits, gaps, models.ExtractiveGenerator()).where("aid = 1").first()
    assert out.valid == [ID, ID.replace("AA", "BB")] and out.invalid == []


def test_metrics(spark):
    row = spark.createDataFrame([(["T", "V"], [ID.replace("AA", "T")], ["VZ: no filing"], "Gaps:\nnone")], "e array<string>, c array<string>, g array<string>, a string")
    r = row.select(evaluation.company_coverage(F.col("e"), F.col("c"), F.col("g")).alias("s"), evaluation.abstained(F.lit("V"), F.col("g"), F.col("a")).alias("n"), evaluation.abstained(F.lit("VZ"), F.col("g"), F.col("a")).alias("y")).first()
    assert (r.s, r.n, r.y) == (0.5, False, True)  # a ticker inside another one is no match
    rows = spark.createDataFrame([("example", "", 1.0), ("example", "late", None), ("template", "", None)], "type string, error string, m double")
    got = {r.type: (r.n, r.errors, r.m) for r in evaluation.summary(rows, ["m"]).collect()}
    assert got == {"example": (2, 1, 1.0), "template": (1, 0, None), "all": (3, 1, 1.0)}


def test_judge():
    assert models.OverlapJudge().faithfulness("- sales rose much [A-1]\n- aliens landed [A-2]", ["Sales rose much."]) == 0.5
    assert models.OverlapJudge().faithfulness("- x", []) is None


def test_embedder(spark):
    e = models.HashEmbedder(256)
    a, b, z = e.embed(["red sky", "red sky", ""])
    assert a == b and sum(x * x for x in a) == pytest.approx(1) and not any(z)
    col = spark.createDataFrame([("red sky",), (None,)], "t string").select(e.column()(F.col("t")).alias("v")).collect()
    assert col[0].v == pytest.approx(a) and col[1].v is None


def refusal(code, body="", headers=None):
    return urllib.error.HTTPError("u", code, "m", headers or {}, io.BytesIO(body.encode()))


def test_post_waits_and_gives_up():
    waits, script = [], [refusal(429, '{"retryDelay": "3s"}'), refusal(500), io.BytesIO(b'{"ok": 1}')]

    def send(request, timeout):
        x = script.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert models.post("http://u", {}, {}, send=send, sleep=waits.append) == {"ok": 1} and waits == [4, 4]
    script[:] = [refusal(429, '{"retryDelay": "500s"}')]
    with pytest.raises(models.OutOfQuota):
        models.post("http://u", {}, {}, send=send, sleep=waits.append)
    script[:] = [refusal(503)] * 3
    with pytest.raises(models.Overloaded):
        models.post("http://u", {}, {}, send=send, sleep=waits.append, overloads=3)


def test_providers_and_fallback(monkeypatch):
    monkeypatch.setenv("ANTHROPIC_API_KEY", "k")
    seen = []

    def call(url, headers, body, **_):
        seen.append(body["model"])
        if body["model"] == "m1":
            raise models.OutOfQuota("m1")
        return {"content": [{"type": "text", "text": 'Sure: {"a": 1} done'}]}

    g = models.HttpGenerator("anthropic", "m1", ("m2",), call=call)
    assert g.complete("p", system="s", json_mode=True) == '{"a": 1}' and g.complete("p") == 'Sure: {"a": 1} done' and seen == ["m1", "m2", "m2"]
    url, headers, body = g.request("m2", "p", "s", True, 0.0)
    assert body["system"].startswith("s") and "temperature" not in body and headers["x-api-key"] == "k"
    with pytest.raises(RuntimeError, match="declined"):
        g.read({"stop_reason": "refusal"}, False)
    with pytest.raises(ValueError):
        models.HttpGenerator("none", "m")
    assert models.json_object("no object") == "no object" and models.json_object('x {"a": {}} y') == '{"a": {}}'


def test_reply_cache(tmp_path):
    class Count:
        n = 0

        def complete(self, prompt, system=None, json_mode=False):
            self.n += 1
            return "" if prompt == "empty" else "said"

    inner = Count()
    c = models.Cached(inner, cache.FileCache(str(tmp_path)), "p", "m")
    assert [c.complete("x"), c.complete("x"), c.complete("y")] == ["said"] * 3 and inner.n == 2
    c.complete("empty"), c.complete("empty")
    assert inner.n == 4
    assert isinstance(models.generator(Settings()), models.ExtractiveGenerator)


def chunk_rows(spark, texts):
    rows = [(f"AA-10-K-2024-FY-mdna-{k}", t, t, "AA", "Alpha", "FY2024", "mdna", "f", F"h{t}") for k, t in texts.items()]
    return spark.createDataFrame(rows, "id string, text string, embed_text string, ticker string, company string, fiscal_label string, section string, file string, hash string")


def test_index_store(spark, tmp_path):
    s = store.IndexStore(spark, (tmp_path / "index").as_uri())
    calls = models.HashEmbedder(8).column()
    s.update(chunk_rows(spark, {0: "red", 1: "blue"}), calls)
    first = {r.id: r.embedding for r in s.read("chunks").collect()}
    s.update(chunk_rows(spark, {0: "red", 2: "green sky"}), calls)
    got = {r.id[-1]: r for r in s.read("chunks").collect()}
    assert set(got) == {"0", "2"} and got["0"].embedding == first["AA-10-K-2024-FY-mdna-0"] and got["2"].embedding
    assert s.read("stats").first().n_docs == 2 and s.get(["AA-10-K-2024-FY-mdna-2"]).count() == 1
    assert {r.term for r in s.read("postings").collect()} >= {"red", "green", "sky", "alpha"}


def test_files(spark, tmp_path):
    (tmp_path / "manifest.json").write_text('{"files": ["b.txt", "a.txt"]}')
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_bytes(b"ok \xff")
    (tmp_path / "raw" / "b.txt").write_text("two\nlines")
    names = files.manifest(spark, str(tmp_path / "manifest.json"))
    got = {r.file: (r.seq, r.text) for r in files.whole_texts(spark, str(tmp_path / "raw"), names).collect()}
    assert got == {"b.txt": (0, "two\nlines"), "a.txt": (1, "ok �")}
    comp = spark.createDataFrame([("BB", "Beta", "1", "S", "I", ["b"], "12-31"), ("AA", "Alpha", "2", None, None, [], "06-30")], "ticker string, name string, cik string, sector string, industry string, aliases array<string>, fiscal_year_end string")
    files.write_companies(comp, str(tmp_path / "companies"))
    assert sorted(map(tuple, files.read_companies(spark, str(tmp_path / "companies")).collect())) == sorted(map(tuple, comp.collect()))


def test_stream(spark, tmp_path):
    from filigree.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("x\ny")
    seen = []
    q = ingest.into(ingest.stream_texts(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda df: seen.extend((r.file, r.text) for r in df.collect()))
    q.awaitTermination(60)
    assert seen == [("one.txt", "x\ny")]


def test_hosted_vectors():
    seen = []

    def call(url, headers, body, **_):
        seen.append(body)
        if "requests" in body:
            return {"embeddings": [{"values": [3.0, 4.0]} for _ in body["requests"]]}
        return {"data": [{"index": k, "embedding": [float(len(t)), 0.0]} for k, t in reversed(list(enumerate(body["input"])))]}

    g = models.HttpEmbedder("gemini", "m", 2, call=call)
    assert g.embed(["a", "b"], "query") == [[0.6, 0.8]] * 2 and {r["taskType"] for r in seen[0]["requests"]} == {"RETRIEVAL_QUERY"}
    o = models.HttpEmbedder("openai", "m", 2, max_tokens=3, prefixes={"document": "doc: "}, call=call)
    assert o.embed(["one two three four five", "x"]) == [[1.0, 0.0]] * 2
    assert [t.removeprefix("doc: ").split() for t in seen[1]["input"]] == [["one", "two", "three"], ["four", "five"], ["x"]]  # whole, in stretches
    assert isinstance(models.embedder(Settings()), models.HashEmbedder)
    assert isinstance(models.embedder(Settings(embed_provider="openai", embed_model="m")), models.HttpEmbedder)
    with pytest.raises(ValueError):
        models.HttpEmbedder("none", "m", 2)


def test_judges_name_what_is_not_supported():
    score, bad = models.OverlapJudge().verdict("- red foxes run [A-1]\n- green cars fly [A-2]", ["red foxes run fast"])
    assert score == 0.5 and bad == ["- green cars fly [A-2]"]


def test_tickers_that_look_like_numbers(spark, tmp_path):
    rows = chunk_rows(spark, {0: "red", 1: "blue"}).withColumn("ticker", F.when(F.col("text") == "red", "007").otherwise("TRUE"))
    s = store.IndexStore(spark, (tmp_path / "index").as_uri())
    s.update(rows)
    s.update(rows.where("text = 'red'").union(rows.where("text = 'blue'").withColumn("hash", F.lit("new"))))
    assert {(r.ticker, r.hash) for r in s.read("chunks").collect()} == {("007", "hred"), ("TRUE", "new")}
    assert {r.ticker for r in s.read("postings").collect()} == {"007", "TRUE"}
