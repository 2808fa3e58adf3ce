"""From files to scores on three made-up companies."""

import json
import sys

import pytest
from pyspark import cloudpickle

from filigree import __main__ as cli
from filigree.plans import planning
from filigree.plans.engine import Engine
from filigree.settings import Settings

NAMES = {"AA": "Alpha", "BB": "Beta", "CC": "Gamma"}


def filing(t, form, filed, end, words):
    body = "\n".join(f"{h}\n" + f"{NAMES[t]} {w} in this part of the report. " * 30 for h, w in words)
    return f"Ticker: {t}\nCompany: {NAMES[t]} Inc\nCIK: 1\nFiling Type: {form}\nFiling Date: {filed}\nReport Period: {end}\n{'=' * 20}\nFront page of the filing.\n{body}\n"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("filings")
    (d / "raw").mkdir()
    texts = {}
    for t in ("AA", "BB"):
        for y in (2023, 2024):
            texts[f"{t}{y}.txt"] = filing(t, "10-K", f"{y + 1}-02-01", f"{y}-12-31", [("Item 1. Business", "makes things"), ("Item 1A. Risk Factors", f"fears storms of {y}"), ("Item 7. Management’s Discussion and Analysis", "revenue rose")])
        texts[f"{t}q.txt"] = filing(t, "10-Q", "2024-05-01", "2024-03-31", [("Item 1. Financial Statements", "balances"), ("Item 2. Management’s Discussion and Analysis", "quarter revenue fell")])
    texts["CC.txt"] = filing("CC", "10-K", "2025-02-01", "2024-12-31", [("Item 1. Business", "sells water")])
    for n, t in texts.items():
        (d / "raw" / n).write_text(t)
    (d / "manifest.json").write_text(json.dumps({"files": list(texts)}))
    where = ["--manifest", str(d / "manifest.json"), "--texts", str(d / "raw")]
    cli.main([str(d / "out"), "build", *where])
    cli.main([str(d / "out"), "ingest", *where])
    return d, Engine(spark, str(d / "out"), Settings(embed_dim=64))


def raw_of(spark, d):
    from filigree.sources import files

    return files.whole_texts(spark, str(d / "raw"), files.manifest(spark, str(d / "manifest.json")))


def test_coverage_and_index(spark, made):
    d, e = made
    assert {(r.ticker, r.fiscal_label) for r in e.coverage().collect()} == {(t, f) for t in ("AA", "BB") for f in ("FY2023", "FY2024", "Q1 FY2024")} | {("CC", "FY2024")}
    got = e.store.read("chunks")
    assert {r.section for r in got.where("file = 'AA2023.txt'").collect()} >= {"business", "risk_factors", "mdna"}
    assert e.ingest(raw_of(spark, d)) == (0, 0)
    (d / "raw" / "CC.txt").write_text((d / "raw" / "CC.txt").read_text().replace("sells water", "sells ice"))
    up, gone = e.ingest(raw_of(spark, d))
    assert up >= 1 and gone == 0


def test_retrieval(spark, made):
    _, e = made
    found = e.retrieve(["What risks does Alpha fear in 2023 and 2024?"])
    hits = found.hits.collect()
    assert {r.ticker for r in hits} == {"AA"} and {r.fiscal_year for r in hits} == {2023, 2024}
    assert {r.section for r in hits} == {"risk_factors"} and all(r.tier == 0 for r in hits)
    plan = planning.validate({"tickers": ["AA", "CC"], "unknown_companies": ["Omega"], "fiscal_years": [1990], "sections": ["legal"], "sub_queries": [{"ticker": "AA", "query": "revenue", "fiscal_years": [2024]}, {"ticker": "AA", "query": "storms", "fiscal_years": [2023]}], "needs_comparison": False}, {"AA", "BB", "CC"})
    found = e.retrieve(["What?"], [plan])
    assert {r.gap for r in found.gaps.collect()} == {"Omega: not in the corpus", "CC: no filing for FY1990 in the corpus", "CC: no matching chunks"}
    assert {r.sq for r in found.hits.collect()} == {0, 1} and found.notes.count() == 2
    assert all(r.n <= 5 for r in found.hits.groupBy("sq", "fiscal_year").count().withColumnRenamed("count", "n").collect())


def test_answers(spark, made):
    _, e = made
    out, _ = e.answer(["How did revenue change at Alpha and Beta in 2024?", "And at Nobody?"])
    a, b = out.orderBy("aid").collect()
    assert a.calls == 1 and len(a.valid) > 1 and a.invalid == [] and {v.split("-")[0] for v in a.valid} == {"AA", "BB"}
    assert b.calls == 0 and "no filings" in b.text


def test_evaluation(spark, made, tmp_path, capsys):
    d, e = made
    gold = e.store.read("chunks").where("file = 'AA2024.txt' and section = 'risk_factors'").first().id
    items = [
        {"id": "exa-00", "type": "example", "question": "Which risks do Alpha and Beta fear?", "expected_tickers": ["AA", "BB"], "expected_sections": ["risk_factors"], "expected_years": [], "expected_comparison": True},
        {"id": "syn-01", "type": "synthetic", "question": "Which storms does Alpha fear as risk in 2024?", "expected_tickers": ["AA"], "expected_sections": [], "expected_years": [], "gold_chunk": gold},
        {"id": "una-02", "type": "unanswerable", "question": "How did Gamma revenue change between 2001 and 2002?", "expected_tickers": ["CC"], "expected_sections": [], "expected_years": [2001, 2002]},
    ]
    (tmp_path / "items.json").write_text(json.dumps(items))
    from filigree.sources import files

    rows = e.evaluate(files.read_items(spark, str(tmp_path / "items.json")))
    got = {r.id: r for r in rows.collect()}
    assert got["exa-00"].planner_accuracy == 1.0 and got["exa-00"].company_coverage == 1.0 and got["exa-00"].faithfulness == 1.0
    assert got["syn-01"].recall_at_5 == 1 and got["una-02"].abstained == 1 and got["una-02"].faithfulness is None
    assert {r.type: r.n for r in e.summary(rows).collect()} == {"example": 1, "synthetic": 1, "unanswerable": 1, "all": 3}
    cli.main([str(d / "out"), "evaluate", "--items", str(tmp_path / "items.json"), "--limit", "1", "--types", "unanswerable", "--no-judge", "--results", str(tmp_path / "results")])
    assert spark.read.csv(str(tmp_path / "results"), header=True, multiLine=True, escape='"').count() == 1
    cli.main([str(d / "out"), "answer", "Which risks does Beta fear?"])
    assert '"valid"' in capsys.readouterr().out


class Failing:
    """A model that fails on some prompts."""

    def complete(self, prompt, system=None, json_mode=False):
        if "Beta" in prompt:
            raise RuntimeError("no reply today")
        return "- Alpha fears storms of 2024 [AA-1]"


def test_a_failing_model_is_an_error_of_its_own_row(spark, made, tmp_path):
    d, e = made
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test module
    own = Engine(spark, str(d / "out"), Settings(embed_dim=64), generator=Failing())
    items = [{"id": f"exa-0{k}", "type": "example", "question": f"Which risks does {n} fear?", "expected_tickers": [t], "expected_sections": [], "expected_years": []} for k, (t, n) in enumerate([("AA", "Alpha"), ("BB", "Beta")])]
    (tmp_path / "items.json").write_text(json.dumps(items))
    from filigree.sources import files

    rows = {r.id: r for r in own.evaluate(files.read_items(spark, str(tmp_path / "items.json"))).collect()}
    assert rows["exa-00"].error == "" and rows["exa-00"].n_citations == 1 and rows["exa-00"].latency_s >= 0
    assert rows["exa-01"].error == "RuntimeError: no reply today" and rows["exa-01"].n_citations == 0


def test_item_set_and_summary_as_files(spark, made, tmp_path):
    d, e = made
    cli.main([str(d / "out"), "items", "--items", str(tmp_path / "set"), "--synthetic", "2"])
    from filigree.sources import files

    got = files.read_items(spark, str(tmp_path / "set")).collect()
    assert {"example", "synthetic"} <= {r.type for r in got} and sorted(r.id for r in got) == sorted({r.id for r in got})
    cli.main([str(d / "out"), "evaluate", "--items", str(tmp_path / "set"), "--types", "synthetic", "--results", str(tmp_path / "res"), "--summary", str(tmp_path / "sum")])
    table = spark.read.csv(str(tmp_path / "sum"), header=True).collect()
    assert {r.type for r in table} == {"synthetic", "all"} and all(r.errors == "0" for r in table)


def test_updates_write_what_changed(spark, made):
    d, e = made
    before = e.store._history()[0]
    assert e.ingest(raw_of(spark, d)) == (0, 0) and e.store._history()[0] == before  # nothing new, nothing written
    f = d / "raw" / "BB2023.txt"
    f.write_text(f.read_text().replace("makes things", "makes tools"))
    up, gone = e.ingest(raw_of(spark, d))
    now = e.store._history()[0]
    assert up >= 1 and now["live"]["BB"] == now["version"] and now["live"]["AA"] == before["live"]["AA"]
    kept = {p.name for p in (d / "out" / "index").iterdir()} - {"current"}
    assert kept <= {before["version"], now["version"], *before["live"].values(), *now["live"].values()}
    assert e.store.read("stats").first().n_docs == e.store.read("chunks").count()
