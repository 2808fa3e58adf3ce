"""Index upkeep by deltas, streams into an index, replies and results that survive a stopped run."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_engine import filing

from filigree.operators import answering, index
from filigree.plans.engine import Engine
from filigree.settings import Settings
from filigree.sources import files
from filigree.sources.cache import TableCache
from filigree.sources.store import IndexStore
from filigree.streaming import ingest


def rows(spark, texts):
    """Chunks (id, file, ticker, text) with what an index needs; an id is TICKER-n of file TICKERn."""
    d = spark.createDataFrame([(i, i.replace("-", ""), i.split("-")[0], t) for i, t in texts.items()], "id string, file string, ticker string, text string")
    none = F.lit(None).cast("string")
    return d.select("id", "file", "text", F.col("text").alias("embed_text"), "ticker", none.alias("company"), none.alias("fiscal_label"), F.lit("mdna").alias("section"), F.md5("text").alias("hash"))


def weights(store):
    return {r.term: round(r.idf, 9) for r in store.read("idf").collect()}, [tuple(r) for r in store.read("stats").collect()]


def test_weights_by_deltas_are_those_of_a_rebuild(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "a"))
    texts = {"A-1": "red blue", "A-2": "red red", "B-1": "green sky", "B-2": "blue sky blue", "C-1": "only here", "D-1": ""}
    store.update(rows(spark, texts))
    for change in ({"A-1": "red sun", "A-3": "new moon blue"}, {"B-1": None, "C-1": None}, {"E-1": "moon sky", "A-2": "red red"}):
        texts = {k: v for k, v in (texts | change).items() if v is not None}
        before = store._history()[0]
        store.update(rows(spark, texts))
        fresh = IndexStore(spark, str(tmp_path / f"fresh{len(texts)}-{len(change)}-{'E-1' in texts}"))
        fresh.update(rows(spark, texts))
        assert weights(store) == weights(fresh)
        post = fresh.read("postings")
        stats = fresh.read("stats")
        assert weights(fresh)[0] == {r.term: round(r.idf, 9) for r in index.idf(post, stats).collect()}
        now = store._history()[0]
        # a version holds the postings of what changed alone
        changed = {k.split("-")[0] for k in change if k.split("-")[0] in now["live"] and now["live"][k.split("-")[0]] == now["version"]}
        assert {p.name for p in (tmp_path / "a" / now["version"] / "postings").glob("ticker=*")} == {f"ticker={t}" for t in changed} and before != now


def test_a_batch_leaves_other_files(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "s"))
    batch = lambda names: spark.createDataFrame([(n,) for n in names], "file string")
    assert store.update(rows(spark, {"A-1": "red", "A-2": "blue"}), files=batch(["A1", "A2"])) == (2, 0)
    assert store.update(rows(spark, {"B-1": "sky", "A-2": "green"}), files=batch(["B1", "A2"])) == (2, 0)
    assert {r.id: r.text for r in store.read("chunks").collect()} == {"A-1": "red", "A-2": "green", "B-1": "sky"}
    assert store.update(rows(spark, {"A-2": "green"}), files=batch(["A2"])) == (0, 0)
    assert store.update(rows(spark, {}), files=batch(["A2", "Z9"])) == (0, 1)  # a file that has no chunks any more
    assert {r.id for r in store.read("chunks").collect()} == {"A-1", "B-1"}
    fresh = IndexStore(spark, str(tmp_path / "f"))
    fresh.update(rows(spark, {"A-1": "red", "B-1": "sky"}))
    assert weights(store) == weights(fresh)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("upkeep")
    (d / "raw").mkdir()
    texts = {f"{t}.txt": filing(t, "10-K", "2025-02-01", "2024-12-31", [("Item 1. Business", "makes things"), ("Item 1A. Risk Factors", "fears storms")]) for t in ("AA", "BB", "CC")}
    for n, t in texts.items():
        (d / "raw" / n).write_text(t)
    e = Engine(spark, str(d / "out"), Settings(embed_dim=16))
    names = spark.createDataFrame([(k, n) for k, n in enumerate(texts)], "seq int, file string")
    raw = files.whole_texts(spark, str(d / "raw"), names)
    e.build(raw)
    return d, e, raw


def test_a_stream_of_two_batches_holds_both(spark, built, tmp_path):
    d, _, raw = built
    e = Engine(spark, str(tmp_path / "out"), Settings(embed_dim=16))
    e.build(raw)
    for batch in (["AA.txt", "BB.txt"], ["CC.txt"]):
        for n in batch:
            (tmp_path / "in").mkdir(exist_ok=True)
            (tmp_path / "in" / n).write_text((d / "raw" / n).read_text())
        ingest.into_index(ingest.stream_texts(spark, str(tmp_path / "in"), 1), str(tmp_path / "cp"), e).awaitTermination()
    assert {r.file for r in e.store.read("chunks").select("file").distinct().collect()} == {"AA.txt", "BB.txt", "CC.txt"}
    whole = Engine(spark, str(tmp_path / "whole"), Settings(embed_dim=16))
    whole.build(raw)
    whole.ingest(raw)
    assert weights(e.store) == weights(whole.store)


def test_only_listed_files_are_read(spark, tmp_path):
    for p in ("a.txt", "other.txt", "sub/a.txt", "odd [x] *.txt", "50%+.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(f"text of {p}")
    names = spark.createDataFrame([(k, n) for k, n in enumerate(["a.txt", "sub/a.txt", "odd [x] *.txt", "50%+.txt", "absent.txt", "none/at.txt"])], "seq int, file string")
    found = files.whole_texts(spark, str(tmp_path), names)
    assert {r.file: r.text for r in found.collect()} == {p: f"text of {p}" for p in ("a.txt", "sub/a.txt", "odd [x] *.txt", "50%+.txt")}
    assert "other.txt" not in " ".join(found.inputFiles())
    assert files.whole_texts(spark, str(tmp_path / "nowhere"), names).collect() == []


class Counting:
    """A model that writes down every call, and fails on some."""

    model, provider = "m", "p"

    def __init__(self, folder, failing=""):
        self.folder, self.failing = folder, failing

    def complete(self, prompt, system=None, json_mode=False):
        import uuid
        from pathlib import Path

        (Path(self.folder) / uuid.uuid4().hex).write_text(prompt)
        if self.failing and self.failing in prompt:
            raise RuntimeError("not now")
        return f"said {len(prompt)}"


def calls(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def test_replies_as_a_table(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    log = tmp_path / "calls"
    log.mkdir()
    cache = TableCache(spark, str(tmp_path / "replies"))
    ask = lambda prompts, failing="": {(r.n, r.r.text if r.r else None, r.r.error if r.r else None) for r in answering.replied(spark.createDataFrame(list(enumerate(prompts)), "n int, prompt string"), "prompt", Counting(str(log), failing), "sys", cache).collect()}
    first = ask(["one", "two", "two", None, "bad"], "bad")
    assert first == {(0, "said 3", ""), (1, "said 3", ""), (2, "said 3", ""), (3, None, None), (4, None, "RuntimeError: not now")}
    assert calls(log) == ["bad", "one", "two"]
    assert ask(["two", "one", "bad"]) == {(0, "said 3", ""), (1, "said 3", ""), (2, "said 3", "")}
    assert calls(log) == ["bad", "bad", "one", "two"]  # what failed is asked again, what is known is not
    cache.compact()
    cache.compact()
    assert cache.replies().count() == 3 and ask(["one", "two", "bad"]) == {(0, "said 3", ""), (1, "said 3", ""), (2, "said 3", "")}
    assert len(calls(log)) == 4
    assert {p.name for p in (tmp_path / "replies").iterdir()} == {"v00000002"}


def test_a_stopped_evaluation_goes_on(spark, built, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    d, e, raw = built
    e.ingest(raw)
    log = tmp_path / "calls"
    log.mkdir()
    items = [{"id": f"exa-0{k}", "type": "example", "question": f"Which risks does {n} fear?", "expected_tickers": [t], "expected_sections": [], "expected_years": []} for k, (t, n) in enumerate([("AA", "Alpha"), ("BB", "Beta"), ("CC", "Gamma")])]
    (tmp_path / "items.json").write_text(json.dumps(items))
    asked = files.read_items(spark, str(tmp_path / "items.json"))
    own = lambda failing="": Engine(spark, str(d / "out"), Settings(embed_dim=16), generator=Counting(str(log), failing))

    class Stopped(Engine):
        def evaluate(self, some, judged=True):
            if "exa-02" in {r.id for r in some.collect()}:
                raise KeyboardInterrupt
            return super().evaluate(some, judged)

    out = str(tmp_path / "results")
    with pytest.raises(KeyboardInterrupt):
        Stopped(spark, str(d / "out"), Settings(embed_dim=16), generator=Counting(str(log), "Beta")).evaluate_into(asked, out, batch=1)
    assert len(calls(log)) == 2 and {r.id for r in files.done_results(spark, out).collect()} == {"exa-00"}
    assert own().evaluate_into(asked, out) == 2 and len(calls(log)) == 4  # the failed and the open one
    assert own().evaluate_into(asked, out) == 0 and len(calls(log)) == 4
    schema = own().evaluate(asked.limit(0)).schema
    rows_ = files.read_results(spark, out, schema)
    assert rows_.count() == 4 and {(r.id, r.error or "") for r in files.settled(rows_).collect()} == {(f"exa-0{k}", "") for k in range(3)}


def test_hits_are_found_once(spark, built):
    """What follows a search rests on written hits: neither the index nor the embedder is asked again."""
    _, e, raw = built
    e.ingest(raw)
    found = e.retrieve(["Which risks does Alpha fear?"])
    for d in (found.hits, found.gaps, found.notes):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEval" not in plan and "postings" not in plan


def test_searches_are_pruned_by_ticker(spark, built):
    from filigree.operators import search

    _, e, raw = built
    e.ingest(raw)
    q = spark.createDataFrame([(0, "AA", "storms", [], [], None, [0.0] * 16)], "sq int, ticker string, query string, sections array<string>, periods array<string>, fiscal_year int, vector array<float>")
    hits = search.relaxed(q, e.store.read("chunks"), e.store.read("postings"), e.store.read("idf"), e.store.read("stats"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("dynamicpruning") >= 2
    assert {r.id.split("-")[0] for r in hits.collect()} == {"AA"}


def test_postings_are_made_where_chunks_lie(spark, tmp_path):
    """Postings of an update are counted without a shuffle, lie by term in every file, and sizes of tickers follow from them."""
    texts = {f"{t}-{k}": " ".join(f"w{(k * j) % 23}" for j in range(k % 9)) for t in "ABC" for k in range(40)}
    store = IndexStore(spark, str(tmp_path / "p"))
    store.update(rows(spark, texts))
    c = store.read("chunks")
    post = index.counts(c.select("id", F.split("text", " ").alias("terms"), "ticker"))
    assert post.columns == ["id", "dl", "term", "tf", "ticker"] and "Exchange" not in post._jdf.queryExecution().executedPlan().toString()
    cols = ("term", "id", "tf", "dl")
    assert sorted(map(tuple, store.read("postings").select(*cols).collect())) == sorted(map(tuple, index.postings(c).select(*cols).collect()))
    for f in (tmp_path / "p").glob("*/postings/ticker=*/*.parquet"):
        terms = [r.term for r in spark.read.parquet(str(f)).collect()]
        assert terms == sorted(terms)
    dl = {r.id: (r.ticker, r.dl) for r in store.read("postings").collect()}
    want = {t: (sum(x == t for x, _ in dl.values()), sum(n for x, n in dl.values() if x == t)) for t in "ABC"}
    assert {r.ticker: (r.n_docs, r.total) for r in store.read("sizes").collect()} == want
