"""Blocked search against plain loops, and steps that must stay in proportion to their input."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.functions import parsing
from filigree.operators import blocks, impact, index, search
from filigree.sources.scratch import Scratch, shared_dir


def ranks(scored, k):
    """{qid: ids by score to six places, then id}."""
    return {q: [i for _, i in sorted((-round(s, 6), i) for i, s in rows.items())[:k]] for q, rows in scored.items()}


@pytest.mark.parametrize("sizes", [(4096, 1024), (7, 3)])
def test_dense_blocks_as_a_loop(spark, monkeypatch, sizes):
    monkeypatch.setattr(blocks, "VECTORS", sizes[0])
    monkeypatch.setattr(blocks, "ASKED_VECTORS", sizes[1])
    r = np.random.default_rng(4)
    v = r.standard_normal((150, 6)).astype(np.float32)
    v[40:120] = v[40]  # many ties
    q = [*v[[3, 41, 130]], *r.standard_normal((8, 6)).astype(np.float32)]
    rows = spark.createDataFrame([(f"r{k:03d}", x.tolist()) for k, x in enumerate(v)] + [("none", None)], "id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)] + [(99, None)], "qid int, vector array<float>")
    want = ranks({k: {f"r{i:03d}": float(np.dot(x.astype(float), y.astype(float))) for i, y in enumerate(v)} for k, x in enumerate(q)}, 5)
    got = {}
    for x in search.dense_topk(asked, rows, 5).orderBy("qid", "dense_rank").collect():
        got.setdefault(x.qid, []).append(x.id)
    assert got == want
    assert search.dense_topk(asked.limit(0), rows, 5).collect() == [] and search.dense_topk(asked, rows.limit(0), 5).collect() == []


@pytest.mark.parametrize("sizes", [(1024, 256, 1 << 20), (5, 2, 40)])
def test_sparse_blocks_as_a_loop(spark, monkeypatch, sizes):
    for name, size in zip(("TEXTS", "ASKED_TEXTS", "TERMS"), sizes):
        monkeypatch.setattr(blocks, name, size)
    r = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    texts = {f"c{k:03d}": r.choices(words, weights=range(1, 41), k=r.randrange(0, 60)) for k in range(90)} | {f"d{k}": ["w1", "w2"] for k in range(30)}
    asked = {k: r.choices([*words, "unknown"], k=r.randrange(1, 9)) for k in range(7)} | {50: ["unknown"], 51: ["w1"]}
    bags = spark.createDataFrame(list(texts.items()), "id string, terms array<string>").repartition(3)
    queries = spark.createDataFrame([(q, " ".join(t)) for q, t in asked.items()], "qid bigint, query string")
    stats = index.corpus_stats(bags)
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    df = Counter(w for t in texts.values() for w in set(t))
    raw = {w: math.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    scored = {}
    for q, terms in asked.items():
        for i, t in texts.items():
            tf = Counter(t)
            s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in terms if w in tf)
            if s > 0:
                scored.setdefault(q, {})[i] = s
    got = {}
    for x in search.sparse_topk(queries, bags, index.idf(bags, stats), stats, 6).orderBy("qid", "bm25_rank").collect():
        got.setdefault(x.qid, []).append(x.id)
    assert got == ranks(scored, 6)
    post = index.postings(bags)
    assert {r.term: round(r.idf, 9) for r in index.idf(post, stats).collect()} == {w: round(x, 9) for w, x in idf.items()}
    only = queries.select(F.explode(F.split("query", " ")).alias("term"))
    assert {r.term for r in index.postings(bags, only=only).collect()} == {w for t in asked.values() for w in t if w in df}


@pytest.mark.parametrize("block,shard,first", [(128, 65_536, 8), (4, 50, 2), (1, 7, 1)])
def test_impact_index_as_a_loop(spark, monkeypatch, block, shard, first):
    """The impact-ordered index finds what reading everything finds, terms of negative weight included."""
    for name, size in zip(("BLOCK", "SHARD", "FIRST"), (block, shard, first)):
        monkeypatch.setattr(impact, name, size)
    r = random.Random(block)
    words = [f"w{k}" for k in range(60)]
    texts = {f"c{k:03d}": r.choices(words, weights=[1 / (1 + j) for j in range(60)], k=r.randrange(0, 50)) for k in range(150)} | {f"d{k}": ["w1", "w2"] for k in range(30)}
    asked = {k: r.choices([*words, "unknown"], k=r.randrange(1, 12)) for k in range(9)} | {50: ["unknown"], 51: ["w1"], 52: ["w0"]}
    bags = spark.createDataFrame([*texts.items(), ("null", None)], "id string, terms array<string>").repartition(3)
    queries = spark.createDataFrame([(q, " ".join(t)) for q, t in asked.items()], "qid bigint, query string")
    stats = index.corpus_stats(bags.where("terms is not null"))
    blocks_ = Scratch(spark, "b").keep(impact.build(impact.counts(bags), stats), "blocks")
    assert {(x.term, i): round(g, 9) for x in blocks_.collect() for i, g in zip(x.ids, x.gains)} == {
        (w, i): round(n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(t) * len(texts) / sum(map(len, texts.values())))), 9) for i, t in texts.items() for w, n in Counter(t).items()
    }
    assert all(x.gains == sorted(x.gains, reverse=True) and x.top == x.gains[0] and len(x.ids) <= block for x in blocks_.collect())
    idf = index.idf(blocks_, stats)
    assert {x.term: round(x.idf, 9) for x in idf.collect()} == {x.term: round(x.idf, 9) for x in index.idf(bags, stats).collect()}
    for weights in (idf, idf.withColumn("idf", F.when(F.col("term").isin("w3", "w1"), -0.4).otherwise(F.col("idf")))):
        for k in (1, 6):
            want = [tuple(x) for x in search.sparse_topk(queries, bags, weights, stats, k).select("qid", "id", F.round("score", 6), "bm25_rank").collect()]
            got = [tuple(x) for x in search.sparse_topk(queries, bags, weights, stats, k, blocks_).select("qid", "id", F.round("score", 6), "bm25_rank").collect()]
            assert sorted(got) == sorted(want)


def test_impact_index_reads_few_blocks(spark):
    """Blocks that cannot hold one of the best stay unread, and the ranks are those of reading everything."""
    r = random.Random(5)
    common, rare = [f"c{k}" for k in range(250)], [f"r{k}" for k in range(3000)]
    bags = spark.createDataFrame([(f"t{k:05d}", r.choices(common, k=60) + r.choices(rare, k=8)) for k in range(6000)], "id string, terms array<string>").repartition(4)
    queries = spark.createDataFrame([(q, " ".join(r.choices(common, k=8) + r.choices(rare, k=4))) for q in range(12)], "qid bigint, query string")
    scratch = Scratch(spark, "b")
    stats = scratch.keep(index.corpus_stats(bags), "stats")
    blocks_ = scratch.keep(impact.build(impact.counts(bags), stats), "blocks")
    counted = {}
    found = search.ranked(impact.sparse_best(queries, bags, blocks_, index.idf(blocks_, stats), stats, 10, counted=counted), ["qid"], 10, "rank")
    want = search.sparse_topk(queries, bags, index.idf(bags, stats), stats, 10)
    assert sorted((x.qid, x.id, x.rank) for x in found.collect()) == sorted((x.qid, x.id, x.bm25_rank) for x in want.collect())
    assert counted["read"] * 3 < counted["all"] * 2


def test_headers_of_many_lines(spark):
    """A text without a rule is all header; twice the lines must not take four times as long."""
    took = []
    for n in (20_000, 40_000):
        d = spark.createDataFrame([("".join(f"Key {k % (n // 2)}: v{k}\n" for k in range(n)),)], "t string")
        began = time.time()
        m = d.select(parsing.header_map(F.col("t")).alias("m")).first().m
        took.append(time.time() - began)
        assert len(m) == n // 2 and m["Key 7"] == f"v{n // 2 + 7}"
    assert took[1] < 2.3 * took[0] + 1


def test_scratch_tables_go(spark, tmp_path):
    with Scratch(spark, "t") as s:
        kept = s.keep(spark.range(3), "a")
        assert kept.count() == 3
        base = s.base.removeprefix("file://")
    import os

    assert not os.path.exists(base) and shared_dir(spark) in s.base


def test_no_local_scratch_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())


def test_scored_pairs_without_a_row_for_each_term(spark):
    """Exact scores of chosen pairs, a block of texts at a time, are those of postings joined by term; the plan explodes no terms of texts."""
    r = random.Random(3)
    bags = spark.createDataFrame([(f"t{k}", r.choices([f"w{j}" for j in range(12)], k=k % 20)) for k in range(90)] + [("none", None)], "id string, terms array<string>").repartition(3)
    queries = spark.createDataFrame([(q, " ".join(f"w{r.randrange(14)}" for _ in range(5))) for q in range(7)], "qid bigint, query string")
    pairs = spark.createDataFrame([(q, f"t{k}") for q in range(7) for k in range(90) if (q + k) % 4 == 0] + [(1, "none")], "qid bigint, id string")
    stats = index.corpus_stats(bags.where("terms is not null"))
    post = index.postings(bags)
    idf = index.idf(post, stats)
    got = blocks.scored_pairs(pairs, bags, blocks.term_weights(queries, idf), stats)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join Cross")[0]
    want = {(x.qid, x.id): round(x.score, 9) for x in search.sparse_scores(queries, post, idf, stats).join(pairs, ["qid", "id"]).collect()}
    have = {(x.qid, x.id): round(x.score, 9) for x in got.collect()}
    assert {k: v for k, v in have.items() if v} == {k: v for k, v in want.items() if v} and all(k not in want or have[k] == v for k, v in want.items())


def test_batches_for_python_are_bounded_in_bytes(spark):
    """Rows that are whole blocks come a few at a time where the session leaves Spark's default; a caller's own bound stays."""
    from filigree import runtime

    own = spark.newSession()
    assert own.conf.get(runtime.BYTES) == runtime.SPARKS
    runtime.ship(own)
    assert own.conf.get(runtime.BYTES) == runtime.OURS
    own.conf.set(runtime.BYTES, "1m")
    runtime.ship(own)
    assert own.conf.get(runtime.BYTES) == "1m"
