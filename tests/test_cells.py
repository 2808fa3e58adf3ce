"""The inverted file of cells against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.operators import search
from filigree.operators.cells import Cells


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    r = np.random.default_rng(2)
    centres = r.standard_normal((60, 24))
    v = centres[r.integers(0, 60, 4000)] + 0.35 * r.standard_normal((4000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(f"r{k:04d}", x.astype(np.float32).tolist()) for k, x in enumerate(v)] + [("none", None)], "id string, embedding array<float>")
    asked = spark.createDataFrame([(k, (v[k * 71] + 0.1 * r.standard_normal(24) / 5).astype(np.float32).tolist()) for k in range(50)], "qid int, vector array<float>")
    cells = Cells.fit(rows, k=64)
    path = str(tmp_path_factory.mktemp("cells") / "rows")
    cells.placed(rows).write.partitionBy("cell").parquet(path)
    return rows, asked, cells, spark.read.parquet(path)


def best(found, k=20):
    out = {}
    for r in search.ranked(found, ["qid"], k, "place").orderBy("qid", "place").collect():
        out.setdefault(r.qid, []).append(r.id)
    return out


def exact(asked, rows, k=20):
    out = {}
    for r in search.dense_topk(asked, rows, k).orderBy("qid", "dense_rank").collect():
        out.setdefault(r.qid, []).append(r.id)
    return out


def test_all_cells_are_exact(data):
    rows, asked, cells, placed = data
    assert best(cells.topk(asked, placed, 20, 64)) == exact(asked, rows)


def test_recall_and_pruning(data):
    """An eighth of the cells finds 95 % of the best 20, and the plan reads the probed cells alone."""
    rows, asked, cells, placed = data
    want, got = exact(asked, rows), best(cells.topk(asked, placed, 20, 8))
    recall = np.mean([len(set(want[q]) & set(got[q])) / 20 for q in want])
    assert recall >= 0.95
    plan = cells.topk(asked.where("qid = 3"), placed, 20, 8)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_small_and_empty(spark, data):
    rows, asked, cells, placed = data
    one = Cells.fit(rows.limit(0))
    assert one.topk(asked, one.placed(rows.limit(0)), 5, 3).collect() == []
    few = rows.where(F.col("id") < "r0003")
    alone = Cells.fit(few)
    assert best(alone.topk(asked, alone.placed(few), 2, 99), 2) == exact(asked, few, 2)
    assert cells.topk(asked.limit(0), placed, 5, 3).collect() == []
