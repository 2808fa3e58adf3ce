import random

import pytest
from brute import components

from filigree.llm import chosenpath
from filigree.llm.components import connected_components
from filigree.llm.scratch import Scratch

SCHEMA = "doc_id bigint, text string, fp int, set string"  # two columns whose names the operator uses inside


def near_copies(seed, groups=12, size=9):
    r = random.Random(seed)
    rows, n = [], 0
    for g in range(groups):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(3, 120))]
        for _ in range(r.randrange(1, size)):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
            rows.append((n, " ".join(w)))
            n += 1
    r.shuffle(rows)
    return rows


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], SCHEMA)
    return chosenpath.similarity_components(docs, **kw).collect()


def check(got, rows, width, hundredths):
    want = components(rows, width, hundredths)
    assert {(r.id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, n, c, i == c) for i, (n, c) in want.items()}


@pytest.mark.parametrize("seed,width,hundredths", [(1, 3, 85), (2, 5, 80)])
def test_as_brute_force(spark, seed, width, hundredths):
    rows = near_copies(seed) + [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "One"), (905, "one two"), (906, "x" * 50_000)]
    check(run(spark, rows, width=width, hundredths=hundredths), rows, width, hundredths)


def test_groups_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(chosenpath, "BLOCK", 4)
    monkeypatch.setattr(chosenpath, "LEAF", 3)
    monkeypatch.setattr(chosenpath, "HUBS", 2)
    rows = near_copies(5, groups=3, size=60)
    check(run(spark, rows, width=3, hundredths=85), rows, 3, 85)


def test_empty_and_repeated(spark):
    assert run(spark, []) == []
    got = run(spark, [(7, "a b c d e f"), (7, "a b c d e f"), (3, "A B C D E F"), (None, "a b c d e f")])
    assert sorted((r.id or 0, r.component_id, r.kept) for r in got) == [(0, 3, False), (3, 3, True), (7, 3, False), (7, 3, False)]


def test_deduplicate(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "other words stand in this text"), (3, "other words stand in this text"), (4, None), (None, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], SCHEMA)
    out = chosenpath.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3, 4]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {(r.node, r.component) for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert got == {(k, 0) for k in range(41)} | {(k, 100) for k in range(100, 140)} | {(200, 200), (201, 200)}
    assert connected_components(df.limit(0), Scratch(spark, "t")).collect() == []


def test_long_chains_in_any_order(spark):
    """Paths, whose labels travel farthest, end whole: no number of steps cuts them."""
    r = random.Random(3)
    names = list(range(1000))
    r.shuffle(names)
    df = spark.createDataFrame([(names[k], names[k + 1]) for k in range(999)], "a bigint, b bigint")
    got = connected_components(df, Scratch(spark, "t")).collect()
    assert len(got) == 1000 and {x.component for x in got} == {0}


def test_loose_groups_stay_in_proportion(spark, monkeypatch):
    """Texts of one template that are alike but not linked: candidates all, yet full sets are compared about once each."""
    monkeypatch.setattr(chosenpath, "BLOCK", 16)
    compared, plain = [], chosenpath._compared
    monkeypatch.setattr(chosenpath, "_compared", lambda rows, *a: compared.append(rows.count()) or plain(rows, *a))
    r = random.Random(2)
    base = [f"w{r.randrange(3000)}" for _ in range(120)]
    rows = [(k, " ".join(x if r.random() > 0.06 else f"x{r.randrange(10**6)}" for x in base)) for k in range(240)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(5)]  # links that must not be lost
    took = []
    for n in (120, 240):
        compared.clear()
        part = [x for x in rows if x[0] < n or x[0] >= 1000]
        check(run(spark, part, width=3, hundredths=85), part, 3, 85)
        took.append(sum(compared))
    assert took[1] < 2.6 * took[0] and took[1] < 4 * 240, took


def compared(spark, rows, monkeypatch):
    """Sets and shingles of each task that the operator compares, and its rows."""
    tasks = []
    whole = chosenpath._compared

    def seen(sets, hundredths, parts):
        from pyspark.sql import functions as F

        tasks.extend((r.n, r.load) for r in sets.groupBy("task").agg(F.count("*").alias("n"), F.sum(F.octet_length("set") / 8).alias("load")).collect())
        return whole(sets, hundredths, parts)

    monkeypatch.setattr(chosenpath, "_compared", seen)
    return run(spark, rows, width=3, hundredths=85), tasks


def test_repeated_rows_bring_one_set(spark, monkeypatch):
    """2,000 rows of one id and text and a near copy are two sets to compare."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(7, text)] * 2000 + [(8, text + " w60")]
    got, tasks = compared(spark, rows, monkeypatch)
    assert tasks == [(2, 58 + 59)]
    assert {(r.id, r.component_id, r.kept) for r in got} == {(7, 7, True), (8, 7, False)} and len(got) == 2001


def test_tasks_are_bounded_by_shingles(spark, monkeypatch):
    """Long near copies are dealt to blocks by what they hold; the links are the same."""
    monkeypatch.setattr(chosenpath, "LOAD", 3000)
    monkeypatch.setattr(chosenpath, "HUBS", 2)
    r = random.Random(4)
    base = [f"w{k}" for k in range(500)]
    rows = []
    for k in range(40):
        w = list(base)
        w[r.randrange(500)] = f"x{k}"
        rows.append((k, " ".join(w)))
    got, tasks = compared(spark, rows, monkeypatch)
    check(got, rows, 3, 85)
    assert max(load for _, load in tasks) < 3 * 3000 + 2 * 500
