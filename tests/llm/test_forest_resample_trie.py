"""Operators 11, 12 and 13 against plain Python readings of their contracts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import LOWER

from filigree.llm import importance, prefixtrie, ranks, rpforest
from filigree.llm.scratch import Scratch

# ---- 11: vectors


def links_of(rows, cosine=0.9):
    """{row number: (n_links, component)} by comparing every two vectors."""
    good = {}
    for r, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, np.float32).astype(float)
            u /= np.abs(u).max()
            good[r] = u / np.sqrt(u @ u)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = Counter()
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
                n[a] += 1
                n[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    low = defaultdict(lambda: math.inf)
    for r, (i, _) in enumerate(rows):
        low[find(r)] = min(low[find(r)], math.inf if i is None else i)
    return sorted(((i, n[r], None if low[find(r)] == math.inf else low[find(r)]) for r, (i, _) in enumerate(rows)), key=repr)


def vectors(seed, n=300, dim=16):
    r = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        v = r.standard_normal(dim)
        for _ in range(int(r.choice([1, 1, 2, 5, 60]))):
            rows.append((len(rows), (v + r.uniform(0, 0.4) * r.standard_normal(dim)).astype(np.float32).tolist()))
    rows += [(5, rows[5][1]), (None, rows[5][1]), (None, rows[9][1]), (900, None), (901, []), (902, [0.0] * dim), (903, [float("nan")] * dim), (904, [float("inf")] + [1.0] * (dim - 1)), (905, [None] * dim)]
    rows += [(906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e-38] * dim), (909, [3e38] * dim), (None, [1.0, -3.0, 0.5])]
    return rows


def forest(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, links int, fp string")
    got = rpforest.cosine_components(df, **kw).collect()
    assert all(r.kept == (r.id == r.component_id) for r in got)
    return sorted(((r.id, r.n_links, r.component_id) for r in got), key=repr)


@pytest.mark.parametrize("leaf,tile,own", [(512, 4096, 11), (16, 4096, 11), (16, 20, 2)])
def test_vectors_as_brute_force(spark, monkeypatch, leaf, tile, own):
    monkeypatch.setattr(rpforest, "LEAF", leaf)
    monkeypatch.setattr(rpforest, "TILE", tile)
    monkeypatch.setattr(rpforest, "OWN", own)
    rows = vectors(leaf + tile)
    assert forest(spark, rows) == links_of(rows)


def test_recall_of_pairs_at_the_threshold(spark, monkeypatch):
    """2,000 pairs of cosine just over 0.9 in 64 dimensions, in leaves of few vectors."""
    monkeypatch.setattr(rpforest, "LEAF", 32)
    r = np.random.default_rng(3)
    rows = []
    for i in range(2000):
        a, b = r.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.901 * a + math.sqrt(1 - 0.901**2) * b).tolist())]
    got = {i: c for i, _, c in forest(spark, rows)}
    assert sum(got[2 * i + 1] == 2 * i for i in range(2000)) >= 1998


def test_no_vectors(spark):
    assert forest(spark, []) == []


def test_equal_vectors_meet_no_one_task(spark):
    """A third of all rows with one vector is one node before anything is compared."""
    rows = vectors(8, n=60) + [(1000 + k, vectors(8, n=60)[3][1]) for k in range(400)]
    assert forest(spark, rows) == links_of(rows)


# ---- 12: resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def resampled(docs, target):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    rows = []
    for k, (i, x) in enumerate(docs):
        n, f = features(x)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((k, n, i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[5], math.inf if r[2] is None else r[2], r[3]))
    rank = {r[0]: p + 1 for p, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(((*r[2:], rank.get(r[0])) for r in rows), key=repr)


def texts(seed, n=120):
    r = random.Random(seed)
    some = ["Wort", "ÄPFEL", "naïve", "x1", "7", "B", "日本", "aİ", "𝒳y", "ﬁ"]
    rows = [(k, "".join(r.choice(some) + r.choice([" ", ", ", "-", "\n\t", "_"]) for _ in range(r.randrange(0, 90)))) for k in range(n)]
    return rows + [(500, None), (501, ""), (502, " .,- "), (503, "solo"), (None, "eins zwei drei " * 9), (None, None), (7, rows[7][1]), (7, "ganz anders " * 15), (504, "lang " * 60_000)]


def test_resampling_as_brute_force(spark):
    docs, target = texts(1), [x for _, x in texts(2, 20)]
    d = spark.createDataFrame([(i, x, 1, 2) for i, x in docs], "doc_id bigint, text string, score int, buckets int")
    b = spark.createDataFrame([(x, "s") for x in target], "text string, rank string")
    got = importance.resample(d, b).collect()
    assert sorted((tuple(r) for r in got), key=repr) == resampled(docs, target)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "one two three")], "doc_id bigint, text string")
    assert importance.resample(none, some).collect() == []
    assert [tuple(r) for r in importance.resample(some, none).collect()] == [t for t in resampled([(1, "one two three")], [])]


def test_scoring_does_not_explode(spark, small):
    """Features become rows only where totals are counted, each before a partial sum."""
    own = Scratch(spark, "t").keep(importance.featured(spark.read.parquet(f"{small}/documents.parquet"), "text"), "buckets")
    scored = own.select(importance.weight(own.buckets, [1] * importance.BUCKETS).alias("w"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Generate|Exchange|split", plan)  # and the gains are one literal


def test_equal_rows_are_split_over_partitions(spark):
    """A rank over rows that are all equal does not gather them in one partition."""
    from pyspark.sql import functions as F

    df = spark.range(4000, numPartitions=4).select(F.lit(1).alias("a"))
    placed = ranks.in_order(df, [F.col("a")], Scratch(spark, "t"), "t")
    assert placed.groupBy("part").count().agg(F.max("count")).first()[0] < 2000
    assert sorted(r.rank for r in ranks.numbered(df, [F.col("a")], Scratch(spark, "t"), "t").collect()) == list(range(1, 4001))


# ---- 13: prefix trie

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    paths = {c: own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in own.items()}
    members, children = defaultdict(set), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].add(c)
    saved, leaves = Counter(), Counter()
    for n in members:
        if n:
            children[n[:-1]].add(n)
    for n in members:
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(members[n]) - 1) * len(TOKEN.findall(n[-1][1])) if n else 0
            leaves[n[:d]] += not children[n]
    ends = lambda n: hashlib.sha256(",".join(map(str, sorted(c for c in members[n] if len(paths[c]) == len(n)))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], ends(n)) for n, m in members.items()), key=repr)


def talks(seed, n=90):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if r.random() < 0.25:
            continue
        for t in range(r.choice([1, 1, 2, 3, 4, 7, 30])):
            rows.append((c, r.choice([t, t, None]), r.choice(["user", None, ""]), r.choice([f"say {r.randrange(2)}", f"two  words\t{t % 2}", "", None])))
    rows += [(200 + 20 * (k // 9) + k % 9 + 1, t, "user", f"same {t}") for k in range(60) for t in range(6)]  # without bases
    rows += [(None, 0, "user", "no conversation"), rows[0], rows[0], (5, 2, "user", "tie"), (5, 2, "user", "tie too"), (5, 2, "bot", "tie")]
    r.shuffle(rows)
    return rows


def run_trie(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, c int")
    return sorted((tuple(r) for r in prefixtrie.prefix_trie(df).collect()), key=repr)


@pytest.mark.parametrize("seed,block,hot,ids", [(1, 4096, 20_000, 4096), (2, 3, 5, 2)])
def test_trie_as_brute_force(spark, monkeypatch, seed, block, hot, ids):
    monkeypatch.setattr(prefixtrie, "BLOCK", block)
    monkeypatch.setattr(prefixtrie, "HOT", hot)
    monkeypatch.setattr(prefixtrie, "IDS", ids)
    rows = talks(seed)
    assert run_trie(spark, rows) == trie(rows)


def test_trie_of_nothing(spark):
    assert run_trie(spark, []) == [] == run_trie(spark, [(None, 1, "user", "x")])


def test_turnless_conversations(spark):
    """A conversation that gives up its own turns and has no base is a member of the root alone."""
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone"), (c, 1, "bot", "gone too")]
    assert run_trie(spark, rows) == trie(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
