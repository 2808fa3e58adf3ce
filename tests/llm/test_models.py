import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filigree.llm import langkernel, lsavotes, piecefst, queries

SAY = {"aa": "the house and the tree with water", "bb": "der baum und das haus mit wasser", "cc": "la maison et un arbre avec eau"}


def sentences(n=90):
    r = random.Random(4)
    return [(k, " ".join(r.choices(SAY[lang].split(), k=r.randrange(4, 30))), lang) for k, lang in ((k, list(SAY)[k % 3]) for k in range(n))]


def test_language_kernel(spark):
    docs = spark.createDataFrame([*sentences(), (500, None, "aa"), (501, "!!! 123", "aa"), (502, "tree", None)], "doc_id bigint, text string, lang string")
    model = langkernel.fit(docs.where("doc_id < 60 or doc_id >= 500"))
    out = {r.doc_id: r.p for r in docs.select("doc_id", model.predict(spark, F.col("text")).alias("p")).collect()}
    assert all(out[k].lang == lang for k, _, lang in sentences())
    assert out[500].lang == out[501].lang == "und" and out[500].score == 0 and all(0 <= p.score <= 1 for p in out.values())
    none = langkernel.fit(docs.limit(0))
    assert docs.select(none.predict(spark, F.col("text"))["lang"]).distinct().collect()[0][0] == "und"


def test_folded_scores_are_the_kernel_scores():
    """One matrix gives the same as kernel values against landmarks times ridge weights."""
    texts = pa.array([t for _, t, _ in sentences(20)])
    data, ends = langkernel.utf8(texts)
    x = langkernel.presence(data, ends, 0, 20).astype(float)
    z = x[:5]
    k = (x @ z.T) / np.sqrt(x.sum(1))[:, None] / np.sqrt(z.sum(1))[None, :]
    w = np.random.default_rng(0).standard_normal((5, 2))
    folded = (z / np.sqrt(z.sum(1))[:, None]).T @ w
    got = langkernel.kernel_scores(texts, folded.astype(np.float32), np.zeros(2, np.float32))
    assert np.allclose(got, k @ w, atol=1e-4)
    grams = {t[i : i + n] for t in [texts[0].as_py()] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)}
    assert 0.9 * len(grams) <= x[0].sum() <= len(grams)


def test_held_out_languages_of_the_small_tables(spark, small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    held = [r for r in queries.op9_language_kernel(spark, small).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def test_votes(spark):
    rows = [(k, "good plain words stand here in order" if k % 2 else "### $$$ ||| ### $$$ |||", k % 2) for k in range(60)]
    docs = spark.createDataFrame([(k, f"{t} {k}") for k, t, _ in rows] + [(900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    model = lsavotes.fit(docs, labels, where=F.col("id") < 40)
    got = {r.doc_id: r.s for r in docs.select("doc_id", model.score(spark, F.col("text")).alias("s")).collect()}
    assert all((got[k] >= 0.3) == bool(y) for k, _, y in rows) and all(0 <= s <= 1 for s in got.values()) and 900 in got
    for few in (labels.limit(0), labels.where("quality = 1")):
        flat = lsavotes.fit(docs, few)
        assert docs.select(flat.score(spark, F.col("text"))).distinct().collect()[0][0] == 1.0


def test_votes_are_exact(spark):
    """Blocked products and partial sorting give the votes of a plain loop."""
    r = np.random.default_rng(1)
    vectors = r.standard_normal((200, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels, weights = r.integers(0, 2, 200).astype(float), r.random(200)
    axes = r.standard_normal((lsavotes.TERMS, 8)).astype(np.float32)
    idf = np.ones(lsavotes.TERMS, np.float32)
    texts = pa.array([t for _, t, _ in sentences(30)])
    got = lsavotes.votes(texts, idf, axes, vectors, labels, weights, 0.5)
    data, ends = lsavotes.utf8(texts)
    for k in range(30):
        q = lsavotes.project(lsavotes._counts(data, ends, k, k + 1), idf, axes)[0]
        sims = vectors @ q
        top = sorted(range(200), key=lambda i: -sims[i])[: lsavotes.VOTERS]
        w = [max(float(sims[i]), 0) ** 8 * weights[i] for i in top]
        assert got[k] == pytest.approx(sum(a * labels[i] for a, i in zip(w, top)) / sum(w), rel=1e-3)


@pytest.fixture(scope="module")
def model():
    public = pytest.importorskip("public_tokenizers")
    return str(public.path("piece_bpe_32k.model"))


def test_pieces_as_the_library(model):
    spm = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model)
    with open(model, "rb") as f:
        machine = piecefst.PieceTransducer(f.read())
    r = random.Random(8)
    parts = ["the", "ing", " ", "  ", "    ", "\n", "\t", "é", "ß", "😀", "日本", "▁", "un", "stand", "00", "==", "____", ".", "A", "", "　"]
    texts = ["".join(r.choices(parts, k=r.randrange(0, 25))) for _ in range(1500)]
    flat, ends = machine.encode_all([*texts, None])
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [*spm.encode(texts), []]
    assert all(machine.encode(t) == spm.encode(t) for t in texts[:300])
    assert all(machine.decode(ids) == spm.decode(ids) for ids in spm.encode(texts))


def test_unigram_paths_are_the_lightest():
    """A made-up unigram model against trying every segmentation."""
    import struct

    def field(n, kind, payload):
        return bytes([n << 3 | kind]) + payload

    def piece(p, score, kind=1):
        body = field(1, 2, bytes([len(p.encode())]) + p.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    scores = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -4.5, "ba": -5.0, "aba": -8.5}
    raw = piece("<unk>", 0, 2) + b"".join(piece(p, s) for p, s in scores.items()) + field(3, 2, bytes([4]) + field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    machine = piecefst.PieceTransducer(raw)

    def best(s):
        return max((scores[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in scores), default=0.0) if s else 0.0

    for t in ("ab", "aba", "abab", "bb aab", "baab a"):
        ids = machine.encode(t)
        assert sum(scores[machine.pieces[i]] for i in ids) == pytest.approx(best("▁" + t.replace(" ", "▁")))
        assert machine.decode(ids) == t


def test_round_trip_in_spark(spark, small, model):
    out = queries.op10_piece_fst(spark, small, model).collect()
    assert len(out) == 200 and all(r.round_trip and r.n_pieces == len(r.ids) for r in out)
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    ids = docs.select("doc_id", piecefst.encoder(spark, model)(F.col("text")).alias("ids"))
    assert [r.ids for r in ids.orderBy("doc_id").collect()] == [[], []]
    assert [r[0] for r in ids.select(piecefst.decoder(spark, model)(F.col("ids"))).collect()] == ["", ""]


def test_nystrom_and_ridge_as_the_exact_kernel_machine(spark):
    """With every text a landmark the model is kernel ridge regression, here solved in its dual form."""
    rows = sentences(60)
    model = langkernel.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    grams = lambda texts: langkernel.presence(*langkernel.utf8(pa.array(texts)), 0, len(texts)).astype(float)
    unit = lambda x: x / np.sqrt(x.sum(1, keepdims=True))
    x, new = unit(grams([t for _, t, _ in rows])), [t for _, t, _ in sentences(120)[60:]]
    kernel = x @ x.T + 1  # the bias is one more feature
    weight = np.array([len(rows) / (3 * sum(u == lang for _, _, u in rows)) for _, _, lang in rows])
    target = np.array([[1.0 if lang == n else -1.0 for n in model.languages] for _, _, lang in rows])
    alpha = np.linalg.solve(kernel + langkernel.RIDGE * len(rows) * np.diag(1 / weight), target)
    want = (unit(grams(new)) @ x.T + 1) @ alpha
    got = langkernel.kernel_scores(pa.array(new), model.weights, model.bias)
    assert np.allclose(got, want, atol=5e-3)


def test_languages_of_repeated_and_clashing_rows(spark):
    rows = [(k, t, lang, "own", 1.0) for k, t, lang in sentences(30)]
    many = rows + [(1, "der baum der baum", "bb", "own", 1.0)] * 200
    schema = "doc_id bigint, text string, lang string, l string, score double"
    one, two = (langkernel.fit(spark.createDataFrame(r, schema)) for r in (rows, many + many[-1:]))
    assert one.weights.shape == two.weights.shape and two.languages == ["aa", "bb", "cc"]
    docs = spark.createDataFrame(many, schema)
    out = docs.select("doc_id", "l", "score", one.predict(spark, F.col("text")).alias("p")).collect()
    assert len(out) == 230 and len({(r.p.lang, r.p.score) for r in out if r.doc_id == 1 and r.p.lang == "bb"}) >= 1
    tie = langkernel.LanguageModel(["x", "y"], np.zeros((langkernel.BUCKETS, 2), np.float32), np.zeros(2, np.float32))
    assert docs.select(tie.predict(spark, F.col("text"))["lang"]).distinct().collect() == [("x",)]


def test_latent_space_as_plain_cosines(spark):
    """With a rank that holds all texts, cosines in the latent space are those of the weighted counts."""
    r = random.Random(3)
    texts = [" ".join(r.choices(["Alpha", "beta7", "##", "gamma", "DELTA", "x", "12"], k=r.randrange(3, 30))) for _ in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, quality int")
    model = lsavotes.fit(docs, labels)
    data, ends = lsavotes.utf8(pa.array(texts))
    x = lsavotes._counts(data, ends, 0, 40)
    for k, t in enumerate(texts):  # counts are whole
        assert np.expm1(x[k, : lsavotes.WORDS]).sum() == pytest.approx(len(t.split()), rel=1e-4)
        assert np.expm1(x[k, lsavotes.WORDS : lsavotes.WORDS + lsavotes.SHAPES]).sum() == pytest.approx(len(t.split()), rel=1e-4)
    df = (x > 0).sum(0)
    assert np.allclose(model.idf, np.log((1 + 40) / (1 + df)) + 0.1, atol=1e-4)
    plain = lsavotes.weighted(x.copy(), model.idf).astype(float)
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    found = lsavotes.project(x.copy(), model.idf, model.axes)
    assert np.allclose(found @ found.T, plain @ plain.T, atol=2e-3)


def test_equally_near_neighbours_share_places():
    vectors = np.array([[1.0, 0.0]] * 60, np.float32)
    labels, weights = np.array([1.0] * 20 + [0.0] * 40), np.ones(60)
    order = np.random.default_rng(2).permutation(60)
    axes = np.zeros((lsavotes.TERMS, 2), np.float32)
    axes[:, 0] = 1
    for at in (np.arange(60), order):
        got = lsavotes.votes(pa.array(["some text", None]), np.ones(lsavotes.TERMS, np.float32), axes, vectors, labels[at], weights, 0.5)
        assert got.tolist() == pytest.approx([1 / 3, 1 / 3])


def test_scores_of_hard_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, "w " * 100_000)], "doc_id bigint, text string").withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 2, 3, 4)], "doc_id bigint, quality int")
    model = lsavotes.fit(docs.unionByName(spark.createDataFrame([(3, "good words", "own")] * 50 + [(4, "### |||", "own")], docs.schema)), labels)
    assert model.vectors.shape[0] == 3  # an id is learned once
    got = docs.select(model.score(spark, F.col("text")).alias("s")).collect()
    assert len(got) == 4 and all(0 <= r.s <= 1 for r in got) and docs.limit(0).select(model.score(spark, F.col("text"))).collect() == []


def test_pieces_of_hard_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "mark \u2581 here"), (4, "long " * 60_000), (4, "long " * 60_000), (None, "x")]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id bigint, text string, ids string")
    out = docs.select("doc_id", "text", piecefst.codec(spark, model)(F.col("text")).alias("p")).collect()
    assert [r.p.text for r in out] == ["", "", "mark   here", *["long " * 60_000] * 2, "x"] and out[0].p.ids == []
    assert out[3].p == out[4].p
    assert docs.limit(0).select(piecefst.codec(spark, model)(F.col("text"))).collect() == []


def compiled_map(rules):
    """A character map as model files hold it: every trie node gets the first free block of a double array."""
    import struct

    trie: dict = {}
    for read in rules:
        now = trie
        for b in read.encode():
            now = now.setdefault(b, {})
        now[0] = read
    texts, place = b"", {}
    for read, write in rules.items():
        place[read] = len(texts)
        texts += write.encode() + b"\0"
    units, used, bases = {0: 0}, {0}, set()
    todo = [(0, trie)]
    while todo:
        at, node = todo.pop()
        base = next(b for b in range(1, 1 << 16) if b not in bases and all(b ^ c not in used for c in node))
        bases.add(base)
        units[at] |= (at ^ base) << 10 | (256 if 0 in node else 0)
        for c, child in node.items():
            used.add(base ^ c)
            units[base ^ c] = 0x80000000 | place[child] if c == 0 else c
            if c:
                todo.append((base ^ c, child))
    n = -(-(max(units) + 1) // 256) * 256
    raw = b"".join(struct.pack("<I", units.get(k, 0x80000000)) for k in range(n))
    return struct.pack("<I", len(raw)) + raw + texts


def test_character_maps_as_the_library():
    """A made-up model whose normaliser maps characters, read by the library and by the transducer."""
    import struct

    spm = pytest.importorskip("sentencepiece")
    size = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + size(n >> 7)
    field = lambda n, kind, payload: size(n << 3 | kind) + payload
    blob = lambda n, b: field(n, 2, size(len(b)) + b)
    piece = lambda p, score, kind=1: blob(1, blob(1, p.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))
    rules = {"ａ": "a", "ﬁ": "fi", "é": "e", "e\u0301": "e", "\n": " ", "\t": " ", "\u3000": " ", "x": "xx", "zzz": "q"}
    assert piecefst.character_map(compiled_map(rules)) == rules
    letters = "abcefioqxz"
    for dummy, trim in ((1, 0), (1, 1), (0, 1)):
        raw = piece("<unk>", 0, 2) + b"".join(piece(p, -float(k % 7) - 1.5) for k, p in enumerate(["▁", *letters, "▁a", "fi", "xx", "ab", "▁fi", "zz"]))
        raw += blob(2, field(3, 0, b"\x01")) + blob(3, blob(1, b"own") + blob(2, compiled_map(rules)) + field(3, 0, bytes([dummy])) + field(4, 0, bytes([trim])))
        theirs, ours = spm.SentencePieceProcessor(model_proto=raw), piecefst.PieceTransducer(raw)
        r = random.Random(4)
        texts = ["".join(r.choices([*rules, *letters, " ", "  ", "zz", "é", "?"], k=r.randrange(0, 16))) for _ in range(400)]
        scores = ours.score
        for t in texts:
            got, want = ours.encode(t), theirs.encode(t)
            assert ours.decode(got) == theirs.decode(want), t
            weigh = lambda ids: sum(scores.get(ours.pieces[i], -1e6) for i in ids)
            assert weigh(got) == pytest.approx(weigh(want)), t  # of equally light paths either may be taken
        flat, ends = ours.encode_all(texts)
        assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ours.encode(t) for t in texts]
