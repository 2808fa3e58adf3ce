"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import ship
from .textkit import _SPACE, _TABLE, _U, _powers, mix, relax, utf8, words

#: Hash buckets of words, of word shapes and of whole-text properties; rank of the latent space.
WORDS, SHAPES, FACTS, RANK = 1 << 13, 1 << 11, 64, 64
#: Bounds of the fit: labelled texts of each label; neighbours that vote.
PER_LABEL, VOTERS = 5000, 25
#: Lengths of the parts of a text's vector: words, shapes, facts.
SHARE = (0.5, 1.0, 1.0)

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1
TERMS = WORDS + SHAPES + FACTS


def _counts(data: np.ndarray, ends: np.ndarray, i: int, j: int) -> np.ndarray:
    """Rows i..j as log-scaled counts of terms: words, shapes of words (runs of one character class count once) and facts of the whole text."""
    n = j - i
    h, s, e, at = words(data, ends, i, j)
    b = data[int(ends[i]) : int(ends[j])]
    row = np.repeat(np.arange(n), np.diff(at))
    cls = _CLASS[b]
    new = np.ones(len(b), bool)
    new[1:] = cls[1:] != cls[:-1]
    new[s] = True
    new &= ~_SPACE[b]
    rank = np.concatenate(([0], np.cumsum(new)))
    up, down = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(np.where(new, _TABLE[cls] * up[rank[:-1]], _U(0)), out=total[1:])
    shape = mix((total[e] - total[s]) * down[rank[s]])
    x = np.bincount(row * TERMS + (h >> _U(51)).astype(np.int64), minlength=n * TERMS)
    x += np.bincount(row * TERMS + WORDS + (shape >> _U(53)).astype(np.int64), minlength=n * TERMS)
    x = np.log1p(x.reshape(n, TERMS).astype(np.float32))
    k = np.diff(at)
    key = np.sort((row.astype(np.uint64) << _U(40)) | (h >> _U(24)))
    distinct = np.bincount((key[np.concatenate(([True], key[1:] != key[:-1]))] >> _U(40)).astype(np.int64), minlength=n) if len(key) else np.zeros(n, int)
    facts = x[:, WORDS + SHAPES :]
    r = np.arange(n)
    facts[r, np.minimum(np.log2(k + 1).astype(int), 20)] = 1
    facts[r, 24 + (10 * distinct / np.maximum(k, 1)).astype(int)] = 1
    size = np.bincount(row, e - s, minlength=n) if len(row) else np.zeros(n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    facts[r, 36 + np.minimum(8 * np.bincount(row, same, minlength=n) / np.maximum(k, 1), 3).astype(int)] = 1
    facts[r, 40 + np.minimum(size / np.maximum(k, 1), 20).astype(int)] = 1
    return x


def _batches(ends: np.ndarray):
    i, n = 0, len(ends) - 1
    while i < n:
        j = min(n, i + 128, max(i + 1, int(np.searchsorted(ends, ends[i] + (1 << 20), "right")) - 1))
        yield i, j
        i = j


class VoteModel:
    """idf weights, projection, labelled unit vectors and their labels, and the prior."""

    def __init__(self, idf, axes, vectors, labels, weights, prior: float):
        self.idf, self.axes, self.vectors, self.labels, self.weights, self.prior = idf, axes, vectors, labels, weights, prior

    def score(self, spark, text: Column) -> Column:
        """Share of the votes for label 1.

        Every text gets a score, the prior where no neighbour has a positive cosine: null and
        empty texts are scored as empty ones. Texts are counted whole, whatever their length; equal
        texts get equal scores; neighbours that are equally near share the places that are left."""
        if self.vectors is None:
            return F.lit(float(self.prior))
        ship(spark)
        sent = spark.sparkContext.broadcast((self.idf, self.axes, self.vectors, self.labels, self.weights, self.prior))

        @F.arrow_udf("double")
        def scored(column: pa.Array) -> pa.Array:
            out = votes(column, *sent.value)
            relax()
            return pa.array(out)

        return scored(F.coalesce(text, F.lit("")))


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Counts by idf, each block of terms to the length SHARE gives it (a block without terms stays empty)."""
    x = x * idf
    for (i, j), share in zip(((0, WORDS), (WORDS, WORDS + SHAPES), (WORDS + SHAPES, TERMS)), SHARE):
        x[:, i:j] *= share / np.maximum(np.linalg.norm(x[:, i:j], axis=1, keepdims=True), 1e-12)
    return x


def project(x: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors in the latent space (zero stays zero)."""
    v = weighted(x, idf) @ axes
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def votes(column: pa.Array, idf, axes, vectors, labels, weights, prior) -> np.ndarray:
    """Exact cosines of each text with every labelled vector, a block of texts at a time."""
    data, ends = utf8(column)
    out = np.full(len(ends) - 1, prior, np.float64)
    k = min(VOTERS, len(labels))
    for i, j in _batches(ends):
        sims = project(_counts(data, ends, i, j), idf, axes).astype(np.float32) @ vectors.T
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        close = np.take_along_axis(sims, near, 1)
        w = np.maximum(close, 0).astype(np.float64) ** 8 * weights[near]
        total, good = w.sum(1), (w * labels[near]).sum(1)
        # neighbours as near as the last voter that found no place
        last = close.min(1, keepdims=True)
        for r in np.flatnonzero((sims == last).sum(1) > (close == last).sum(1)).tolist():
            total[r], good[r] = _shared(sims[r], k, labels, weights)
        some = total > 0
        out[i:j][some] = good[some] / total[some]
    return np.clip(out, 0, 1)


def _shared(sims: np.ndarray, k: int, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Weight of all votes and of those for label 1, where equally near neighbours share the places that are left."""
    last = np.partition(sims, -k)[-k]
    before, tied = sims > last, sims == last
    place = before + tied * ((k - before.sum()) / tied.sum())
    w = np.maximum(sims, 0).astype(np.float64) ** 8 * weights * place
    return float(w.sum()), float((w * labels).sum())


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", id_col: str = "doc_id", where: Column | None = None) -> VoteModel:
    """Learn from the texts that `labels` (id_col, label) marks 0 or 1.

    About PER_LABEL texts of each label are used, chosen by a hash of the id; that bounds
    what is broadcast. Votes are weighted so that both labels count by their share among
    all labelled rows. Null ids, texts or labels teach nothing; an id counts once however
    often it is repeated, with the least of its texts and labels; other columns are ignored. With one label alone, or
    none, the score is the share of label 1 among labelled rows (1 if there are none).
    """
    spark = docs.sparkSession
    ship(spark)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    marked = marked.where(where) if where is not None else marked
    n = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    prior = n.get(1, 0) / total if total else 1.0
    if len(n) < 2:
        return VoteModel(None, None, None, None, None, prior)
    h = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(7)), F.lit(1 << 30))
    share = F.when(F.col("y") == 1, min(1 << 30, PER_LABEL * (1 << 30) // n[1])).otherwise(min(1 << 30, PER_LABEL * (1 << 30) // n[0]))
    few = marked.where(h < share).groupBy("id").agg(F.min("y").alias("y"))  # about 2 * PER_LABEL rows at most
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(few), "id")
    chosen = chosen.groupBy("id", "y").agg(F.min("text").alias("text"))

    def termed(batches):
        for b in batches:
            data, ends = utf8(b.column(0))
            for i, j in _batches(ends):
                x = _counts(data, ends, i, j)
                q = [(np.flatnonzero(r).astype(np.uint16).tobytes(), r[r > 0].astype(np.float32).tobytes()) for r in x]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in q], pa.binary()), pa.array([v for _, v in q], pa.binary()), b.column(1).slice(i, j - i), b.column(2).slice(i, j - i)], names=["at", "v", "y", "id"])

    rows = chosen.select("text", "y", F.col("id").cast("string").alias("id")).mapInArrow(termed, "at binary, v binary, y int, id string").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["id"], r["at"]))
    y = np.array([r["y"] for r in rows], np.float64)
    if len(set(y)) < 2:
        return VoteModel(None, None, None, None, None, prior)
    df = np.zeros(TERMS)
    for r in rows:
        df[np.frombuffer(r["at"], np.uint16)] += 1
    idf = np.log((1 + len(rows)) / (1 + df)).astype(np.float32) + 0.1

    def dense(part):
        x = np.zeros((len(part), TERMS), np.float32)
        for k, r in enumerate(part):
            x[k, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["v"], np.float32)
        return weighted(x, idf)

    # randomised truncated SVD: the rows are made dense a block at a time
    blocks = [rows[k : k + 512] for k in range(0, len(rows), 512)]
    rank = min(RANK, len(rows))
    axes = np.random.default_rng(5).standard_normal((TERMS, rank + 8)).astype(np.float32)
    for _ in range(4):
        axes, _ = np.linalg.qr(sum(d.T @ (d @ axes) for d in map(dense, blocks)))
    gram = sum((p := d @ axes).T @ p for d in map(dense, blocks))
    _, turn = np.linalg.eigh(gram.astype(np.float64))
    axes = np.ascontiguousarray((axes @ turn[:, ::-1][:, :rank].astype(np.float32)), np.float32)
    v = np.concatenate([d @ axes for d in map(dense, blocks)])
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    seen = {c: float((y == c).sum()) for c in (0.0, 1.0)}
    weights = np.where(y == 1, n[1] / seen[1.0], n[0] / seen[0.0]) / max(n[1] / seen[1.0], n[0] / seen[0.0])
    return VoteModel(idf, axes, np.ascontiguousarray(v, np.float32), y, weights, prior)
