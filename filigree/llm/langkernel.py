"""Language identification with a blended-spectrum string kernel and Nyström landmarks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .scratch import ship
from .textkit import relax, utf8

#: Hash buckets of n-grams; n runs over ORDERS (bytes of UTF-8, letters only).
BUCKETS, ORDERS = 1 << 14, (1, 2, 3, 4)
#: Bounds of the fit: labelled texts and landmarks of each language and in all (one of each at least), and the ridge.
PER_LANGUAGE, TEXTS, LANDMARKS, ALL_LANDMARKS, RIDGE = 1500, 20_000, 48, 1024, 1e-3

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _folded(b: np.ndarray) -> np.ndarray:
    """Letters in lower case (A-Z and Latin-1 capitals), all other ASCII as spaces."""
    out = _FOLD[b]
    lead = np.flatnonzero(out[:-1] == 0xC3) + 1
    cap = lead[(out[lead] >= 0x80) & (out[lead] <= 0x9E) & (out[lead] != 0x97)]
    out[cap] += 0x20
    return out


def presence(data: np.ndarray, ends: np.ndarray, i: int, j: int) -> np.ndarray:
    """0/1 matrix of the hashed n-grams that occur in rows i..j."""
    lo, hi = int(ends[i]), int(ends[j])
    x = np.zeros((j - i) * BUCKETS, np.uint8)
    b = _folded(data[lo:hi]).astype(np.uint32) if hi > lo else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(j - i, dtype=np.int64), np.diff(ends[i : j + 1]))
    base = row * BUCKETS
    h = np.zeros(len(b), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(b) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(1)
        if n in ORDERS:
            g = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            at = base[:m] + (g >> np.uint32(18)).astype(np.int64)
            x[at[row[:m] == row[n - 1 :]] if n > 1 else at] = 1
    return x.reshape(j - i, BUCKETS)


def _rows(ends: np.ndarray, bytes_most: int = 1 << 20, rows_most: int = 256):
    i, n = 0, len(ends) - 1
    while i < n:
        j = min(n, i + rows_most, max(i + 1, int(np.searchsorted(ends, ends[i] + bytes_most, "right")) - 1))
        yield i, j
        i = j


def kernel_scores(column: pa.Array, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """One-versus-rest scores. The kernel against all landmarks and the ridge weights are
    both linear in the presence vector, so they are folded into one matrix beforehand."""
    data, ends = utf8(column)
    out = np.zeros((len(ends) - 1, weights.shape[1]), np.float32)
    for i, j in _rows(ends):
        x = presence(data, ends, i, j).astype(np.float32)
        out[i:j] = x @ weights / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + bias
    return out


class LanguageModel:
    """languages (sorted) with the folded weights; predict() is a column expression."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias

    def predict(self, spark, text: Column) -> Column:
        """struct(lang, score) of a text; `und` and 0 if it is null or has no letter, or nothing was learned.

        Of equal scores the first language by name wins. Texts are read whole: a very long one fills
        ever more of the BUCKETS and so looks less like any language, but its length divides
        out. Equal texts get equal results."""
        kind = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])
        none = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
        if not self.languages:
            return none
        ship(spark)
        sent = spark.sparkContext.broadcast((self.languages, self.weights, self.bias))

        @F.arrow_udf(kind)
        def scored(column: pa.Array) -> pa.Array:
            languages, weights, bias = sent.value
            s = kernel_scores(column, weights, bias)
            relax()
            best = s.argmax(1) if len(s) else np.zeros(0, int)
            top = np.clip((1 + s[np.arange(len(s)), best].astype(np.float64)) / 2, 0, 1)
            return pa.StructArray.from_arrays([pa.array(languages).take(pa.array(best)).cast(pa.string()), pa.array(top)], names=["lang", "score"])

        # marked so that a filter on the result is not pushed below it, which would score every text twice
        return F.when(text.rlike(r"\p{L}"), scored.asNondeterministic()(text)).otherwise(none)


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", id_col: str = "doc_id", where: Column | None = None) -> LanguageModel:
    """Learn languages from labelled texts.

    Every language is learned, from about PER_LANGUAGE texts of each, TEXTS in all, one at
    least, chosen by a hash of the id; LANDMARKS texts of each language,
    ALL_LANDMARKS in all, are the Nyström landmarks. Rows with a null text, id or language teach nothing; an id
    counts once however often it is repeated, with the least of its texts. With no labelled row,
    as in an empty table, the model is empty and predicts `und`. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.where(where) if where is not None else rows
    h = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(9)), F.lit(1 << 30))
    top = rows.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n"), F.min(h).alias("first")).collect()
    if not top:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    each = min(PER_LANGUAGE, TEXTS // len(top))
    share = F.create_map(*[x for r in top for x in (F.lit(r.l), F.lit(max(r["first"] + 1, min(1 << 30, each * (1 << 30) // r.n))))])
    chosen = rows.where(h < F.coalesce(F.try_element_at(share, F.col(lang)), F.lit(0)))
    small = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(10)), F.lit(1 << 30))

    def packed(batches):
        for b in batches:
            data, ends = utf8(b.column(0))
            for i, j in _rows(ends):
                bits = np.packbits(presence(data, ends, i, j), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in bits], pa.binary()), b.column(1).slice(i, j - i), b.column(2).slice(i, j - i)], names=["bits", "l", "h"])

    # about TEXTS rows of 2 KB at most
    once = chosen.select(F.col(id_col).alias("id"), F.struct(F.col(text).alias("text"), F.col(lang).alias("l"), small.alias("h")).alias("r")).groupBy("id").agg(F.min("r").alias("r"))
    found = once.select("r.text", "r.l", "r.h").mapInArrow(packed, "bits binary, l string, h bigint").toArrow()
    names = found.column("l").to_pylist()
    languages = sorted(set(names))
    order = np.lexsort((np.array(found.column("h").to_pylist()), np.array(names)))
    raw = found.column("bits").to_pylist()
    bits = np.frombuffer(b"".join(raw[k] for k in order), np.uint8).reshape(len(raw), -1)
    del found, raw
    y = np.array(names)[order]
    landmarks = np.concatenate([np.flatnonzero(y == n)[: max(1, min(LANDMARKS, ALL_LANDMARKS // len(languages)))] for n in languages])
    # presence vectors stay packed, 2 KB each; a few hundred are unpacked at a time
    some = lambda rows: np.unpackbits(bits[rows], axis=1).astype(np.float32)
    blocks = [slice(k, k + 256) for k in range(0, len(bits), 256)]
    size = np.maximum(np.bitwise_count(bits).sum(1, dtype=np.int64), 1).astype(np.float32)
    z = (some(landmarks) / np.sqrt(size[landmarks])[:, None]).T
    values, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([(some(k) @ z) / np.sqrt(size[k])[:, None] for k in blocks]) @ root
    phi = np.hstack([phi, np.ones((len(phi), 1))])
    counts = {n: int((y == n).sum()) for n in languages}
    weight = np.array([len(y) / (len(languages) * counts[n]) for n in y])
    target = np.where(y[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    a = phi.T @ (phi * weight[:, None]) + RIDGE * len(y) * np.eye(phi.shape[1])
    w = np.linalg.solve(a, phi.T @ (target * weight[:, None]))
    return LanguageModel(languages, (z @ (root @ w[:-1])).astype(np.float32), w[-1].astype(np.float32))
