"""Top-k search of many questions over many rows, a block of questions against a block of rows at a time.

Both sides are packed into blocks of bounded size, so that what is paired are a few large
rows, and only the best of each block leave it. No row is compared through a join of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from filigree.functions.parsing import tokenize
from filigree.runtime import ship

#: Okapi constants (fixed values).
K1, B = 1.5, 0.75
#: Rows of a block of vectors, of a block of texts, terms of the latter; questions of a block of either kind.
VECTORS, TEXTS, TERMS, ASKED_VECTORS, ASKED_TEXTS = 4096, 1024, 1 << 20, 1024, 256
#: Scores are compared as rounded to six places; ones this near may round alike.
NEAR = 2e-6


def _blocks(batches, rows: int, weight=None, most: int = 0) -> Iterator[pa.Table]:
    """The rows of a partition in tables of at most `rows` rows (and, but for a single row, `most` in weight)."""
    held: list[pa.RecordBatch] = []
    n = load = 0
    for b in batches:
        sizes = weight(b) if weight else None
        at = 0
        while at < b.num_rows:
            take = min(b.num_rows - at, rows - n)
            if sizes is not None:
                fit = int(np.searchsorted(np.cumsum(sizes[at : at + take]), most - load, "right"))
                take = min(take, fit if fit or n else 1)
            if take:
                held.append(b.slice(at, take))
                n, load, at = n + take, load + (int(sizes[at : at + take].sum()) if sizes is not None else 0), at + take
            if n and (n == rows or at < b.num_rows):
                yield pa.Table.from_batches(held).combine_chunks()
                held, n, load = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _row(**columns) -> pa.RecordBatch:
    """A batch of one row whose fields are whole arrays or bytes."""
    made = [pa.array([v], pa.binary()) if isinstance(v, bytes) else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in columns.values()]
    return pa.RecordBatch.from_arrays(made, names=list(columns))


def packed_vectors(rows: DataFrame, id_col: str, vector: str, size: int) -> DataFrame:
    """(ids, m): blocks of rows whose vector is not null, m their vectors as 32-bit numbers."""
    kind = rows.schema[id_col].dataType.simpleString()

    def pack(batches):
        for t in _blocks(batches, size):
            yield _row(ids=_one(t.column(0)), m=_one(_one(t.column(1)).flatten()).to_numpy(zero_copy_only=False).astype(np.float32).tobytes())

    return rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("v")).mapInArrow(pack, f"ids array<{kind}>, m binary")


def best(scores: np.ndarray, ids: pa.Array, k: int, floor: float = -np.inf) -> np.ndarray:
    """Places of the rows that may be among the k best (score to six places, then id), given that k rows of `floor` are known."""
    some = np.flatnonzero(scores >= floor - NEAR)
    if len(some) > k:
        s = scores[some]
        some = some[s >= np.partition(s, -k)[-k] - NEAR]
    if len(some) <= 4 * k:
        return some
    # many ties: of scores that are alike for certain the k smallest ids will do
    alike = np.floor(scores[some] * 1e7).astype(np.int64)
    order = np.lexsort((np.array(ids.take(pa.array(some)).to_pylist()), alike))
    first = np.flatnonzero(np.concatenate(([True], np.diff(alike[order]) != 0)))
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return some[order[place < k]]


def _found(asked: pa.Array, ids: pa.Array, scores: np.ndarray, k: int, floors: dict, positive: bool) -> pa.RecordBatch:
    """The best rows of a block (rows x questions) for each question; floors keeps the k-th best that earlier blocks of the task had."""
    rows, owner, values = [], [], []
    for q, name in enumerate(asked.to_pylist()):
        s = scores[:, q]
        have = np.flatnonzero(s > 0) if positive else np.arange(len(s))
        if not len(have):
            continue
        at = have[best(s[have], ids.take(pa.array(have)) if positive else ids, k, floors.get(name, -np.inf))]
        if len(have) >= k:
            floors[name] = max(floors.get(name, -np.inf), float(np.partition(s[have], -k)[-k]))
        rows.append(at)
        owner.append(np.full(len(at), q))
        values.append(s[at])
    rows, owner, values = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, int), (owner, int), (values, float)))
    return pa.RecordBatch.from_arrays([asked.take(pa.array(owner, pa.int64())), ids.take(pa.array(rows, pa.int64())), pa.array(values, pa.float64())], names=["qid", "id", "score"])


def _types(queries: DataFrame, rows: DataFrame) -> str:
    return f"qid {queries.schema['qid'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"


def dense_best(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(qid, id, score): for each of queries (qid, vector) the rows (id, embedding) that may be among its k best by inner product of unit vectors; a few more than k. Null vectors match nothing."""
    ship(rows.sparkSession)
    both = packed_vectors(rows, "id", "embedding", VECTORS).crossJoin(packed_vectors(queries, "qid", "vector", ASKED_VECTORS).withColumnsRenamed({"ids": "qids", "m": "qm"}))

    def search(batches):
        floors: dict = {}
        for b in batches:
            for r in range(b.num_rows):
                ids, asked = b.column(0)[r].values, b.column(2)[r].values
                v, q = (np.frombuffer(b.column(c)[r].as_py(), np.float32).reshape(n, -1).astype(np.float64) for c, n in ((1, len(ids)), (3, len(asked))))
                yield _found(asked, ids, v @ q.T, k, floors, False)

    return both.mapInArrow(search, _types(queries, rows))


def term_weights(queries: DataFrame, idf: DataFrame) -> DataFrame:
    """(qid, term, w): how often a question (qid, query) has a term, times the term's weight."""
    terms = queries.select("qid", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qf"))
    return terms.join(idf, "term").select("qid", "term", (F.col("qf") * F.col("idf")).alias("w"))


def packed_questions(weights: DataFrame) -> DataFrame:
    """(qids, owner, qterms, w): blocks of questions, made of (qid, term, w), with the terms of each."""
    kind = weights.schema["qid"].dataType.simpleString()
    by = weights.groupBy("qid").agg(F.collect_list(F.struct("term", "w")).alias("t"))

    def ask(batches):
        for t in _blocks(batches, ASKED_TEXTS):
            lists = _one(t.column(1))
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            owner = pa.array(np.repeat(np.arange(len(n), dtype=np.int32), n))
            flat = lists.flatten()
            yield _row(qids=_one(t.column(0)), owner=owner, qterms=flat.field("term"), w=flat.field("w"))

    return by.select("qid", "t").mapInArrow(ask, f"qids array<{kind}>, owner array<int>, qterms array<string>, w array<double>")


def scored_pairs(pairs: DataFrame, bags: DataFrame, weights: DataFrame, stats: DataFrame) -> DataFrame:
    """(qid, id, score): Okapi scores of distinct pairs (qid, id) of questions that have weights (qid, term, w), from the bags of the chunks named. A block of texts meets a block of questions at a time, so no term of a text is a row."""
    ship(bags.sparkSession)
    id_kind, q_kind = bags.schema["id"].dataType.simpleString(), pairs.schema["qid"].dataType.simpleString()
    wanted = bags.join(pairs.groupBy("id").agg(F.collect_list("qid").alias("want")), "id").select("id", "terms", "want").where("terms is not null")

    def pack(batches):
        length = lambda b: pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
        for t in _blocks(batches, TEXTS, length, TERMS):
            lists, want = _one(t.column(1)), _one(t.column(2))
            yield _row(ids=_one(t.column(0)), dl=pc.list_value_length(lists).cast(pa.int32()), terms=lists.flatten(), n=pc.list_value_length(want).cast(pa.int32()), want=want.flatten())

    texts = wanted.mapInArrow(pack, f"ids array<{id_kind}>, dl array<int>, terms array<string>, n array<int>, want array<{q_kind}>")
    both = texts.crossJoin(packed_questions(weights)).crossJoin(F.broadcast(stats.select("avgdl")))  # one row

    def score(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, dl, terms, n, want, qids, owner, qterms, w = (b.column(c)[r].values for c in range(9))
                scores = okapi(dl.to_numpy(), terms, owner.to_numpy(), qterms, w.to_numpy(), len(qids), b.column(9)[r].as_py())
                at = pc.index_in(want, qids)
                here = at.is_valid().to_numpy(zero_copy_only=False)
                row, q = np.repeat(np.arange(len(ids)), n.to_numpy())[here], at.drop_null().to_numpy()
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), ids.take(pa.array(row)), pa.array(scores[row, q])], names=["qid", "id", "score"])

    return both.mapInArrow(score, f"qid {q_kind}, id {id_kind}, score double")


def sparse_best(queries: DataFrame, bags: DataFrame, idf: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """(qid, id, score): for each of queries (qid, query) the chunks (id, terms) that may be among its k best by Okapi BM25 above 0; a few more than k. idf and stats are those of the whole corpus."""
    ship(bags.sparkSession)
    id_kind = bags.schema["id"].dataType.simpleString()

    def pack(batches):
        length = lambda b: pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
        for t in _blocks(batches, TEXTS, length, TERMS):
            lists = _one(t.column(1))
            yield _row(ids=_one(t.column(0)), dl=pc.list_value_length(lists).cast(pa.int32()), terms=lists.flatten())

    texts = bags.select("id", "terms").where("terms is not null").mapInArrow(pack, f"ids array<{id_kind}>, dl array<int>, terms array<string>")
    both = texts.crossJoin(packed_questions(term_weights(queries, idf))).crossJoin(F.broadcast(stats.select("avgdl")))  # one row

    def search(batches):
        floors: dict = {}
        for b in batches:
            for r in range(b.num_rows):
                ids, dl, terms, qids, owner, qterms, w = (b.column(c)[r].values for c in range(7))
                scores = okapi(dl.to_numpy(), terms, owner.to_numpy(), qterms, w.to_numpy(), len(qids), b.column(7)[r].as_py())
                yield _found(qids, ids, scores, k, floors, True)

    return both.mapInArrow(search, _types(queries, bags))


def okapi(dl: np.ndarray, terms: pa.Array, owner: np.ndarray, qterms: pa.Array, w: np.ndarray, asked: int, avgdl: float, most: int = 1 << 21) -> np.ndarray:
    """Scores (texts x questions). Texts have dl terms each, one after the other; qterms are terms of the questions `owner` with weights w."""
    known = pc.unique(qterms)
    of = pc.index_in(qterms, known).to_numpy(zero_copy_only=False)
    order = np.argsort(of, kind="stable")
    owner, w = owner[order], w[order]
    first = np.searchsorted(of[order], np.arange(len(known) + 1))
    place = pc.index_in(terms, known)
    has = place.is_valid().to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(dl)), dl)[has]
    key, tf = np.unique(text * len(known) + place.drop_null().to_numpy(), return_counts=True)
    text, term = key // max(len(known), 1), key % max(len(known), 1)
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[text] / avgdl))
    n = first[term + 1] - first[term]
    out = np.zeros(len(dl) * asked)
    ends = np.cumsum(n)
    i = 0
    while i < len(n):  # as many products at once as fit the memory
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + most, "right")))
        k = n[i:j]
        at = np.repeat(first[term[i:j]] - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum())
        out += np.bincount(np.repeat(text[i:j], k) * asked + owner[at], np.repeat(gain[i:j], k) * w[at], len(out))
        i = j
    return out.reshape(len(dl), asked)
