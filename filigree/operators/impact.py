"""Sparse search over an impact-ordered index: only blocks of postings that may hold one of the best chunks are read.

A chunk belongs to a shard. The postings of a term in a shard lie in the order of their gain (the
part of the score that the question has no say in), cut into blocks that carry the greatest of them. A
threshold, the k-th best score that some chunks reach for certain, then tells which blocks can matter at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from filigree.operators.blocks import K1, NEAR, B, scored_pairs, term_weights
from filigree.operators.index import counts  # noqa: F401
from filigree.runtime import ship
from filigree.sources.scratch import Scratch

#: Postings of a block; chunks of a shard, which bound the postings of one term that lie together.
BLOCK, SHARD = 128, 65_536
#: Terms of a question, those of the greatest bound first, whose first blocks give its first threshold.
FIRST = 8
#: Most terms of all questions whose names are given to the reader of the blocks, which then leaves out files and row groups.
NAMED = 1000


def gain(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def build(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, shard, block, top, ids, gains): blocks of postings (id, dl, term, tf) by falling gain.

    A shard holds SHARD chunks at most (in the mean), so however common a term is, no task sorts more than that of it together."""
    ship(postings.sparkSession)
    spark = postings.sparkSession
    kind = postings.schema["id"].dataType.simpleString()
    s = stats.select("n_docs", "avgdl")
    shards = F.greatest(F.ceil(F.col("n_docs") / SHARD), F.lit(1))
    rows = postings.crossJoin(F.broadcast(s)).select("term", F.pmod(F.xxhash64("id"), shards).cast("int").alias("shard"), gain(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("gain"), "id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartition(parts, "term", "shard").sortWithinPartitions("term", "shard", F.desc("gain"), "id")

    def cut(batches):
        last, place = None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            term = pc.dictionary_encode(b.column(0))
            code, shard = term.indices.to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (shard[1:] != shard[:-1]))))
            # a list goes on over the border of two batches
            head = (b.column(0)[0].as_py(), int(shard[0]))
            begun = place if head == last else 0
            at = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
            at[: first[1] if len(first) > 1 else n] += begun
            starts = np.flatnonzero((at % BLOCK == 0) | np.isin(np.arange(n), first))
            last, place = (b.column(0)[n - 1].as_py(), int(shard[n - 1])), int(at[-1]) + 1
            ends = pa.array(np.append(starts, n), pa.int32())
            head = pa.array(starts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(head), b.column(1).take(head), pa.array((at[starts] // BLOCK).astype(np.int32)), b.column(2).take(head), pa.ListArray.from_arrays(ends, b.column(3)), pa.ListArray.from_arrays(ends, b.column(2))],
                names=["term", "shard", "block", "top", "ids", "gains"],
            )

    return sorted_.mapInArrow(cut, f"term string, shard int, block int, top double, ids array<{kind}>, gains array<double>")


def _few(scores: DataFrame, k: int) -> DataFrame:
    """The 2 k best scores of each question in each of 64 parts of the rows, so that no question's rows are ordered together."""
    part = F.row_number().over(Window.partitionBy("qid", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(F.desc("score"), "id"))
    return scores.withColumn("_p", part).where(F.col("_p") <= 2 * k).drop("_p")


def _kth(scores: DataFrame, k: int, least: str) -> DataFrame:
    """(qid, least): the k-th best score of each question that has as many."""
    return _few(scores, k).withColumn("_p", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("_p") == k).select("qid", F.col("score").alias(least))


def _partial(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qid, id, score, unseen): what the postings of blocks give chunks for certain, and the bounds of the terms seen."""
    each = asked.join(blocks, "term").select("qid", "w", "unread", F.explode(F.arrays_zip("ids", "gains")).alias("p"))
    return each.groupBy("qid", F.col("p.ids").alias("id")).agg(F.sum(F.col("w") * F.col("p.gains")).alias("score"), F.sum("unread").alias("seen"))


def sparse_best(queries: DataFrame, bags: DataFrame, blocks: DataFrame, idf: DataFrame, stats: DataFrame, k: int, scratch: Scratch | None = None, counted: dict | None = None) -> DataFrame:
    """(qid, id, score): for each of queries (qid, query) the chunks that may be among its k best by Okapi BM25 above 0, scored exactly; a few more than k.

    blocks are those of `build` over all bags (id, terms). counted, if given, gets the number of blocks that questions' terms have and that were read.

    Terms of a question go by falling bound (weight times the greatest gain). The first blocks of the
    first terms name some likely chunks, whose exact scores give a threshold. A chunk of the
    best k first occurs under some term; what terms behind it can add is bounded, so a block whose
    greatest gain cannot reach the threshold with that holds no such first occurrence and is not read. What
    was read raises the threshold, and leaves few chunks that the unread rest could lift over it: their bags are
    looked up. Terms of negative weight add nothing to a bound and lower every threshold by what they may take away.
    """
    scratch = scratch or Scratch(queries.sparkSession, "impact")
    weights = scratch.keep(term_weights(queries, idf), "weights")
    named = [r.term for r in weights.select("term").distinct().limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        blocks = blocks.where(F.col("term").isin(named))
    heads = scratch.keep(blocks.join(weights.select("term").distinct(), "term", "left_semi").select("term", "shard", "block", "top"), "heads")
    tops = heads.groupBy("term").agg(F.max("top").alias("greatest"))
    bound = F.greatest(F.col("w") * F.col("greatest"), F.lit(0.0))
    order = Window.partitionBy("qid").orderBy(F.desc("bound"), "term")
    asked = weights.join(tops, "term").withColumn("bound", bound)
    behind = F.coalesce(F.sum("bound").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    taken = F.sum(F.least(F.col("w") * F.col("greatest"), F.lit(0.0))).over(Window.partitionBy("qid"))
    asked = scratch.keep(asked.select("*", behind.alias("behind"), taken.alias("taken"), F.row_number().over(order).alias("place")).withColumn("unread", F.lit(0.0)), "asked")
    plus = asked.where("w > 0")
    first = _partial(plus.where(F.col("place") <= FIRST), blocks.where("block = 0"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    likely = scratch.keep(_few(first, k).withColumn("_p", F.row_number().over(best)).where(F.col("_p") <= 2 * k).select("qid", "id"), "likely")
    low = scratch.keep(_kth(scored_pairs(likely, bags, weights, stats), k, "low"), "low")
    plus = plus.join(low, "qid", "left").withColumn("low", F.greatest(F.coalesce("low", F.lit(0.0)) - NEAR, F.lit(0.0)))
    # per question and term, the least gain that matters, and the greatest one that stays unread
    need = plus.select("qid", "term", "w", ((F.col("low") - F.col("behind")) / F.col("w")).alias("least"))
    all_heads = need.join(heads, "term")
    unread = all_heads.where("top < least").groupBy("qid", "term").agg(F.max("top").alias("_u"))
    read = scratch.keep(need.join(unread, ["qid", "term"], "left").select("qid", "term", "w", "least", (F.col("w") * F.coalesce("_u", F.lit(0.0))).alias("unread")), "needed")
    if counted is not None:
        counted |= all_heads.agg(F.count("*").alias("all"), F.sum((F.col("top") >= F.col("least")).cast("int")).alias("read")).first().asDict()
    wanted = read.join(blocks, "term").where("top >= least").select("qid", "w", "unread", F.explode(F.arrays_zip("ids", "gains")).alias("p"))
    got = scratch.keep(wanted.groupBy("qid", F.col("p.ids").alias("id")).agg(F.sum(F.col("w") * F.col("p.gains")).alias("score"), F.sum("unread").alias("seen")), "read")
    limits = read.groupBy("qid").agg(F.sum("unread").alias("hidden")).join(asked.select("qid", "taken").distinct(), "qid").join(_kth(got, k, "low"), "qid", "left").join(low.withColumnRenamed("low", "sure"), "qid", "left")
    reach = F.col("score") + F.col("hidden") - F.col("seen")
    # of the two scores that k chunks reach for certain the greater one; null where neither is known
    bar = F.greatest(F.col("low") + F.col("taken"), F.col("sure"))
    able = scratch.keep(got.join(limits, "qid").where((reach > 0) & (bar.isNull() | (reach >= bar - NEAR))).select("qid", "id"), "able")
    return scored_pairs(able, bags, weights, stats).where("score > 0")
