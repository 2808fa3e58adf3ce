"""The index: chunk rows with vectors and postings, kept up by content hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from filigree.functions.parsing import tokenize
from filigree.runtime import ship


def stale_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Indexed ids that the new chunks no longer have."""
    return old.select("id").join(new.select("id"), "id", "left_anti")


def changed_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids that are new or whose hash differs."""
    was = old.select("id", F.col("hash").alias("was"))
    return new.select("id", "hash").join(was, "id", "left").where(~F.col("hash").eqNullSafe(F.col("was"))).select("id")


def merged(old: DataFrame, new: DataFrame, embed=None) -> DataFrame:
    """The index after an update by all chunks of the selected files: unchanged rows keep their vector, new and changed ones are embedded by `embed` (a column function of the text), all others vanish."""
    was = old.select("id", F.col("hash").alias("_was"), F.col("embedding").alias("_had"))
    both = new.join(was, "id", "left")
    same = F.col("hash").eqNullSafe(F.col("_was"))
    none = F.lit(None).cast("array<float>")
    fresh = embed(F.when(~same, F.col("embed_text"))) if embed else none
    return both.withColumn("embedding", F.when(same, F.col("_had")).otherwise(fresh)).drop("_was", "_had")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row (upserted, deleted) of an update."""
    up = changed_ids(old, new).agg(F.count("*").alias("upserted"))
    return up.crossJoin(stale_ids(old, new).agg(F.count("*").alias("deleted")))


def search_text(ticker="ticker", company="company", label="fiscal_label", section="section", text="text") -> Column:
    """What sparse search sees of a chunk."""
    return F.concat_ws(" ", ticker, company, label, section, text)


def bags(chunks: DataFrame, text: Column | None = None) -> DataFrame:
    """(id, terms): the terms of each chunk, in order and with repeats. All that follows can be made of them, so texts are read once."""
    return chunks.select("id", tokenize(text if text is not None else search_text()).alias("terms"))


def postings(chunks: DataFrame, text: Column | None = None, only: DataFrame | None = None) -> DataFrame:
    """(term, id, tf, dl): term counts of each chunk (or bag) with its length; of the terms of `only` alone where given, which are those of questions and are sent to the texts."""
    terms = chunks if "terms" in chunks.columns else bags(chunks, text)
    rows = terms.select("id", F.size("terms").cast("bigint").alias("dl"), F.explode("terms").alias("term"))
    rows = rows if only is None else rows.join(F.broadcast(only.select("term").distinct()), "term", "left_semi")
    return rows.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def counts(bags: DataFrame) -> DataFrame:
    """(id, dl, term, tf) of bags (id, terms), and what else a bag's row holds behind them: a bag is counted where it lies, without a shuffle."""
    ship(bags.sparkSession)
    more = [c for c in bags.columns if c not in ("id", "terms")]
    kinds = {c: bags.schema[c].dataType.simpleString() for c in ("id", *more)}
    names = ["id", "dl", "term", "tf", *more]

    def run(batches):
        for b in batches:
            lists = b.column(1)
            n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            terms = pc.dictionary_encode(lists.flatten())
            size = max(len(terms.dictionary), 1)
            key, tf = np.unique(np.repeat(np.arange(len(n)), n) * size + terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            row = pa.array(key // size)
            own = [b.column(k).take(row) for k in range(2, b.num_columns)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), pa.array(n[key // size], pa.int64()), terms.dictionary.take(pa.array(key % size)), pa.array(tf, pa.int64()), *own], names=names)

    return bags.select("id", "terms", *more).mapInArrow(run, ", ".join([f"id {kinds['id']}, dl bigint, term string, tf bigint", *(f"`{c}` {kinds[c]}" for c in more)]))


def frequencies(bags: DataFrame) -> DataFrame:
    """(term, df): in how many bags (id, terms) a term is. This reads every text, so write it where it is used twice, as by idf."""
    return bags.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame, text: Column | None = None) -> DataFrame:
    """One row (n_docs, avgdl) of chunks or bags; of bags with their length (dl) no term is read."""
    terms = chunks if "terms" in chunks.columns else bags(chunks, text)
    return terms.select(F.col("dl") if "dl" in terms.columns else F.size("terms").alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def idf(post: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, idf) of the Okapi weighting, from postings, bags, blocks of postings or frequencies (term, df); where a term is in more than half of the chunks its weight is negative and becomes a quarter of the mean of all terms' weights."""
    n = F.sum(F.size("ids")) if "ids" in post.columns else F.count("*")
    df = (post if "df" in post.columns else frequencies(post) if "terms" in post.columns else post.groupBy("term").agg(n.alias("df"))).crossJoin(F.broadcast(stats.select("n_docs")))
    raw = df.select("term", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg((0.25 * F.avg("raw")).alias("floor"))
    return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
