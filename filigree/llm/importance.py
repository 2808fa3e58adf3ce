"""Importance resampling towards a target text distribution, by hashed n-gram buckets and Gumbel top-k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .ranks import numbered
from .scratch import Scratch

#: Buckets of features, and what stands between words (all of ASCII but digits and lower-case letters).
BUCKETS, BETWEEN = 10_000, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Seed of the noise, share of eligible documents to draw, and the least words of an eligible one.
SEED, PERCENT, LEAST_WORDS = 7, 25, 20


def words(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z; none of a null text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOW), BETWEEN), "")


def buckets(w: Column) -> Column:
    """The bucket of every feature of an array of words: each word, and each two that follow one another."""
    at = lambda x: F.crc32(x.cast("binary")) % BUCKETS
    n = F.greatest(F.size(w) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: at(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(w, at), pairs)


def featured(df: DataFrame, text: str, *keep: Column) -> DataFrame:
    """The columns `keep` of df with n_words and `buckets` of its texts."""
    # bound by a function of its own, words are cut once, however often they are named
    each = F.transform(F.array(words(F.col(text))), lambda w: F.struct(F.size(w).alias("n"), buckets(w).cast("array<smallint>").alias("b")))[0]
    return df.select(*keep, each.alias("_f")).select(*[c for c in df.select(*keep).columns], F.col("_f.n").alias("n_words"), F.col("_f.b").alias("buckets"))


def totals(features: DataFrame) -> list[int]:
    """How many features fall into each bucket. Partial counts are added up before the shuffle, so a task sends at most BUCKETS rows; as many reach the driver."""
    out = [0] * BUCKETS
    for r in features.select(F.explode_outer("buckets").alias("b")).where("b is not null").groupBy("b").agg(F.count("*").alias("n")).collect():
        out[r.b] = r.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of a bucket's share among the target's features and the corpus's, one added to each bucket, rounded down."""
    s, t = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((y + 1.0) * s / ((x + 1.0) * t))) for x, y in zip(corpus, target)]


def weight(b: Column, gain: list[int]) -> Column:
    """The mean gain of a document's buckets, rounded down; 0 of none. The gains stand in the plan as one literal array."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(b, F.lit(0).cast("bigint"), lambda acc, x: acc + F.element_at(table, (x + 1).cast("int")))
    n = F.size(b).cast("bigint")
    return F.when(n > 0, F.transform(F.array(total), lambda s: _floored(s, n))[0]).otherwise(F.lit(0)).cast("bigint")


def _floored(total: Column, n: Column) -> Column:
    """total / n rounded down, in whole numbers."""
    n = F.greatest(n, F.lit(1))
    return F.call_function("div", total - F.pmod(total, n), n)


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, fixed by the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """Draw `percent` of the documents of `least_words` words or more, without replacement, in proportion to how much likelier their features are in target than in docs.

    Returns one row per row of docs: id, n_features, weight, score and rank (1 for the
    highest score among those drawn; null for the rest), all but id bigint. Ties go to the smaller id, a null
    id last, then to fewer features. A null or blank text has no features and weight 0. Rows
    that repeat an id are documents each, with the same noise; a null id counts as an empty one in the noise. Other
    columns of either table are ignored; an empty target leaves gains that only even docs out, an empty docs gives no rows.

    Method: higher-order functions make the array of a document's buckets; the totals of
    buckets are all that is shuffled to learn the gains, and each document is scored inside
    its own row, without exploding it, by an aggregate over a literal array of BUCKETS gains.
    Scores are whole thousandths within some tens of thousands, whatever the corpus, so their
    histogram is small: it gives the lowest score drawn, and only rows that reach it are put in order, by ranges.
    Texts are read once: their bucket arrays (two bytes a feature, about as large as the compressed texts) are written for the second pass.
    """
    scratch = scratch or Scratch(docs.sparkSession, "importance")
    own = scratch.keep(featured(docs, text, F.col(id_col).alias("id")), "buckets")
    gain = gains(totals(own), totals(featured(target, text)))
    scored = own.select("id", "n_words", F.size("buckets").cast("bigint").alias("n_features"), weight(F.col("buckets"), gain).alias("weight"))
    scored = scratch.keep(scored.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scores")
    scratch.drop(own)
    eligible = F.col("n_words") >= least_words
    counts = sorted(((r.score, r.n) for r in scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    left = draw = percent * sum(n for _, n in counts) // 100
    lowest = None
    for score, n in counts:
        if left <= 0:
            break
        lowest, left = score, left - n
    columns = [F.col(c) for c in ("id", "n_features", "weight", "score")]
    none = F.lit(None).cast("bigint").alias("rank")
    if lowest is None:
        return scored.select(*columns, none)
    high = eligible & (F.col("score") >= lowest)
    ranked = numbered(scored.where(high).select(*columns), [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features").asc()], scratch, "drawn")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return ranked.select(*columns, "rank").unionByName(scored.where(~high).select(*columns, none))
