"""The trie of conversation prefixes, by smallest-member ownership of path suffixes."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranks import in_order
from .scratch import Scratch

#: Conversations that share a base, and the most turns (less one) taken over from it.
FAMILY, HEADS = 20, 4
#: Turns of one conversation that a window sees together.
BLOCK = 4096
#: A node with more than one in HOT of all turns is handled apart; fewer than HOT are that large.
HOT = 20_000
#: Ids that are joined to one string before they are hashed.
IDS = 4096
_NOTHING = hashlib.sha256(b"").hexdigest()


def _turns(talks: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, turn, role, name, words): names are hashes of whole texts, so that texts are read once and never shuffled."""
    said = F.coalesce(F.col(text), F.lit(""))
    n_words = F.size(F.array_remove(F.split(said, r"[\x20\x09-\x0D]+"), ""))
    own = talks.where(F.col(conv).isNotNull())
    return own.select(F.col(conv).cast("bigint").alias("c"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.sha2(said.cast("binary"), 256).alias("name"), n_words.cast("bigint").alias("words"))


def _heads_of(c: Column) -> Column:
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(HEADS))


def _placed(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns with `part` and `at` of their order, and a row (c, part, first, before, n) for each conversation and part that holds some of it."""
    order = [F.col("c").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("name").asc()]
    rows = in_order(turns, order, scratch, "turns")
    runs = rows.groupBy("c", "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    of = Window.partitionBy("c")
    runs = runs.select("c", "part", "first", (F.sum("here").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")).alias("before"), F.sum("here").over(of).alias("n"))
    return rows, runs


def _rebuilt(talks: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(c, depth, name of the turn, words) of every rebuilt turn, and (c, length) of every conversation."""
    rows, runs = _placed(talks, scratch)
    runs = scratch.keep(runs.withColumn("base", F.col("c") - F.col("c") % FAMILY), "runs")
    sizes = runs.groupBy("c").agg(F.max("n").alias("n"))
    bases = sizes.select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    # h turns are asked of the base, `head` of them are there
    runs = runs.join(bases, "base", "left").withColumn("h", _heads_of(F.col("c"))).withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))))
    runs = scratch.keep(runs.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "lengths")
    place = (F.col("before") + F.col("at") - F.col("first") + 1).alias("place")
    own = rows.join(runs, ["c", "part"]).select("c", "role", "name", "words", place, "h", "head")
    kept = own.where("place > h").select("c", (F.col("place") - F.col("h") + F.col("head")).alias("depth"), "role", "name", "words")
    members = runs.select("c", "base", "head", "length").distinct()
    first = own.where(F.col("place") < HEADS).where(F.col("c") % FAMILY == 0).select(F.col("c").alias("base"), "role", "name", "words", "place")
    taken = first.join(members.where("head > 0"), "base").where("place <= head").select("c", F.col("place").alias("depth"), "role", "name", "words")
    return kept.unionByName(taken), members.select("c", "length")


def _summed(turns: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each conversation and depth, 0 included: the key of its prefix (k1, k2), the words of the turn, those before it and those of all turns, and the length.

    A key is the exclusive or of 128-bit hashes of place and turn up to the depth: a sum that windows over blocks of turns and one over the blocks' totals give together."""
    h = lambda seed: F.xxhash64(F.lit(seed), "depth", "role", "name")
    block = F.floor((F.col("depth") - 1) / BLOCK).alias("block")
    rows = turns.select("c", "depth", block, h(1).alias("h1"), h(2).alias("h2"), "words")
    up = Window.partitionBy("c", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = scratch.keep(rows.select("c", "block", "depth", "words", *[F.bit_xor(x).over(up).alias(x) for x in ("h1", "h2")], F.sum("words").over(up).alias("upto")), "blocks")
    last = inside.groupBy("c", "block").agg(*[F.max_by(x, "depth").alias(f"{x}_") for x in ("h1", "h2")], F.max("upto").alias("all_"))
    of = Window.partitionBy("c").orderBy("block")
    earlier = of.rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("c", "block", *[F.coalesce(F.bit_xor(f"{x}_").over(earlier), F.lit(0)).alias(f"{x}_") for x in ("h1", "h2")], F.coalesce(F.sum("all_").over(earlier), F.lit(0)).alias("before_"), F.sum("all_").over(Window.partitionBy("c")).alias("total"))
    carried = scratch.keep(carried.join(members, "c"), "carried")
    deep = inside.join(carried, ["c", "block"]).select(
        "c", "block", "depth", F.col("h1").bitwiseXOR(F.col("h1_")).alias("k1"), F.col("h2").bitwiseXOR(F.col("h2_")).alias("k2"), (F.col("before_") + F.col("upto") - F.col("words")).alias("before"), "total", "length"
    )
    zero = F.lit(0).cast("bigint")
    roots = members.join(carried.select("c", "total").distinct(), "c", "left").select("c", zero.alias("block"), zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("before"), F.coalesce("total", zero).alias("total"), "length")
    return scratch.keep(deep.unionByName(roots), "paths")


NODE = ["k1", "k2", "depth"]


def _owned(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """paths with `low`, the smallest member of each node, and `longest`, the greatest length of a member.

    Windows mark the members of a node. The few nodes that hold a large part of all rows, such as the
    root, are summed up before the shuffle instead, and joined by broadcast: fewer than HOT nodes are that large."""
    size = paths.groupBy(*NODE).agg(F.count("*").alias("size"), F.min("c").alias("low"), F.max("length").alias("longest"))
    hot = scratch.keep(size.where(F.col("size") * HOT > paths.count()).drop("size"), "hot", rows=HOT)
    large = paths.join(F.broadcast(hot), NODE)
    small = paths.join(F.broadcast(hot), NODE, "left_anti")
    of = Window.partitionBy(*NODE)
    small = small.select("*", F.min("c").over(of).alias("low"), F.max("length").over(of).alias("longest"))
    return scratch.keep(large.unionByName(small.select(*large.columns)), "owned")


def _ends(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """The SHA-256 of the ascending ids that end at each node. Ids are joined to strings of IDS at most, which one reader of a node takes up in turn, so no task holds a large node whole."""
    ended = in_order(paths.where("depth = length").select(*NODE, "c"), [F.col(x).asc() for x in (*NODE, "c")], scratch, "ends")
    cut = ended.withColumn("piece", F.floor(F.col("at") / IDS)).groupBy(*NODE, "part", "piece").agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("ids"))
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        node, sha = None, None
        for b in batches:
            out = []
            for *key, ids in zip(*[b.column(k).to_pylist() for k in range(4)]):
                if sha is not None and key == node:
                    sha.update(b",")
                else:
                    if sha is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), x)) for x in out], schema=schema)
        if sha is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), (*node, sha.hexdigest())))], schema=schema)

    schema = pa.schema([*[(k, pa.int64()) for k in NODE], ("ends_sha256", pa.string())])
    return cut.repartition(parts, *NODE).sortWithinPartitions(*NODE, "part", "piece").select(*NODE, "ids").mapInArrow(run, "k1 bigint, k2 bigint, depth bigint, ends_sha256 string")


def prefix_trie(talks: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, one row each.

    Conversation c is rebuilt as the first h turns of conversation c - c % FAMILY (signed
    remainder; all it has if fewer, none if absent), h = crc32(c) % HEADS, then its own turns after its first h.
    Turns are ordered by turn, null first; ties by role and then by the SHA-256 of the text, and rows
    that repeat a turn are turns each. A null role or text is empty. Rows without a conversation
    id belong to none and are left out. Other columns are ignored. Without conversations there is no node.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256, as the contract of the query names them.

    Method: the smallest member of a node owns it. Members of a node below are members of
    those above, so a conversation owns the end of its path, from some depth on: a node is
    (owner, depth). Hence what lies in a subtree is told by its members alone: the words of all
    their turns from its depth on, less those of the turns that each of them owns there, are
    what is saved; a member that owns a leaf adds one leaf, one that owns the next depth one child. One group-by of the
    prefixes, partly summed before the shuffle, adds these up. No conversation, node or
    family is gathered in one task: places come from ranges of the order, prefix sums from blocks of
    turns, and nodes with a large part of all rows are summed up first.
    """
    scratch = scratch or Scratch(talks.sparkSession, "trie")
    turns, members = _rebuilt(_turns(talks, conv, turn, role, text), scratch)
    paths = _summed(turns, members, scratch)
    owned = _owned(paths, scratch)
    mine = F.col("c") == F.col("low")
    # where each conversation's own part begins, and the owner of the node before it
    part = owned.groupBy("c", "block").agg(
        F.min(F.when(mine, F.col("depth"))).alias("own"),
        F.min(F.when(mine, F.col("before"))).alias("own_before"),
        F.max_by(F.when(~mine, F.col("low")), F.when(~mine, F.col("depth"))).alias("above"),
        F.max(F.when(~mine, F.col("depth"))).alias("above_depth"),
        F.max((mine & (F.col("depth") == F.col("length")) & (F.col("longest") == F.col("length"))).cast("bigint")).alias("leaf"),
    )
    of = Window.partitionBy("c")
    known = part.select(
        "c", "block", F.min("own").over(of).alias("own"), F.min("own_before").over(of).alias("own_before"), F.max_by("above", "above_depth").over(of).alias("above"), F.max("leaf").over(of).alias("leaf")
    )
    d, own = F.col("depth"), F.col("own")
    each = owned.join(known, ["c", "block"]).select(
        *NODE,
        "c",
        "leaf",
        F.coalesce((own <= d + 1) & (d < F.col("length")), F.lit(False)).cast("bigint").alias("child"),
        # words from here on, less those of turns owned from here on
        F.when(own.isNull(), F.col("total") - F.col("before")).otherwise(F.greatest("own_before", "before") - F.col("before")).alias("saved"),
        F.when(own == d, F.col("above")).when(own < d, F.col("c")).alias("parent"),
    )
    nodes = each.groupBy(*NODE).agg(
        F.min("c").alias("conv_id"),
        F.max("parent").alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.sum("child").alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    ends = _ends(paths, scratch)
    out = nodes.join(ends, NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))
