"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest v of each u. u is named through an aggregate, so that a join on it gets an exchange of its own: only then can adaptive execution split a hub's edges."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.min("u").alias("name")).select(F.col("name").alias("u"), "m")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Label each node of an undirected graph with the smallest node it can reach.

    edges has columns `a` and `b` of one orderable type; null ends and loops are ignored,
    repeated edges count once. Returns (node, component), one row per node that has a
    proper edge; an empty graph gives an empty frame.

    Each step replaces edges by edges to a neighbourhood's smallest node (Kiveris et al.,
    "Connected components in MapReduce and beyond"). The neighbourhood minimum is an
    aggregate with a map-side part, and the step back to the edges is an equi-join of
    many edges with one row per node, whose exchanges adaptive execution can split: a hub
    with a third of all edges never becomes one group in one task. Each step ends in a
    written table, so a lost executor costs one step. Steps go on until one changes
    nothing (in the order of the squared logarithm of the nodes), so no label is left unfinished.
    """
    now = scratch.keep(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct(),
        "edges",
    )
    state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        # large star: every larger neighbour of u is tied to the smallest of u's neighbourhood
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        least = _lowest(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = scratch.keep(small.where("u <> v").distinct(), "edges", rows=2 * state[0])
        scratch.drop(now)
        fresh = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = after
        if fresh == state:
            break
        state = fresh
    # at the fixed point every node but the root has one edge, to its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
