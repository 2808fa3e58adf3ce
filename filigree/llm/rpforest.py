"""Cosine self-join of vectors by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chosenpath import _grouped
from .components import connected_components
from .scratch import Scratch, ship
from .textkit import relax

#: Vectors that a leaf should hold, and vectors that one task compares with as many others.
LEAF, TILE = 512, 4096
#: Chance that all trees miss a pair just at the threshold.
MISS = 1e-5
#: Most vectors that the thresholds of the splits are fitted on, and the fewest a split is fitted on.
SAMPLE, FIT = 65_536, 32
#: Levels whose nodes have thresholds of their own; below, the nodes under one of them share one for each level.
OWN = 11
#: Overlap on either side of a split, in standard deviations of a linked pair's difference along a random direction, and the largest part of a node that may lie in it.
SPILL, SHARED = 0.5, 0.4
#: Rows of a product of matrices, by how much single precision may err on a cosine, and steps of a projection to one.
ROWS, ERROR, GRID = 256, 2e-5, 1 << 16


def _values(vectors: DataFrame, id_col: str, column: str) -> tuple[DataFrame, type]:
    """(id, vec): the components as bytes, null for a vector that is null, empty, zero or has a null or non-finite component; and the components' type."""
    single = vectors.schema[column].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(1):
                v = x.values if x.is_valid else None
                v = None if v is None or v.null_count else v.to_numpy(zero_copy_only=False)
                out.append(v.tobytes() if v is not None and v.any() and np.isfinite(v).all() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "vec"])
            relax()

    v = F.col(column) if single else F.col(column).cast("array<double>")
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).mapInArrow(run, "id bigint, vec binary"), kind


def _matrix(column, dim: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, filled up with zeros to dim, and their lengths."""
    raw = column.to_pylist()
    n = np.array([len(b) // np.dtype(kind).itemsize for b in raw], np.int64)
    if len(n) and (n == dim).all():
        out = np.frombuffer(b"".join(raw), kind).reshape(len(n), dim).astype(np.float64)
    else:
        out = np.zeros((len(n), dim))
        for i, b in enumerate(raw):
            out[i, : n[i]] = np.frombuffer(b, kind)
    if len(n):
        out /= np.abs(out).max(1, keepdims=True)
        out /= np.sqrt((out * out).sum(1, keepdims=True))
    return out, n


class Forest:
    """Trees whose levels split along random directions, at thresholds fitted on a sample.

    A tree has one random direction for each level; each node splits its vectors near their
    median along it, and vectors within `spill` of the threshold go to both sides. The place of the
    threshold is the one of the middle quantiles with the fewest vectors in the overlap; where even
    there more than SHARED of them lie in it, as inside a dense group, the node is a leaf.
    Thresholds below level OWN are shared by the nodes under one node of that level, so the model's size is bounded
    whatever the number of vectors: trees * 2^OWN * (2 + levels below) doubles."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float, seed: int = 11):
        dim = sample.shape[1] if len(sample) else 1
        self.levels = max(0, math.ceil(math.log2(max(n, 1) / LEAF)))
        gap = math.sqrt(max(2 - 2 * cosine, 1e-4) / dim)
        self.spill = SPILL * gap
        # a pair at the threshold stays together at a split of unit vectors with this chance (normal differences, density of projections at the median)
        beyond = 2 * gap * (math.exp(-0.5 * (2 * SPILL) ** 2) / math.sqrt(2 * math.pi) - 2 * SPILL * 0.5 * math.erfc(2 * SPILL / math.sqrt(2)))
        stay = max(0.05, 1 - beyond * math.sqrt(dim / (2 * math.pi))) ** self.levels
        self.trees = 1 if self.levels == 0 else math.ceil(math.log(MISS) / math.log1p(-min(stay, 1 - MISS)))
        r = np.random.default_rng(seed)
        w = r.standard_normal((self.trees, self.levels, dim))
        self.w = w / np.maximum(np.linalg.norm(w, axis=2, keepdims=True), 1e-300)
        self.own = min(self.levels, OWN)
        self.at = np.full((self.trees, 1 << self.own), np.nan)  # by heap index below 2^own
        self.deep = np.full((self.trees, 1 << self.own, self.levels - self.own), np.nan)
        for t in range(self.trees):
            p = self._along(t, sample) if len(sample) else np.zeros((0, self.levels))
            self._grow(t, p, np.arange(len(sample)), 0, 1)

    def _along(self, t: int, x: np.ndarray) -> np.ndarray:
        """Projections on a grid, so that the last bits of a product, which depend on how many rows it has, never move a vector."""
        return np.round(x @ self.w[t].T * GRID) / GRID

    def _threshold(self, x: np.ndarray) -> float:
        if len(x) < FIT:
            return math.nan
        x = np.sort(x)
        cuts = np.quantile(x, np.linspace(0.3, 0.7, 9))
        inside = (np.searchsorted(x, cuts + self.spill) - np.searchsorted(x, cuts - self.spill)) / len(x)
        best = int(np.lexsort((np.abs(np.arange(9) - 4), np.round(inside, 2)))[0])
        return float(cuts[best]) if inside[best] <= SHARED else math.nan

    def _grow(self, t: int, p: np.ndarray, rows: np.ndarray, level: int, heap: int) -> None:
        if level == self.own:
            for k in range(level, self.levels):
                self.deep[t, heap - (1 << self.own), k - level] = self._threshold(p[rows, k])
            return
        cut = self._threshold(p[rows, level])
        self.at[t, heap] = cut
        if not math.isnan(cut):
            self._grow(t, p, rows[p[rows, level] < cut + self.spill], level + 1, 2 * heap)
            self._grow(t, p, rows[p[rows, level] >= cut - self.spill], level + 1, 2 * heap + 1)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaf names of unit vectors: a vector has a name for every leaf of every tree that it comes to."""
        rows, names = [], []
        for t in range(self.trees):
            p = self._along(t, x)
            row, heap, live = np.arange(len(x)), np.ones(len(x), np.int64), np.ones(len(x), bool)
            for k in range(self.levels):
                if k < self.own:
                    cut = np.where(live, self.at[t, np.where(live, heap, 0)], np.nan)
                else:
                    above = np.where(live, (heap >> (k - self.own)) - (1 << self.own), 0)
                    cut = np.where(live, self.deep[t, above, k - self.own], np.nan)
                live = ~np.isnan(cut)
                v = p[row, k]
                left, right = live & (v < cut + self.spill), live & (v >= cut - self.spill)
                row = np.concatenate([row[~live], row[left], row[right]])
                heap = np.concatenate([heap[~live], 2 * heap[left], 2 * heap[right] + 1])
                live = np.concatenate([np.zeros((~live).sum(), bool), np.ones(left.sum() + right.sum(), bool)])
            rows.append(row)
            names.append(heap + (t << 48))
        return np.concatenate(rows), np.concatenate(names)


def _unite(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots (the smallest of each part) after u and v are joined pair by pair."""
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(low := root[root], root):
            root = low


def _compare(sent, dim: int, kind: type, cosine: float):
    """Counts of links and a star for each connected part, of the tiles of leaves. A pair that shares several leaves is counted in the one of the smallest name alone, so counts of all leaves add up."""

    def sides(side):
        return (np.arange(len(side)),) * 2 if side[0] == 0 else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))

    def blocks(f, side):
        """Rows and columns of products that may reach the threshold, block by block; each pair once."""
        lo, hi = sides(side)
        for i in range(0, len(lo), ROWS):
            a = lo[i : i + ROWS]
            b = hi[i:] if side[0] == 0 else hi
            s = f[a] @ f[b].T
            p, q = np.nonzero(s >= cosine - ERROR)
            u, v = a[p], b[q]
            k = u < v if side[0] == 0 else slice(None)
            yield u[k], v[k], s[p, q][k]

    def elsewhere(x, leaf):
        """For each vector, marks of the leaves of smaller names that it lies in."""
        row, name = sent.value.leaves(x)
        row, name = row[name < leaf], name[name < leaf]
        kinds, column = np.unique(name, return_inverse=True)
        marks = np.zeros((len(x), len(kinds)), np.float32)
        marks[row, column] = 1
        return marks

    def run(batches):
        for g in _grouped(batches, "task"):
            t = pa.Table.from_batches(g).combine_chunks()
            side = t.column("side").to_numpy()
            x, n = _matrix(t.column("vec"), dim, kind)
            f = x.astype(np.float32)
            used = np.zeros(len(f), bool)
            for u, v, _ in blocks(f, side):
                used[u] = used[v] = True
            if not used.any():
                continue
            used = np.flatnonzero(used)
            x, n, f, side, copies = x[used], n[used], f[used], side[used], t.column("copies").to_numpy()[used]
            marks = elsewhere(x, t.column("leaf")[0].as_py())
            links, root = np.zeros(len(f), np.int64), np.arange(len(f))
            for u, v, s in blocks(f, side):
                ok = n[u] == n[v]
                near = np.flatnonzero(ok & (s < cosine + ERROR))
                ok[near] = (x[u[near]] * x[v[near]]).sum(1) >= cosine
                u, v = u[ok], v[ok]
                if not len(u):
                    continue
                root = _unite(root, u, v)
                first = u.min()
                shared = marks[first : u.max() + 1] @ marks.T > 0
                new = ~shared[u - first, v]
                links += np.bincount(u[new], copies[v[new]], len(f)).astype(np.int64) + np.bincount(v[new], copies[u[new]], len(f)).astype(np.int64)
            fp = t.column("fp").take(pa.array(used)).combine_chunks()
            linked = pa.array(np.flatnonzero((links > 0) | (root != np.arange(len(f)))))
            out = pa.RecordBatch.from_arrays([fp, pa.array(links), fp.take(pa.array(root))], names=["fp", "links", "root"])
            yield out.take(linked)
            relax()

    return run


def cosine_components(vectors: DataFrame, *, id_col: str = "vec_id", column: str = "embedding", cosine: float = 0.9, scratch: Scratch | None = None) -> DataFrame:
    """Components of the graph that links vectors of cosine `cosine` or more, in double precision.

    Returns one row per input row: id, n_links (other rows linked with it directly),
    component_id (smallest id of a row it reaches, its own if none is smaller) and kept (id =
    component_id). Vectors that are null, empty, zero or hold a null or non-finite component are
    linked with nothing, and so are vectors of different lengths. Rows that repeat a vector are linked with one
    another, also under one id. A null id counts as larger than every other. Other columns are ignored.

    Method: rows of one vector are one node from the start. Random-projection trees (Forest)
    deal the nodes to leaves, with spill; as many trees as it takes to miss a pair at the
    threshold with chance MISS. A leaf of more than TILE nodes is dealt to pairs of tiles, which
    bounds a task but loses none of its pairs. Leaves are compared by products of matrices in single precision; a product
    within ERROR of the threshold is computed again in double. Links are counted where they are
    found, never emitted: a pair of several leaves counts in one of them, which each task tells from the
    forest alone. Connected parts of leaves leave as stars, united by connected components.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "forest")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read, kind = _values(vectors, id_col, column)
    rows = scratch.keep(read.withColumn("fp", F.unhex(F.substring(F.sha2("vec", 256), 1, 32))), "rows")
    reps = scratch.keep(rows.where("fp is not null").groupBy("fp").agg(F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("id").alias("low")), "vectors")
    n, dim = reps.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    dim = (dim or 0) // np.dtype(kind).itemsize or 1
    # a bounded sample: hashes of the names decide, so it is the same in every run
    share = F.pmod(F.xxhash64("fp"), F.lit(max(n, 1))) < SAMPLE
    sample = reps.where(share).select("vec").limit(2 * SAMPLE).toArrow().column("vec")
    forest = Forest(_matrix(sample, dim, kind)[0], n, cosine)
    sent = spark.sparkContext.broadcast(forest)

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            row, leaf = sent.value.leaves(_matrix(b.column(1), dim, kind)[0])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *[b.column(k).take(at) for k in range(3)]], names=["leaf", "fp", "vec", "copies"])
            relax()

    placed = reps.select("fp", "vec", "copies").mapInArrow(place, "leaf bigint, fp binary, vec binary, copies bigint")
    sizes = scratch.keep(placed.groupBy("leaf").agg(F.count("*").alias("size")).where(F.col("size") > TILE), "large")
    tiles = F.ceil(F.coalesce("size", F.lit(1)) / TILE)
    dealt = placed.join(sizes, "leaf", "left").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles")).withColumn("to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    low, high = F.least("tile", "to"), F.greatest("tile", "to")
    tasks = dealt.select(F.xxhash64("leaf", low, high).alias("task"), "leaf", "fp", "vec", "copies", F.when(F.col("tile") == F.col("to"), 0).when(F.col("tile") < F.col("to"), 1).otherwise(2).alias("side"))
    found = scratch.keep(tasks.repartition(parts, "task").sortWithinPartitions("task", "leaf").mapInArrow(_compare(sent, dim, kind, cosine), "fp binary, links bigint, root binary"), "links")
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    parts_of = scratch.keep(connected_components(found.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b")), scratch), "parts")
    labelled = reps.select("fp", "copies", "low").join(links, "fp", "left").join(parts_of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    by_vector = labelled.join(least, "component").select("fp", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    root = F.coalesce("component_id", "id")
    done = rows.select("id", "fp").join(by_vector, "fp", "left")
    return done.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), root.alias("component_id"), F.col("id").eqNullSafe(root).alias("kept"))
