"""Approximate dense search: an inverted file of k-means cells, of which a question probes the nearest, with exact scores."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filigree.operators.blocks import ASKED_VECTORS, VECTORS, _blocks, _found, _one, _row, _types
from filigree.runtime import ship

#: Vectors that the cells are fitted on, at most; most cells, which bound what is broadcast; rows of one cell go to SALTS tasks.
SAMPLE, CELLS, SALTS = 65_536, 4096, 16


class Cells:
    """Centres of cells (unit vectors), fitted by k-means on a bounded sample of rows whose vector is not null."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    @classmethod
    def fit(cls, rows: DataFrame, vector: str = "embedding", k: int | None = None, seed: int = 5) -> Cells:
        """k cells, about four times the square root of the number of rows if k is not given. Without rows there is one cell."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        some = rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
        n = some.count()
        k = max(1, min(CELLS, k or math.ceil(4 * math.sqrt(n)), n))
        if k == 1:
            return cls(np.zeros((1, 1)))
        if n > SAMPLE:
            some = some.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(n)) < SAMPLE)
        model = KMeans(k=k, seed=seed, maxIter=10, featuresCol="f").fit(some.select(array_to_vector("v").alias("f")))
        c = np.array(model.clusterCenters())
        return cls(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12))

    def near(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, by inner product."""
        if len(self.centres) == 1:
            return np.zeros((len(vectors), 1), np.int32)
        s = vectors @ self.centres.T
        n = min(n, s.shape[1])
        return np.argpartition(-s, n - 1, axis=1)[:, :n].astype(np.int32)

    def _named(self, df: DataFrame, vector: str, n: int) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("array<int>")
        def cells(column: pa.Array) -> pa.Array:
            some = column.is_valid().to_numpy(zero_copy_only=False)
            out: list = [None] * len(column)
            if some.any():
                flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                for i, x in zip(np.flatnonzero(some), sent.value.near(flat.reshape(int(some.sum()), -1), n)):
                    out[i] = x.tolist()
            return pa.array(out, pa.list_(pa.int32()))

        return df.select("*", F.explode(cells(F.col(vector))).alias("cell"))

    def placed(self, rows: DataFrame, vector: str = "embedding") -> DataFrame:
        """rows with `cell`, to be written by it; rows without a vector have none and are left out."""
        ship(rows.sparkSession)
        return self._named(rows, vector, 1)

    def topk(self, queries: DataFrame, placed: DataFrame, k: int, probes: int) -> DataFrame:
        """(qid, id, score): rows of the cells that each of queries (qid, vector) probes which may be among its k best by inner product; exact scores, a few more than k.

        placed is (id, embedding, cell). Where it lies by cell, cells that no question probes are not read. Rows and questions of a
        cell meet in packed blocks, those of a large cell in several tasks."""
        ship(placed.sparkSession)
        asked = self._named(queries, "vector", probes)
        cells = asked.select("cell").distinct()
        rows = placed.join(F.broadcast(cells), "cell", "left_semi")
        both = _packed(rows, "id", "embedding", VECTORS).join(_packed(asked, "qid", "vector", ASKED_VECTORS).withColumnsRenamed({"ids": "qids", "m": "qm"}), "cell").select("ids", "m", "qids", "qm")

        def search(batches):
            for b in batches:
                for r in range(b.num_rows):
                    ids, names = b.column(0)[r].values, b.column(2)[r].values
                    v, q = (np.frombuffer(b.column(c)[r].as_py(), np.float32).reshape(n, -1).astype(np.float64) for c, n in ((1, len(ids)), (3, len(names))))
                    yield _found(names, ids, v @ q.T, k, {}, False)

        return both.mapInArrow(search, _types(queries, placed))


def _packed(rows: DataFrame, id_col: str, vector: str, size: int) -> DataFrame:
    """(cell, ids, m): blocks of rows of one cell."""
    kind = rows.schema[id_col].dataType.simpleString()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches):
        for t in _blocks(batches, size):
            cell = t.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for a, b in zip(cuts, cuts[1:]):
                part = t.slice(a, b - a)
                row = _row(ids=_one(part.column(1)), m=_one(_one(part.column(2)).flatten()).to_numpy(zero_copy_only=False).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([int(cell[a])], pa.int32()), *row.columns], names=["cell", "ids", "m"])

    dealt = rows.select("cell", F.col(id_col).alias("id"), F.col(vector).alias("v")).repartition(parts, "cell", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("cell")
    return dealt.mapInArrow(pack, f"cell int, ids array<{kind}>, m binary")
