"""Places of rows in an order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch

#: Bits of monotonically_increasing_id that count rows inside a partition.
_ROW_BITS = 33


def in_order(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """df with `part` and `at`: the rows lie in `part`s that follow one another in the order, and `at` counts from 0 inside each.

    Rows are dealt by ranges of the order; a last key that no two rows share lets a range end
    anywhere, so rows that are equal in the whole order do not gather in one partition. The
    result is a written table: a lost executor cannot deal the rows anew in another way."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, F.col("_tie")]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    row = F.col("_row")
    return scratch.keep(
        dealt.withColumn("_row", F.monotonically_increasing_id()).withColumns({"part": F.shiftright(row, _ROW_BITS), "at": row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}).drop("_row"), name
    )


def numbered(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """df with `rank`, 1 for the first of all rows in the order. Only the sizes of partitions, one number for each, meet on the driver."""
    placed = in_order(df, order, scratch, name)
    sizes = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    before, total = [0] * (sizes[-1][0] + 1 if sizes else 1), 0
    for part, n in sizes:
        before[part] = total
        total += n
    offset = F.element_at(F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>"), (F.col("part") + 1).cast("int"))  # one literal
    return placed.withColumn("rank", (offset + F.col("at") + 1).cast("bigint")).drop("part", "at")
