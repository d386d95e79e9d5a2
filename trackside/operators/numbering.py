"""Numbers along an order that is already there, without bringing the rows together."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside.session import materialise

# Spark's growing ids: the partition's number above, the row's number in it below.
ROW_BITS = 33


def numbered(df: DataFrame, column: str = "position") -> DataFrame:
    """``df`` with ``column`` from 1 in the order in which its rows come.

    A sort leaves ranges in partitions, one after the other. Rows are written with their number inside the partition;
    the rows of all partitions before are added from one count per partition.
    """
    marked = materialise(df.withColumn("_seen", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_seen", ROW_BITS).cast("int")
    counts = sorted((r.part, r.n) for r in marked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    offsets = [(p, b) for (p, _), b in zip(counts, before)]
    offsets = df.sparkSession.createDataFrame(offsets, "_part int, _before bigint")
    inside = F.col("_seen").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    numbered = marked.withColumn("_part", part).join(offsets, "_part").withColumn(column, F.col("_before") + inside + 1)
    return numbered.drop("_part", "_before", "_seen")
