"""Dense global positions without a single-partition window (W3, W8, catalogue numbering).

Range-partition by the order key, sort inside partitions, and write the rows with their
partition and place in it (so these cannot shift on recompute), then add the
per-partition start offset from a tiny ``(partition, count)`` frame. Without a given
number, partitions follow the rows: Spark joins neighbouring ranges of a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import materialize

_LOW = (1 << 33) - 1


def global_index(df: DataFrame, order_cols, name: str = "idx", n_parts: int | None = None) -> DataFrame:
    """Add a 0-based dense position ``name`` in ascending ``order_cols`` order.

    ``order_cols`` must be unique per row. The only frame gathered in one
    place holds one row per partition.
    """
    order_cols = list(order_cols)
    ranges = df.repartitionByRange(*([n_parts] if n_parts else []), *order_cols).sortWithinPartitions(*order_cols)
    tagged = materialize(ranges.withColumn("_mid", F.monotonically_increasing_id()), "ordered") \
        .withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_loc", F.col("_mid").bitwiseAND(F.lit(_LOW)))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_pid", "_off")
    out = tagged.join(F.broadcast(offsets), "_pid", "inner")
    return out.withColumn(name, F.col("_off") + F.col("_loc")).drop("_mid", "_pid", "_loc", "_off")
