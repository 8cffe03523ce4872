"""Row numbers over data of any size.

A window over one repository puts the whole repository into one task. These helpers number rows
by a range-partitioned sort plus per-partition offsets, so no task holds more than one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.session import stored

_SHIFT = 33  # monotonically_increasing_id keeps the partition number above this bit


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "position", per: str | None = None,
                start: int = 1) -> DataFrame:
    """Add a dense 1-based number in ``order``; with ``per``, numbering restarts for each key value.

    The sorted rows are written once, so partition numbers stay the same when tasks re-run.
    """
    keys = [F.col(per).asc(), *order] if per else list(order)
    ordered = stored(df.orderBy(*keys).withColumn("_mid", F.monotonically_increasing_id()))
    located = ordered.select("*", F.shiftright("_mid", _SHIFT).alias("_part"),
                             (F.col("_mid").bitwiseAND((1 << _SHIFT) - 1)).alias("_idx"))
    sizes = located.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per shuffle partition: bounded by the partition count, never by the data
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    numbered = located.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_idx"))
    if per:
        first = numbered.groupBy(per).agg(F.min(name).alias("_first"))
        numbered = numbered.join(first, per).withColumn(name, F.col(name) - F.col("_first"))
    return numbered.withColumn(name, F.col(name) + start).drop("_mid", "_part", "_idx", "_offset", "_first")
