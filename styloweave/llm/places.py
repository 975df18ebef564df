"""Each row's place in its group, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from styloweave.llm.storage import stored
from styloweave.session import broadcast_if_small

_ROW_BITS = 33  # of monotonically_increasing_id: the row within its partition


def placed(rows: DataFrame, key: str, order: list) -> DataFrame:
    """`rows` with `idx`, the place within `key` by `order` from 0, and `n`, the rows of the key.

    The rows are dealt by ranges of the whole order, so a key that holds most rows spreads over all
    tasks. A range is counted by key; the running sums of these counts, one row for each range and
    key in it, give each range its first place. `key` holds no nulls.
    """
    keys = [F.col(key), *order]
    dealt = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                   .withColumn("at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("part", F.shiftright("at", _ROW_BITS))
    counts = dealt.groupBy(key, "part").agg(F.min("at").alias("lowest"), F.count("*").alias("held"))
    line = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(key, "part", "lowest", F.coalesce(F.sum("held").over(line), F.lit(0)).alias("before"),
                          F.sum("held").over(Window.partitionBy(key)).alias("n"))
    return dealt.join(broadcast_if_small(first), [key, "part"]) \
        .select(*rows.columns, (F.col("before") + F.col("at") - F.col("lowest")).alias("idx"), "n")
