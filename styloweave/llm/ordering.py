"""Neighbours in a global order, without bringing a hot group into one task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from styloweave.llm.storage import stored


def with_neighbours(keys: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
    """`keys` with `prev_<c>` and `next_<c>` of the columns `carried`, in the order of `order`.

    The rows are dealt by ranges of the whole order, so a group of equal leading keys spreads over
    as many tasks as it needs. The carried columns hold no nulls. Rows at the ends of a range meet their neighbours in a table of two
    rows for each range.
    """
    fields = [f for f in keys.schema.fields if f.name in carried]
    kinds = {f.name: f.dataType.simpleString() for f in fields}
    extra = "".join(f", {side}_{c} {kinds[c]}" for side in ("prev", "next") for c in carried)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields) + extra \
        + ", range_id int, is_first boolean, is_last boolean"

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        range_id, last, pending = TaskContext.get().partitionId(), None, None
        for frame in frames:
            if not len(frame):
                continue
            frame = frame.reset_index(drop=True)
            frame["range_id"], frame["is_first"], frame["is_last"] = range_id, False, False
            for c in carried:
                values = frame[c].tolist()
                frame[f"prev_{c}"] = pd.Series([None, *values[:-1]], dtype=object)
                frame[f"next_{c}"] = pd.Series([*values[1:], None], dtype=object)
            if last is None:
                frame.loc[0, "is_first"] = True
            else:
                for c in carried:
                    frame.at[0, f"prev_{c}"] = last[c]
                    pending.at[0, f"next_{c}"] = frame.at[0, c]
                yield pending
            last = frame.iloc[-1]
            pending = frame.iloc[-1:].reset_index(drop=True)
            yield frame.iloc[:-1]
        if pending is not None:
            pending["is_last"] = True
            yield pending

    rows = stored(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(local, schema))
    # the first row's predecessor is the last row of the range before, and the other way round
    met = rows.where("is_first OR is_last")
    first = met.where("is_first").select("range_id", *[F.col(c).alias(f"first_{c}") for c in carried])
    last = met.where("is_last").select("range_id", *[F.col(c).alias(f"last_{c}") for c in carried])
    line = Window.orderBy("range_id")
    bridge = first.join(last, "range_id").select(
        "range_id", *[F.lag(f"last_{c}").over(line).alias(f"before_{c}") for c in carried],
        *[F.lead(f"first_{c}").over(line).alias(f"after_{c}") for c in carried])
    joined = rows.join(bridge, "range_id", "left")
    return joined.select(
        *keys.columns,
        *[F.when(F.col("is_first"), F.col(f"before_{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}")
          for c in carried],
        *[F.when(F.col("is_last"), F.col(f"after_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}")
          for c in carried])
