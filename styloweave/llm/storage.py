"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from styloweave.session import shared_folder


def stored(df: DataFrame) -> DataFrame:
    """`df`, written as Parquet below `spark.checkpoint.dir` and read again: cuts the lineage.

    The files survive a lost executor and are visible to all. Sets no limit on rows. Results are read
    from them when they are asked for, so they stay until the owner of that folder clears `tables/`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """`name`, or with marks behind it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
