"""Stored vectors, keyed by configuration, vocabulary and input.

The key covers the data: another input, limit or vocabulary gives another path, so a stored
result is never reused for something else.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from styloweave.session import broadcast_if_small


def config_hash(config: dict, include_items: list | None = None) -> str:
    """First 12 hex digits of the md5 of the sorted JSON and any further items."""
    text = json.dumps(config, sort_keys=True) + "".join(str(x) for x in include_items or [])
    return hashlib.md5(text.encode()).hexdigest()[:12]


def input_fingerprint(docs: DataFrame, columns: list[str] = ("doc_id", "text")) -> str:
    """Row count and order-free hash sum of an input, in one pass without a shuffle of rows."""
    h = F.xxhash64(*columns).cast("decimal(20,0)")
    row = docs.agg(F.count("*").alias("n"), F.sum(h).alias("h")).first()
    return f"{row['n']}-{row['h'] or 0}"


def vocab_fingerprint(vocabs: dict[str, list[str]]) -> str:
    return hashlib.md5(json.dumps(vocabs, sort_keys=True).encode()).hexdigest()


def vectors_path(folder: str, split: str, key: str, tag: str | None = None) -> str:
    name = "_".join(["vectors", *([tag] if tag else []), split, key])
    return f"{folder.rstrip('/')}/{name}.parquet"


def load_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored vectors, or None. An unfinished write has no visible files, so counts as none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def save_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def is_stored(spark: SparkSession, path: str) -> bool:
    return load_vectors(spark, path) is not None


def get_or_compute(spark: SparkSession, folder: str, split: str, config: dict,
                   build: Callable[[], DataFrame], *, depends_on: list[str] = (),
                   tag: str | None = None, use_stored: bool = True) -> DataFrame:
    """Stored result for this key, or compute, store and read it back.

    `depends_on` takes fingerprints of the input and the vocabulary. Reading back cuts the
    lineage: later jobs survive lost executors without computing features again.
    """
    if not use_stored:
        return build()
    path = vectors_path(folder, split, config_hash(config, list(depends_on)), tag)
    stored = load_vectors(spark, path)
    if stored is not None:
        return stored
    save_vectors(build(), path)
    return spark.read.parquet(path)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """`key, files, bytes` of stored vectors, by the last part of the stored name."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.parquet").load(folder).select("path", "length"))
    key = F.regexp_extract("path", r"/vectors_[^/]*_([0-9a-z]+)\.parquet(?:/|$)", 1)
    return (files.select(key.alias("key"), "length").where("key <> ''").groupBy("key")
            .agg(F.count("*").alias("files"), F.sum("length").alias("bytes")))


# ------------------------------------------------------------------------- by parts of the input
MANIFEST = "part_key string, path string"


@dataclass
class Parts:
    """Stored rows of all present files, and how many files had to be computed for them.

    A folder is new if one of its files is.
    """

    rows: DataFrame
    new: int
    kept: int
    new_folders: int = 0
    kept_folders: int = 0


def part_key() -> Column:
    """Names a file by path, size and time of change; no content is read."""
    m = F.col("_metadata")
    return F.md5(F.concat_ws("|", m["file_path"], m["file_size"].cast("string"),
                             m["file_modification_time"].cast("string")))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    held = load_vectors(spark, path)
    return held if held is not None else spark.createDataFrame([], schema)


def get_or_compute_parts(spark: SparkSession, folder: str, source: str, config: dict,
                         build: Callable[[DataFrame], DataFrame], *, depends_on: list[str] = ()) -> Parts:
    """Stored results of the Parquet files below `source`; only new or changed files are computed.

    `build` gets the rows of new files with a column `part_key`, which its result must keep. A hit
    lists files and reads the table of finished parts, never a text. Parts that a broken
    run left behind are overwritten by the next one, as they are entered in that table last.
    The paths of new files pass the driver, as they do in any listing.
    """
    base = f"{folder.rstrip('/')}/parts_{config_hash(config, list(depends_on))}"
    docs = spark.read.parquet(source)
    files = docs.select(part_key().alias("part_key"), F.col("_metadata.file_path").alias("path")).distinct()
    done = _table(spark, f"{base}/manifest", MANIFEST)
    new = [(r["part_key"], r["path"]) for r in files.join(done.select("part_key"), "part_key", "left_anti").collect()]
    if new:
        rows = build(spark.read.schema(docs.schema).parquet(*[path for _, path in new])
                     .withColumn("part_key", part_key()))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("part_key").parquet(f"{base}/rows")
        spark.createDataFrame(new, MANIFEST).coalesce(1).write.mode("append").parquet(f"{base}/manifest")
    present = files.select("part_key")
    stored = load_vectors(spark, f"{base}/rows")
    total = present.count()
    fresh = len({path.rpartition("/")[0] for _, path in new})
    folders = files.select(F.regexp_extract("path", "^(.*)/", 1)).distinct().count()
    counts = (len(new), total - len(new), fresh, folders - fresh)
    if stored is None:          # no file has rows yet
        return Parts(build(docs.withColumn("part_key", part_key()).limit(0)), *counts)
    return Parts(stored.join(broadcast_if_small(present), "part_key", "left_semi"), *counts)
