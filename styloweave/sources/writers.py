"""Sinks: corpora by category, tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_corpus(docs: DataFrame, folder: str, overwrite: bool = True,
                 rows_per_file: int = 1_000_000) -> None:
    """`doc_id, text` partitioned by category; the commit makes it visible at once.

    Rows are written where they are: no shuffle puts a large category into one task.
    """
    (docs.select("doc_id", "text", "model_category").write
     .mode("overwrite" if overwrite else "errorifexists")
     .option("maxRecordsPerFile", rows_per_file)
     .partitionBy("model_category").parquet(folder))


def write_enriched(docs: DataFrame, folder: str) -> None:
    (docs.select("doc_id", "text", "model_full", "model_category", "text_type", "word_count")
     .write.mode("overwrite").parquet(folder))


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV with a header, in as many files as there are partitions."""
    df.write.mode("overwrite").option("header", True).csv(folder)


def flattened(df: DataFrame) -> DataFrame:
    """Arrays and maps as JSON text, for sinks such as CSV."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct"))
                       else F.col(f"`{c}`") for c, t in df.dtypes])


def write_vocabs(spark: SparkSession, vocabs: dict[str, list[str]], folder: str) -> None:
    """One word list `<feature>.txt` per vocabulary, in any store that Spark can write to."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for feature, words in vocabs.items():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{feature}.txt")
        out = path.getFileSystem(conf).create(path, True)
        try:
            out.write(bytearray("".join(f"{w}\n" for w in words).encode()))
        finally:
            out.close()
