"""Sources: corpora of documents, token tables, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from styloweave.functions import fixed_values as fv
from styloweave.functions import labels as lb
from styloweave.operators import sampling

DOCS = "doc_id string, text string"
TOKENS = ("doc_id string, sentence_id int, token_id int, token string, lemma string, pos string, "
          "tag string, head_token_id int, dep string")


def read_parquet_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All parquet files of a folder as one table; files may lack columns."""
    return (spark.read.option("mergeSchema", "true").option("pathGlobFilter", "*.parquet")
            .parquet(folder))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCS).parquet(path)


def read_parallel_corpus(spark: SparkSession, path: str,
                         include_models: list[str] | None = None,
                         limit_per_class: int | None = None) -> DataFrame:
    """Documents with category and author: human second chunks and model rows.

    `limit_per_class` keeps that many documents of each category, chosen by hash of the id.
    """
    return _limited(lb.with_author(read_documents(spark, path), include_models), limit_per_class)


def _limited(docs: DataFrame, n: int | None) -> DataFrame:
    return docs if n is None else sampling.sample_per_class(docs, "model_category", n)


def read_category_files(spark: SparkSession, files: dict[str, str],
                        include_models: list[str] | None = None,
                        limit_per_class: int | None = None) -> DataFrame:
    """One file (or folder) per category. With no category left, an empty table.

    `limit_per_class` keeps that many documents of each category, chosen by hash of the id.
    """
    chosen = {c: p for c, p in files.items()
              if c == "human" or include_models is None or c in include_models}
    empty = spark.createDataFrame([], DOCS + ", model_category string, author_id string")
    out = empty
    for category, path in chosen.items():
        author = "human" if category == "human" else "llm"
        part = read_documents(spark, path).withColumns(
            {"model_category": F.lit(category), "author_id": F.lit(author)})
        out = part if out is empty else out.unionByName(part)
    return _limited(out, limit_per_class)


def read_csv_texts(spark: SparkSession, path: str, text_column: str = "text",
                   line_breaks: bool = True) -> DataFrame:
    """The text column of CSV files with headers; quoted line breaks are kept.

    Each file is then read by one task. Where no text has line breaks, `line_breaks=False`
    lets large files be split.
    """
    df = spark.read.csv(path, header=True, multiLine=line_breaks, escape='"')
    if text_column not in df.columns:
        raise ValueError(f"column {text_column!r} not found; the file has {df.columns}")
    return df.select(F.col(text_column).cast("string").alias("text"))


def read_text_lines(spark: SparkSession, path: str, n_docs: int | None = None) -> DataFrame:
    """Stripped, non-blank lines as documents; repeated up to `n_docs` where given.

    Each line is repeated in place: no sort, no limit, nothing shuffled.
    """
    lines = (spark.read.text(path).select(F.trim("value").alias("text"))
             .where("text <> ''"))
    if n_docs is None:
        return lines
    have = lines.count()
    if not have:
        return lines
    # every line gets the whole share; the first of each part of the input get one more
    share, rest = divmod(n_docs, have)
    part = F.spark_partition_id()
    sizes = lines.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a split
    more, left = {}, rest
    for row in sizes:
        more[row["part"]] = min(left, row["count"])
        left -= more[row["part"]]
    extra = F.create_map(*[F.lit(x) for kv in more.items() for x in kv])
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    copies = F.lit(share) + (place < extra[part]).cast("int")
    return (lines.select("text", copies.alias("copies"))
            .select("text", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies")))).alias("copy"))
            .drop("copy"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Documents from JSON lines with `doc_id, text` and an optional `author_id`."""
    return spark.read.schema(DOCS + ", author_id string").json(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS).parquet(path)


def stream_tokens(spark: SparkSession, path: str, time_column: str = "ingested",
                  files_per_trigger: int = 100, more: str = "") -> DataFrame:
    """Token rows as a stream of parquet files with an ingest time; `more` names further columns."""
    return (spark.readStream.schema(f"{TOKENS}, {time_column} timestamp" + (f", {more}" if more else ""))
            .option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def read_vocabs(spark: SparkSession, folder: str) -> DataFrame:
    """Vocabulary table `feature, item, ord`; the feature is the file name without suffix.

    Lines are stripped and blanks dropped; a repeated item keeps its first place. Files are
    word lists: each is one row when read.
    """
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    feature = F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1)
    lines = files.select(feature.alias("feature"),
                         F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    return (lines.select("feature", F.trim("line").alias("item"), "ord").where("item <> ''")
            .groupBy("feature", "item").agg(F.min("ord").alias("ord")))


def vocab_lists(vocab: DataFrame) -> dict[str, list[str]]:
    """Vocabulary table to ordered lists, as the feature operators take them."""
    lists: dict[str, list[str]] = {}
    for row in vocab.orderBy("feature", "ord").toLocalIterator():
        lists.setdefault(row["feature"], []).append(row["item"])
    return lists


def default_category_files(folder: str) -> dict[str, str]:
    return {c: f"{folder}/model_category={c}" for c in fv.CORPUS_CATEGORIES}
