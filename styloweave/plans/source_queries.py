"""Sources and sinks as round trips over the given tables: write to the shared folder, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from styloweave.functions import fixed_values as fv
from styloweave.functions import labels as lb
from styloweave.operators import style
from styloweave.operators import tokens as tk
from styloweave.plans.corpus_queries import CAT, META, corpus, meta
from styloweave.plans.oracle_sql import in_list, tokens_cte
from styloweave.plans.registry import query, table
from styloweave.plans.style_queries import only
from styloweave.session import fresh_folder
from styloweave.sources import materialise as mt
from styloweave.sources import readers as rd
from styloweave.sources import writers as wr


def _categories(spark, folder):
    docs = corpus(spark, folder).select("doc_id", "text")
    return docs.withColumn("model_category", lb.category_of(lb.model_of(F.col("doc_id"))))


@query("a1_parquet_folder", "SELECT doc_id, text, lang FROM documents")
def parquet_folder(spark, folder):
    """Two files, of which one lacks a column."""
    work, docs = fresh_folder(spark), table(spark, folder, "documents").select("doc_id", "text", "lang")
    docs.where("lang IS NOT NULL").write.parquet(f"{work}/x")
    docs.where("lang IS NULL").drop("lang").write.mode("append").parquet(f"{work}/x")
    return rd.read_parquet_folder(spark, f"{work}/x")


_FILES = f"""WITH {CAT}, f AS (SELECT doc_id, text, model_category,
  CASE WHEN model_category = 'human' THEN 'human' ELSE 'llm' END AS author_id,
  row_number() OVER (PARTITION BY model_category ORDER BY md5('42|' || doc_id), doc_id) AS k
FROM cat WHERE model_category IN {in_list(fv.CORPUS_CATEGORIES)})"""


@query("a2_category_files", f"{_FILES} SELECT doc_id, text, model_category, author_id FROM f WHERE k <= 30")
def category_files(spark, folder):
    """One folder per category, at most 30 documents of each."""
    work = fresh_folder(spark)
    wr.write_corpus(_categories(spark, folder).where(F.col("model_category").isin(fv.CORPUS_CATEGORIES)), work)
    return rd.read_category_files(spark, rd.default_category_files(work), limit_per_class=30) \
        .select("doc_id", "text", "model_category", "author_id")


@query("a3_parallel_corpus", f"""WITH {CAT} SELECT doc_id, model_category,
  CASE WHEN model_category = 'human' THEN 'human' ELSE 'llm' END AS author_id
FROM cat WHERE model_category NOT IN {in_list(fv.DROPPED_CATEGORIES)}""")
def parallel_corpus(spark, folder):
    work = fresh_folder(spark)
    corpus(spark, folder).select("doc_id", "text").write.parquet(f"{work}/x")
    return rd.read_parallel_corpus(spark, f"{work}/x").select("doc_id", "model_category", "author_id")


@query("a4_csv_texts", "SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY ALL")
def csv_texts(spark, folder):
    """Texts with line breaks and quotation marks."""
    work = fresh_folder(spark)
    table(spark, folder, "documents").select("text").write.option("header", True).option("escape", '"').csv(f"{work}/x")
    return rd.read_csv_texts(spark, f"{work}/x").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


_LINES = r"""WITH l AS (SELECT trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents),
s AS (SELECT line, count(*) AS n FROM l WHERE line <> '' GROUP BY line), t AS (SELECT sum(n) AS total FROM s)"""


@query("a5_text_lines", f"{_LINES} SELECT md5(line) AS digest, CAST(n AS BIGINT) AS n FROM s")
def text_lines(spark, folder):
    work = fresh_folder(spark)
    table(spark, folder, "documents").select("text").write.text(f"{work}/x")
    return rd.read_text_lines(spark, f"{work}/x").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query("a5_replicated", f"{_LINES} SELECT md5(line) AS digest, true AS in_share FROM s")
def replicated_lines(spark, folder):
    """Three documents a line and seven more: every line as often as its share, or once more."""
    work = fresh_folder(spark)
    table(spark, folder, "documents").select("text").write.text(f"{work}/x")
    all_lines = rd.read_text_lines(spark, f"{work}/x")
    have = all_lines.count()
    n_docs = 3 * have + 7
    many = rd.read_text_lines(spark, f"{work}/x", n_docs).groupBy("text").agg(F.count("*").alias("copies"))
    share = F.lit(n_docs // max(have, 1))
    lines = all_lines.groupBy("text").agg(F.count("*").alias("n"))
    return lines.withColumn("share", share).join(many, "text").select(
        F.md5("text").alias("digest"),
        F.col("copies").between(F.col("n") * F.col("share"), F.col("n") * (F.col("share") + 1)).alias("in_share"))


@query("a6_json_lines", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang AS author_id FROM documents")
def json_lines(spark, folder):
    work = fresh_folder(spark)
    table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").alias("author_id")).write.json(f"{work}/x")
    return rd.read_json_lines(spark, f"{work}/x")


@query("a9_write_by_category", f"""WITH {CAT} SELECT doc_id, text, model_category FROM cat
WHERE model_category IN {in_list(fv.CORPUS_CATEGORIES)}""")
def written_by_category(spark, folder):
    work = fresh_folder(spark)
    wr.write_corpus(_categories(spark, folder).where(F.col("model_category").isin(fv.CORPUS_CATEGORIES)), work)
    return spark.read.parquet(work).select("doc_id", "text", "model_category")


@query("a10_csv_sink", "SELECT lang, source, CAST(count(*) AS VARCHAR) AS n FROM documents GROUP BY ALL")
def csv_sink(spark, folder):
    work = fresh_folder(spark)
    wr.write_csv(table(spark, folder, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")), f"{work}/x")
    return spark.read.option("header", True).csv(f"{work}/x")


@query("a11_enriched", f"""WITH {META} SELECT doc_id, text, model_full, model_category, text_type, word_count FROM meta""")
def enriched(spark, folder):
    work = fresh_folder(spark)
    wr.write_enriched(meta(spark, folder), f"{work}/x")
    return spark.read.parquet(f"{work}/x")


_STORED = {"func_words": 1, "letters": 0}


def _store(spark, folder, work):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    runs = []

    def build():
        runs.append(1)
        return style.sparse_long(style.vectorize(tk.tokenize(docs), config=only("tokens")))
    for _ in range(2):
        stored = mt.get_or_compute(spark, work, "all", _STORED, build, depends_on=[mt.input_fingerprint(docs)])
    return stored, len(runs)


@query("a12_stored_vectors", f"""WITH {tokens_cte()} SELECT doc_id, count(*) AS n, 1 AS built FROM tok GROUP BY doc_id""")
def stored_vectors(spark, folder):
    """Asked for twice, built once: the second call reads what the first has stored."""
    stored, built = _store(spark, folder, fresh_folder(spark))
    return stored.select("doc_id", "n", F.lit(built).alias("built"))


@query("a12_stored_by_part", f"""WITH {tokens_cte()} SELECT doc_id, count(*) AS n, 1 AS new, 2 AS kept
FROM tok GROUP BY doc_id""")
def stored_by_part(spark, folder):
    """Two folders of files are stored; a third comes, and only that one is computed."""
    work, docs = fresh_folder(spark), table(spark, folder, "documents").select("doc_id", "text")

    def put(k):
        docs.where(F.pmod("doc_id", F.lit(3)) == k).write.parquet(f"{work}/docs/{k}")

    def counted():
        return mt.get_or_compute_parts(
            spark, f"{work}/vectors", f"{work}/docs/*", {"count": "tokens"},
            lambda new: tk.tokenize(new, keep=["part_key"]).groupBy("part_key", "doc_id").agg(F.count("*").alias("n")))

    put(0)
    put(1)
    counted()
    put(2)
    parts = counted()
    return parts.rows.select("doc_id", "n", F.lit(parts.new_folders).alias("new"),
                             F.lit(parts.kept_folders).alias("kept"))


def _by_lang(spark, folder, work):
    """Vectors of each language, stored under keys of their own."""
    docs = table(spark, folder, "documents")
    langs = [r[0] for r in docs.select("lang").distinct().orderBy("lang").limit(100).collect()]
    for lang in langs:
        part = docs.where(F.col("lang").eqNullSafe(F.lit(lang)))
        mt.get_or_compute(spark, work, "all", {"lang": lang}, lambda part=part: tk.tokenize(
            part.select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("n")).coalesce(1))
    return langs


@query("a14_inventory", f"""WITH {tokens_cte("SELECT doc_id, text FROM documents")}
SELECT substr(md5('{{"lang": ' || coalesce('"' || lang || '"', 'null') || '}}'), 1, 12) AS key, 1 AS files,
  CAST(count(DISTINCT doc_id) AS BIGINT) AS n_rows, true AS sized FROM documents
WHERE doc_id IN (SELECT doc_id FROM tok) GROUP BY lang""")
def inventory(spark, folder):
    """Files, rows and bytes of every key that is stored."""
    work = fresh_folder(spark)
    langs = _by_lang(spark, folder, work)
    held = mt.inventory(spark, work)
    rows = None
    for lang in langs:
        key = mt.config_hash({"lang": lang})
        own = spark.read.parquet(mt.vectors_path(work, "all", key)).agg(F.count("*").alias("n_rows")) \
            .select(F.lit(key).alias("key"), "n_rows")
        rows = own if rows is None else rows.unionByName(own)
    return held.join(rows, "key").where("n_rows > 0").select("key", F.col("files").cast("int").alias("files"), "n_rows",
                                                             (F.col("bytes") > 0).alias("sized"))
