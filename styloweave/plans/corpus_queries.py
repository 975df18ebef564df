"""Queries of labels, rebuild, statistics, splits, models, selection and comparison.

Document ids such as `acad_12@gpt-4o-2024-08-06` are derived from the given tables.
"""

from __future__ import annotations


from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from styloweave.functions import fixed_values as fv
from styloweave.functions import labels as lb
from styloweave.functions import text as tx
from styloweave.operators import compare as cp
from styloweave.operators import corpus_stats as cs
from styloweave.operators import modeling as md
from styloweave.operators import rebuild as rb
from styloweave.operators import sampling as sp
from styloweave.operators import selection as sel
from styloweave.operators import style
from styloweave.operators import tokens as tk
from styloweave.plans import flows
from styloweave.plans.oracle_sql import in_list, q, tokens_cte, values_table
from styloweave.plans.registry import query, table
from styloweave.plans.style_queries import TOK, VOCABS, fixture_vectors, lexical_tokens, only
from styloweave.session import fresh_folder, shared_folder
from styloweave.sources import materialise as mt
from styloweave.streaming import rebuild_stream as rs

TYPES = ["acad", "blog", "fic", "news", "spok", "tvm"]
MODELS = ["chunk_1", "chunk_2", "gpt-4o-mini-2024-07-18", "gpt-4o-2024-08-06",
          "Meta-Llama-3-70B-Instruct", "Meta-Llama-3-8B-Instruct", "Meta-Llama-3-70B",
          "Meta-Llama-3-8B", "other-model"]


def _pick(values, of):
    return F.get(F.array(*[F.lit(v) for v in values]), (of % len(values)).cast("int"))


def _pick_sql(values, of):
    return f"list_extract([{', '.join(q(v) for v in values)}], CAST({of} % {len(values)} AS INTEGER) + 1)"


def corpus(spark, folder):
    """`documents` under corpus ids; every 50th id names no model."""
    n = F.col("doc_id")
    name = F.concat(_pick(TYPES, F.floor(n / 9)), F.lit("_"), n.cast("string"))
    doc_id = F.when(n % 50 == 49, name).otherwise(F.concat(name, F.lit("@"), _pick(MODELS, n)))
    return table(spark, folder, "documents").select(
        doc_id.alias("doc_id"), "text", "lang", "source", n.alias("arrival"))


_NAME = f"{_pick_sql(TYPES, '(doc_id // 9)')} || '_' || doc_id"
CORPUS = f"""corpus AS (SELECT CASE WHEN doc_id % 50 = 49 THEN {_NAME}
   ELSE {_NAME} || '@' || {_pick_sql(MODELS, 'doc_id')} END AS doc_id, text, lang, source,
   doc_id AS arrival FROM documents)"""
MODEL_SQL = """CASE WHEN contains(doc_id, 'chunk_2') THEN 'human_chunk_2'
   WHEN contains(doc_id, 'chunk') THEN 'human_chunk_1'
   WHEN contains(doc_id, '@') THEN split_part(doc_id, '@', 2) ELSE 'unknown' END"""


def _category_sql(model: str, human: str) -> str:
    rules = " ".join(f"WHEN contains({model}, '{part}') THEN '{c}'"
                     for part, c in fv.MODEL_CATEGORY_RULES)
    return f"CASE {human} {rules} ELSE 'other' END"


CATEGORY_SQL = _category_sql("model", """WHEN model = 'human_chunk_2' THEN 'human'
   WHEN model = 'human_chunk_1' THEN 'human_chunk_1'""")
CAT = f"""{CORPUS}, modelled AS (SELECT *, {MODEL_SQL} AS model FROM corpus),
cat AS (SELECT *, {CATEGORY_SQL} AS model_category FROM modelled)"""
META = f"""{CORPUS}, em AS (SELECT *, CASE WHEN contains(doc_id, 'chunk') THEN 'human' ELSE {MODEL_SQL} END
   AS model_full FROM corpus),
meta AS (SELECT *, {_category_sql("model_full", "WHEN model_full = 'human' THEN 'human'")} AS model_category,
   split_part(doc_id, '_', 1) AS text_type, CAST(length(text) AS BIGINT) AS text_length,
   CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS BIGINT) AS word_count FROM em)"""


# ------------------------------------------------------------------------- labels
for _name, _sql, _column in [
        ("b1_binary_author", """CASE WHEN contains(doc_id, 'chunk') THEN 'human'
            WHEN contains(doc_id, 'gpt') THEN 'gpt' ELSE 'unknown' END""", lb.binary_author),
        ("b2_model", MODEL_SQL, lb.model_of),
        ("b5_text_type", "split_part(doc_id, '_', 1)", lb.text_type_of)]:
    @query(_name, f"WITH {CORPUS} SELECT doc_id, {_sql} AS label FROM corpus")
    def _label(spark, folder, column=_column):
        return corpus(spark, folder).select("doc_id", column(F.col("doc_id")).alias("label"))


@query("b3_category", f"WITH {CAT} SELECT doc_id, model_category FROM cat")
def category(spark, folder):
    return corpus(spark, folder).select(
        "doc_id", lb.category_of(lb.model_of(F.col("doc_id"))).alias("model_category"))


@query("b4_explored", f"WITH {META} SELECT doc_id, model_full, model_category FROM meta")
def explored(spark, folder):
    return cs.with_metadata(corpus(spark, folder)).select("doc_id", "model_full", "model_category")


@query("b6_with_category", f"""WITH {CAT} SELECT doc_id,
  CASE WHEN arrival % 7 = 0 THEN 'human' ELSE 'llm' END AS author_id,
  CASE WHEN arrival % 7 = 0 THEN 'human' ELSE model_category END AS model_category FROM cat""")
def with_category(spark, folder):
    labelled = corpus(spark, folder).select("doc_id", F.when(F.col("arrival") % 7 == 0, "human")
                                            .otherwise("llm").alias("author_id"))
    return lb.with_category(labelled)


@query("b7_parse_feature", f"""WITH c AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN source || '::'
   WHEN doc_id % 3 = 1 THEN source || ':' || lang || ':x' ELSE source END AS feature FROM documents)
SELECT feature, CASE WHEN contains(feature, ':') THEN split_part(feature, ':', 1) END AS type,
  CASE WHEN contains(feature, ':') THEN substr(feature, strpos(feature, ':') + 1) END AS item FROM c""")
def parse_feature(spark, folder):
    n = F.col("doc_id") % 3
    names = table(spark, folder, "documents").select(
        F.when(n == 0, F.concat("source", F.lit("::")))
        .when(n == 1, F.concat("source", F.lit(":"), "lang", F.lit(":x")))
        .otherwise(F.col("source")).alias("feature")).distinct()
    return names.select("feature", lb.feature_type(F.col("feature")).alias("type"),
                        lb.feature_value(F.col("feature")).alias("item"))


_UWS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def repair_sql(text: str) -> str:
    out = text
    for pattern, by in [(_UWS + r"+([,.;:!?%])", r"\1"), (r"\(" + _UWS + "+", "("),
                        (_UWS + r"+\)", ")"), (_UWS + "{2,}", " "),
                        (f"^{_UWS}+|{_UWS}+$", "")]:
        out = f"regexp_replace({out}, {q(pattern)}, {q(by)}, 'g')"
    return out


@query("b8_spacing", f"""SELECT doc_id, {repair_sql("replace(replace(text, ',', ' , '), ' ', '  ')")} AS text
FROM documents""")
def spacing(spark, folder):
    spaced = F.replace(F.replace("text", F.lit(","), F.lit(" , ")), F.lit(" "), F.lit("  "))
    return table(spark, folder, "documents").select("doc_id", tx.repair_spacing(spaced).alias("text"))


@query("b9_lengths", f"WITH {META} SELECT doc_id, text_length, word_count FROM meta")
def lengths(spark, folder):
    return cs.with_metadata(corpus(spark, folder)).select("doc_id", "text_length", "word_count")


CHOSEN = ["gpt-4o", "llama-3-8b-base"]


@query("b10_class_filter", f"""WITH {CAT} SELECT doc_id, model_category,
  CASE WHEN model_category = 'human' THEN 'human' ELSE 'llm' END AS author_id
FROM cat WHERE model_category IN ('human', {', '.join(q(c) for c in CHOSEN)})""")
def class_filter(spark, folder):
    return lb.with_author(corpus(spark, folder).select("doc_id"), CHOSEN)


@query("b11_select_columns", """SELECT doc_id, n_chars FROM documents""")
def select_columns(spark, folder):
    docs = table(spark, folder, "documents")
    return sel.select_columns(docs, ["n_chars", "not_there"], ["doc_id", "author_id"])[0]


@query("b12_numeric_columns", "SELECT doc_id, n_chars FROM documents")
def numeric_columns(spark, folder):
    return sel.numeric_columns(table(spark, folder, "documents"))


@query("b13_rename", "SELECT doc_id AS document_id, lang AS author_id FROM documents")
def rename(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang").withColumnsRenamed(
        {"doc_id": "document_id", "lang": "author_id"})


# ------------------------------------------------------------------------- materialisation
@query("a13_config_hash", """SELECT lang, substring(md5('{"features": 18, "lang": "' || lang || '"}'), 1, 12)
  AS key FROM (SELECT DISTINCT lang FROM documents)""")
def config_hash(spark, folder):
    """The key of stored vectors, for one configuration per language."""
    def keys(frames):
        for f in frames:
            yield f.assign(key=[mt.config_hash({"lang": x, "features": 18}) for x in f["lang"]])
    return table(spark, folder, "documents").select("lang").distinct().mapInPandas(keys, "lang string, key string")


# ------------------------------------------------------------------------- rebuild
CORPUS_TOK = tokens_cte("SELECT doc_id, text FROM corpus")
_REBUILD = f"""ss AS (SELECT doc_id, sentence_id, {repair_sql("string_agg(token, ' ' ORDER BY token_id)")} AS s
   FROM tok GROUP BY doc_id, sentence_id),
built AS (SELECT doc_id, {repair_sql("string_agg(s, ' ' ORDER BY sentence_id)")} AS text FROM ss GROUP BY doc_id)"""


@query("c1_rebuild", f"WITH {TOK}, {_REBUILD} SELECT doc_id, text FROM built")
def rebuild(spark, folder):
    return rb.rebuild_documents(lexical_tokens(spark, folder))


def corpus_tokens(spark, folder):
    return tk.tokenize(corpus(spark, folder), keep=["arrival"])


@query("c1_rebuild_corpus", f"""WITH {CAT}, {CORPUS_TOK}, {_REBUILD},
r AS (SELECT doc_id, model_category, row_number() OVER (PARTITION BY model_category ORDER BY arrival, doc_id) AS k
      FROM cat WHERE model_category IN {in_list(fv.CORPUS_CATEGORIES)} AND doc_id IN (SELECT doc_id FROM tok))
SELECT r.doc_id, text, model_category FROM r JOIN built ON r.doc_id = built.doc_id WHERE k <= 20""")
def rebuild_corpus(spark, folder):
    return rb.rebuild_corpus(corpus_tokens(spark, folder), 20, "arrival")


@query("c3_limit", f"""WITH {CAT}, r AS (SELECT doc_id, model_category, row_number() OVER
   (PARTITION BY model_category ORDER BY arrival, doc_id) AS k FROM cat)
SELECT doc_id, model_category FROM r WHERE k <= 37""")
def limit_per_class(spark, folder):
    docs = corpus(spark, folder).select(
        "doc_id", "arrival", lb.category_of(lb.model_of(F.col("doc_id"))).alias("model_category"))
    return sp.first_per_class(docs, "model_category", 37, "arrival").select("doc_id", "model_category")


@query("c4_doc_counts", f"""WITH {CAT}, {CORPUS_TOK}
SELECT model_category, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs,
  CAST(least(count(DISTINCT doc_id), 50) AS BIGINT) AS n_written
FROM cat WHERE model_category IN {in_list(fv.CORPUS_CATEGORIES)} AND doc_id IN (SELECT doc_id FROM tok)
GROUP BY model_category""")
def doc_counts(spark, folder):
    return rb.category_counts(corpus_tokens(spark, folder), 50).withColumn(
        "n_written", F.col("n_written").cast("long"))


@query("c5_labels", f"""WITH {CAT} SELECT doc_id, model_category,
  CASE WHEN model_category = 'human' THEN 'human' ELSE 'llm' END AS author_id
FROM cat WHERE model_category NOT IN {in_list(fv.DROPPED_CATEGORIES)}""")
def binary_labels(spark, folder):
    return lb.with_author(corpus(spark, folder).select("doc_id"))


@query("c2_stream_sessions", f"""WITH {tokens_cte("SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations")},
{_REBUILD} SELECT doc_id, text FROM built""")
def stream_sessions(spark, folder):
    """Token rows of `conversations` as a stream; documents end at a pause."""
    work = fresh_folder(spark)
    turns = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    tok = tk.tokenize(turns)
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    timed = tok.withColumn("ingested", F.timestamp_add("SECOND", F.col("doc_id").cast("int"), start))
    # a last marker moves the watermark past every document
    marker = timed.agg(F.max("ingested").alias("t")).select(
        F.lit(-1).cast("long").alias("doc_id"), F.lit(0).alias("token_id"),
        F.lit(0).alias("sentence_id"), F.lit(0).alias("sent_pos"), F.lit("end").alias("token"),
        (F.col("t") + F.expr("INTERVAL 1 DAY")).alias("ingested"))
    timed.write.parquet(f"{work}/tokens/part=1")
    marker.write.parquet(f"{work}/tokens/part=2")
    schema = spark.read.parquet(f"{work}/tokens/part=1").schema
    source = spark.readStream.schema(schema).parquet(f"{work}/tokens/part=*")
    docs = rs.rebuild_stream(source, "ingested", "10 minutes", "10 minutes")
    rs.write_documents(docs, f"{work}/documents", f"{work}/state").awaitTermination()
    return spark.read.parquet(f"{work}/documents").where("doc_id >= 0").select("doc_id", "text")


# ------------------------------------------------------------------------- statistics
def meta(spark, folder):
    return cs.with_metadata(corpus(spark, folder))


@query("k1_value_counts", f"WITH {META} SELECT model_category, count(*) AS n FROM meta GROUP BY ALL")
def value_counts(spark, folder):
    return cs.value_counts(meta(spark, folder), "model_category")


@query("k2_cross_table", f"WITH {META} SELECT model_category, " + ", ".join(
    f"count(*) FILTER (text_type = '{t}') AS {t}" for t in TYPES) +
    f", count(*) FILTER (coalesce(text_type NOT IN {in_list(TYPES)}, true)) AS other FROM meta GROUP BY model_category")
def cross_table(spark, folder):
    return cs.cross_table(meta(spark, folder), "model_category", "text_type", TYPES)


@query("k3_models", f"WITH {META} SELECT model_full, count(*) AS n FROM meta GROUP BY ALL")
def models(spark, folder):
    return cs.distinct_values(meta(spark, folder), "model_full")


@query("k4_describe", f"""WITH {META} SELECT model_category, count(word_count) AS count,
  round(avg(word_count), 6) AS mean, round(stddev_samp(word_count), 6) AS std, min(word_count) AS min,
  quantile_cont(word_count, 0.25) AS p25, quantile_cont(word_count, 0.5) AS p50,
  quantile_cont(word_count, 0.75) AS p75, max(word_count) AS max FROM meta GROUP BY model_category""")
def describe(spark, folder):
    df = cs.describe_by(meta(spark, folder), "model_category", "word_count")
    return df.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("k5_summary", f"""WITH {META} SELECT model_category, text_type, count(*) AS count,
  round(avg(word_count), 6) AS mean, round(stddev_samp(word_count), 6) AS std,
  min(word_count) AS min, max(word_count) AS max FROM meta GROUP BY model_category, text_type""")
def summary(spark, folder):
    df = cs.summary(meta(spark, folder), ["model_category", "text_type"])
    return df.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("k6_chunks", f"""WITH {CORPUS} SELECT count(*) FILTER (contains(doc_id, 'chunk')) AS human,
  count(*) FILTER (contains(doc_id, 'chunk_1')) AS chunk_1,
  count(*) FILTER (contains(doc_id, 'chunk_2')) AS chunk_2 FROM corpus""")
def chunks(spark, folder):
    return cs.chunk_counts(corpus(spark, folder))


@query("k7_pairwise_sizes", f"""WITH {META}
SELECT model_category AS llm, CAST((SELECT count(*) FROM meta WHERE contains(doc_id, 'chunk_2')) AS BIGINT)
  AS n_human, count(*) AS n_llm FROM meta WHERE model_category <> 'human' GROUP BY model_category""")
def pairwise_sizes(spark, folder):
    return cs.pairwise_sizes(corpus(spark, folder))


FEW = only("func_words")
_FW = f"""{TOK}, ids AS (SELECT DISTINCT doc_id FROM tok),
vocab(item) AS (VALUES {values_table([(w,) for w in VOCABS["func_words"]])}),
nt AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
fw AS (SELECT t.doc_id, t.token AS item, CAST(count(*) AS DOUBLE) / max(nt.n) AS value
   FROM tok t JOIN nt ON t.doc_id = nt.doc_id WHERE t.token IN (SELECT item FROM vocab)
   GROUP BY t.doc_id, t.token)"""


def func_word_profiles(spark, folder):
    return style.vectorize(lexical_tokens(spark, folder), config=FEW)


@query("k9_variance", f"""WITH {_FW}, seen AS (SELECT DISTINCT item FROM fw),
full_ AS (SELECT i.doc_id, s.item, coalesce(fw.value, 0) AS value FROM ids i CROSS JOIN seen s
   LEFT JOIN fw ON fw.doc_id = i.doc_id AND fw.item = s.item)
SELECT 'func_words' AS feature, item, round(var_samp(value), 9) AS variance FROM full_ GROUP BY item""")
def variance(spark, folder):
    profiles = func_word_profiles(spark, folder)
    n = table(spark, folder, "documents").count()
    df = cs.feature_variance(style.sparse_long(profiles), n)
    return df.withColumn("variance", F.round("variance", 9))


_ALL_FUNC = list(dict.fromkeys(VOCABS["func_words"]))


@query("k10_correlation", f"""WITH {_FW}, v(item) AS (VALUES {values_table([(w,) for w in _ALL_FUNC])}),
c AS (SELECT count(*) AS n FROM ids), s AS (SELECT item, sum(value) AS s, sum(value * value) AS q FROM fw GROUP BY item),
p AS (SELECT x.item AS a, y.item AS b, sum(x.value * y.value) AS xy FROM fw x JOIN fw y ON x.doc_id = y.doc_id GROUP BY ALL)
SELECT va.item AS a, vb.item AS b, round((c.n * coalesce(xy, 0) - sa.s * sb.s)
  / nullif(sqrt(greatest(c.n * sa.q - sa.s * sa.s, 0)) * sqrt(greatest(c.n * sb.q - sb.s * sb.s, 0)), 0), 5) AS r
FROM v va JOIN v vb ON true JOIN c ON true LEFT JOIN s sa ON sa.item = va.item LEFT JOIN s sb ON sb.item = vb.item
LEFT JOIN p ON p.a = va.item AND p.b = vb.item""")
def correlation(spark, folder):
    """All pairs of function words over all documents with tokens."""
    columns = style.vector_columns(FEW)
    vectors = md.model_vectors(func_word_profiles(spark, folder), len(columns))
    # a document given twice counts twice
    full = table(spark, folder, "documents").select("doc_id").join(vectors, "doc_id")
    df = cs.feature_correlation(full, [f"{f}:{i}" for f, i in columns])
    wanted = [F.regexp_extract(c, "^func_words:(.*)$", 1).alias(c) for c in ("a", "b")]
    return df.where("a LIKE 'func_words:%' AND b LIKE 'func_words:%'").select(*wanted, F.round("r", 5).alias("r"))


# ------------------------------------------------------------------------- splits
def _ranked_sql(label: str, rel: str) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {label}
   ORDER BY md5('42|' || doc_id), doc_id) AS place FROM {rel})"""


def _quota_sql(name: str, source: str, size: str, fraction: float, out: str) -> str:
    return f"""{name} AS (SELECT * EXCLUDE (base, rest, held_total),
   CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= held_total - sum(base) OVER ()
   THEN 1 ELSE 0 END AS BIGINT) AS {out}
   FROM (SELECT *, ceil({fraction}::DOUBLE * sum({size}) OVER ()) AS held_total,
     ceil({fraction}::DOUBLE * sum({size}) OVER ())::BIGINT * {size} // sum({size}) OVER () AS base,
     ceil({fraction}::DOUBLE * sum({size}) OVER ())::BIGINT * {size} % sum({size}) OVER () AS rest
     FROM {source}))"""


_SIZES = "sizes AS (SELECT lang AS label, count(*) AS size FROM documents GROUP BY lang)"
_L1 = f"""{_SIZES}, {_quota_sql("h", "sizes", "size", 0.4, "held")},
{_quota_sql("t", "h", "held", 0.5, "test")}, {_ranked_sql("lang", "documents")},
split AS (SELECT r.doc_id, r.lang, CASE WHEN place <= size - held THEN 'train'
   WHEN place <= size - test THEN 'dev' ELSE 'test' END AS split FROM ranked r JOIN t ON r.lang = t.label)"""


@query("l1_three_way", f"WITH {_L1} SELECT doc_id, lang, split FROM split")
def three_way(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sp.three_way_split(docs, "lang")


@query("l1_split_sizes", f"WITH {_L1} SELECT split, lang, count(*) AS n FROM split GROUP BY split, lang")
def split_sizes(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sp.three_way_split(docs, "lang").groupBy("split", "lang").agg(F.count("*").alias("n"))


@query("l2_split", f"""WITH {_SIZES}, {_quota_sql("h", "sizes", "size", 0.2, "held")},
{_ranked_sql("lang", "documents")}
SELECT doc_id, lang, CASE WHEN place <= size - held THEN 'train' ELSE 'test' END AS split
FROM ranked r JOIN h ON r.lang = h.label""")
def two_way(spark, folder):
    return sp.stratified_split(table(spark, folder, "documents").select("doc_id", "lang"), "lang")


@query("l3_sample_per_class", f"""WITH {_ranked_sql("source", "documents")}
SELECT doc_id, source FROM ranked WHERE place <= 30""")
def sample_per_class(spark, folder):
    return sp.sample_per_class(table(spark, folder, "documents").select("doc_id", "source"),
                               "source", 30)


@query("l4_sample", """SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100""")
def sample(spark, folder):
    return sp.sample_rows(table(spark, folder, "documents").select("doc_id"), 100)


# ------------------------------------------------------------------------- models
@query("m1_scaled", """WITH e AS (SELECT vec_id, unnest(embedding) AS value,
   generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
s AS (SELECT pos, stddev_pop(CAST(value AS DOUBLE)) AS sd FROM e GROUP BY pos)
SELECT vec_id, CAST(e.pos AS INTEGER) AS pos, round(CAST(value AS DOUBLE) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6)
  AS scaled FROM e JOIN s ON e.pos = s.pos""")
def scaled(spark, folder):
    """By the factors that models scale with."""
    vectors = md.array_vectors(table(spark, folder, "embeddings"), "embedding", ["vec_id"])
    return md.scale(vectors, md.scale_factors(vectors)).select(
        "vec_id", F.posexplode(vector_to_array("features")).alias("pos", "value")) \
        .select("vec_id", "pos", F.round("value", 6).alias("scaled"))


PREDICTED = "CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END"
_PAIRS = f"""p AS (SELECT CAST(l.quality AS VARCHAR) AS y, CAST({PREDICTED} AS VARCHAR) AS p
   FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def predictions(spark, folder):
    """Length as a predictor of the quality label: a confusion table without a fit."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    joined = docs.join(table(spark, folder, "labels"), "doc_id")
    return joined.select(F.col("quality").cast("string").alias("author_id"),
                         (F.col("n_chars") > 2000).cast("int").cast("string").alias("predicted"))


@query("m4_accuracy", f"WITH {_PAIRS} SELECT avg(CAST(y = p AS DOUBLE)) AS accuracy FROM p")
def accuracy(spark, folder):
    return predictions(spark, folder).agg(md.accuracy("author_id", "predicted").alias("accuracy"))


_PER = """c AS (SELECT class, count(*) FILTER (y = class AND p = class) AS tp,
   count(*) FILTER (y = class) AS support, count(*) FILTER (p = class) AS named
   FROM p, (SELECT y AS class FROM p UNION SELECT p FROM p) GROUP BY class),
r AS (SELECT class, coalesce(CAST(tp AS DOUBLE) / nullif(named, 0), 0) AS precision,
   coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0) AS recall,
   coalesce(CAST(2 * tp AS DOUBLE) / nullif(named + support, 0), 0) AS f1, support, tp FROM c)"""


@query("m5_report", f"""WITH {_PAIRS}, {_PER}, a AS (
SELECT class, precision, recall, f1, support FROM r
UNION ALL SELECT 'accuracy', CAST(sum(tp) AS DOUBLE) / sum(support), CAST(sum(tp) AS DOUBLE) / sum(support),
   CAST(sum(tp) AS DOUBLE) / sum(support), sum(support) FROM r
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
   sum(f1 * support) / sum(support), sum(support) FROM r)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
  CAST(support AS BIGINT) AS support FROM a""")
def report(spark, folder):
    df = md.classification_report(predictions(spark, folder))
    return df.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")],
                     "support")


#: All features but letters: 825 columns.
MODEL_CONFIG = style.default_config(letters=0)
MODEL_COLUMNS = style.vector_columns(MODEL_CONFIG)


def _vectors_of(spark, docs, name):
    """Vectors of `doc_id, text, author_id, model_category`, computed once and stored."""
    def build():
        keep = ["author_id", "model_category"]
        return md.model_vectors(fixture_vectors(docs, keep, MODEL_CONFIG), len(MODEL_COLUMNS), keep)
    # one folder: later queries read what the first has stored for the same input
    return mt.get_or_compute(spark, f"{shared_folder(spark)}/vectors", name, MODEL_CONFIG, build,
                             depends_on=[mt.input_fingerprint(docs), mt.vocab_fingerprint(VOCABS)])


def stored_vectors(spark, folder):
    return _vectors_of(spark, lb.with_author(corpus(spark, folder)), "documents")


def conversation_vectors(spark, folder):
    """A second corpus: the turns of `conversations`, by role."""
    role = F.col("role")
    docs = table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text",
        F.when(role == "user", "human").otherwise("llm").alias("author_id"),
        F.when(role == "user", "human").otherwise(_pick(fv.CORPUS_CATEGORIES[1:], F.col("conv_id")))
        .alias("model_category"))
    return _vectors_of(spark, docs, "conversations")


@query("m2_coefficients")
def coefficients(spark, folder):
    vectors = stored_vectors(spark, folder)
    return md.train_model(vectors).coefficients(spark, MODEL_COLUMNS)


@query("m2_optimum", "SELECT feature, true AS at_optimum FROM (VALUES "
       + values_table([(f"{f}:{i}",) for f, i in MODEL_COLUMNS]) + ") v(feature), "
       "(SELECT count(*) AS n FROM documents) WHERE n > 0")
def optimum(spark, folder):
    """Whether the slope of summed log loss and half the squared norm vanishes at each coefficient of the table."""
    vectors = stored_vectors(spark, folder)
    model = md.train_model(vectors)
    table_ = model.coefficients(spark, MODEL_COLUMNS).select("feature", "ord", F.col(model.classes[1]).alias("w"))
    y = (F.col("author_id") == model.classes[1]).cast("double")
    margins = vectors.select("doc_id", y.alias("y"), (model.margin() - model.intercept).alias("m")) \
        .groupBy("doc_id", "y").agg(F.sum("m").alias("m"))
    residual = margins.select("doc_id", (1 / (1 + F.exp(-F.col("m") - model.intercept)) - F.col("y")).alias("r"))
    v = F.unwrap_udt("features")
    at = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
    entries = vectors.select("doc_id", "features").join(residual, "doc_id").select("r", F.explode(F.arrays_zip(at.alias("ord"), v["values"].alias("v"))).alias("e"))
    slopes = entries.groupBy(F.col("e.ord").alias("ord")).agg(F.sum(F.col("e.v") * F.col("r")).alias("s"))
    factors = spark.createDataFrame(list(enumerate(model.factors)), "ord int, factor double")
    found = table_.join(factors, "ord").join(slopes, "ord", "left").select(
        "feature", (F.coalesce("s", F.lit(0.0)) * F.col("factor") + F.col("w")).alias("slope"))
    return found.select("feature", (F.abs("slope") < 1e-6).alias("at_optimum")) if not vectors.isEmpty() else found.limit(0)


_LABELLED = f"""{CAT}, labelled AS (SELECT *, CASE WHEN model_category = 'human' THEN 'human' ELSE 'llm' END AS author_id
FROM cat WHERE model_category NOT IN {in_list(fv.DROPPED_CATEGORIES)})"""


@query("m3_predictions", f"""WITH {_LABELLED} SELECT author_id, count(*) AS n, true AS by_sign FROM labelled GROUP BY author_id""")
def predictions_by_sign(spark, folder):
    """Every prediction is the side of the fitted plane on which the vector lies."""
    vectors = stored_vectors(spark, folder)
    model = md.train_model(vectors)
    sides = md.scale(vectors, model.factors).select("doc_id", F.aggregate(
        F.zip_with(vector_to_array("features"), F.array(*[F.lit(c) for c in model.weights]),
                   lambda a, b: a * b), F.lit(model.intercept), lambda t, v: t + v).alias("m"))
    side = F.when(F.col("m") > 0, model.classes[1]).otherwise(model.classes[0])
    return model.predict(vectors).join(sides, "doc_id").groupBy("author_id").agg(
        F.count("*").alias("n"), F.bool_and(side == F.col("predicted")).alias("by_sign"))


@query("m3_train_and_report")
def train_and_report(spark, folder):
    return flows.train_and_report(stored_vectors(spark, folder)).report


@query("m3_refit_on_top", f"""WITH {_LABELLED}, n AS (SELECT count(*) AS n FROM labelled)
SELECT CAST(n - ceil(0.2 * n) AS BIGINT) AS n_train, CAST(ceil(0.2 * n) AS BIGINT) AS n_test, 10 AS features FROM n""")
def refit_on_top(spark, folder):
    """Train, select the ten strongest features, train on them alone."""
    e = flows.refit_on_top(stored_vectors(spark, folder), 10)
    return e.predictions.agg(F.count("*").alias("n_test")).select(
        F.lit(e.n_train).cast("long").alias("n_train"), "n_test",
        F.lit(len(e.model.weights)).alias("features"))


def _checked(done):
    """Sizes, and whether slopes and counts hold when worked out anew from the coefficients."""
    return flows.certificate(done).select("llm", "n_train", "n_test", (F.col("slope") < 1e-6).alias("at_optimum"),
                                          "counts_agree")


_PAIR_SIZES = """h AS (SELECT count(*) AS n FROM labelled WHERE author_id = 'human'),
c AS (SELECT model_category AS llm, count(*) AS n FROM labelled WHERE author_id <> 'human' GROUP BY model_category)"""
_TURNS = f"""turns AS (SELECT CASE WHEN role = 'user' THEN 'human' ELSE 'llm' END AS author_id,
  {_pick_sql(fv.CORPUS_CATEGORIES[1:], "conv_id")} AS model_category FROM conversations)"""
_HOLD = "true AS at_optimum, true AS counts_agree"


@query("m7_pairwise", f"""WITH {_LABELLED}, {_PAIR_SIZES}
SELECT llm, CAST(h.n + c.n - ceil(0.2 * (h.n + c.n)) AS BIGINT) AS n_train, CAST(ceil(0.2 * (h.n + c.n)) AS BIGINT) AS n_test,
  {_HOLD} FROM c, h""")
def pairwise(spark, folder):
    """All pairs fitted together: parts, optimum and confusion counts."""
    return _checked(flows.fit_pairs(stored_vectors(spark, folder), keep=["doc_id"]))


@query("m7_accuracies")
def pairwise_accuracies(spark, folder):
    return flows.pairwise(stored_vectors(spark, folder))


@query("m8_across_corpora", f"""WITH {_LABELLED}, {_TURNS} SELECT 'all' AS llm, (SELECT count(*) FROM labelled) AS n_train,
  (SELECT count(*) FROM turns) AS n_test, {_HOLD}""")
def across_corpora(spark, folder):
    """Train on documents, test on conversations, as a whole."""
    return _checked(flows.fit_across(stored_vectors(spark, folder), conversation_vectors(spark, folder), keep=["doc_id"]))


@query("m10_per_model", f"""WITH {_LABELLED}, {_TURNS}, {_PAIR_SIZES} SELECT llm, h.n + c.n AS n_train,
  (SELECT count(*) FROM turns WHERE author_id = 'human' OR turns.model_category = c.llm) AS n_test, {_HOLD} FROM c, h""")
def per_model(spark, folder):
    """Train on documents, test on conversations, for all categories together."""
    return _checked(flows.fit_across(stored_vectors(spark, folder), conversation_vectors(spark, folder),
                                     fv.CORPUS_CATEGORIES[1:], keep=["doc_id"]))


@query("m10_accuracies")
def per_model_accuracies(spark, folder):
    return flows.across_corpora(stored_vectors(spark, folder), conversation_vectors(spark, folder),
                                fv.CORPUS_CATEGORIES[1:])


@query("m9_within_corpus", f"""WITH {_LABELLED}, n AS (SELECT count(*) AS n FROM labelled)
SELECT 'all' AS llm, CAST(n - ceil(0.2 * n) AS BIGINT) AS n_train, CAST(ceil(0.2 * n) AS BIGINT) AS n_test, {_HOLD} FROM n""")
def within_corpus(spark, folder):
    split = sp.stratified_split(stored_vectors(spark, folder), "author_id", 0.2)
    parts = F.array(F.when(F.col("split") == "train", 1).otherwise(2))
    return _checked(flows.fit_together(split, ["all"], parts, len(MODEL_COLUMNS), keep=["doc_id"]))


@query("m9_report")
def within_report(spark, folder):
    return flows.within_corpus(stored_vectors(spark, folder)).report


@query("m11_results", """SELECT lang AS llm, avg(CAST(n_chars > 2000 AS DOUBLE)) AS train_accuracy,
  avg(CAST(n_chars > 1000 AS DOUBLE)) AS test_accuracy,
  format('{:.1f}%', avg(CAST(n_chars > 2000 AS DOUBLE)) * 100) AS "Training",
  format('{:.1f}%', avg(CAST(n_chars > 1000 AS DOUBLE)) * 100) AS "Test" FROM documents GROUP BY lang""")
def results(spark, folder):
    return md.results_table(table(spark, folder, "documents").groupBy(F.col("lang").alias("llm")).agg(
        F.avg((F.col("n_chars") > 2000).cast("double")).alias("train_accuracy"),
        F.avg((F.col("n_chars") > 1000).cast("double")).alias("test_accuracy")))


# ------------------------------------------------------------------------- selection
# A coefficient table from the data: contrast of mean rates of English and other documents.
_COEFS = f"""{_FW}, lang AS (SELECT doc_id, lang = 'en' AS en FROM documents),
m AS (SELECT item, sum(value) FILTER (en) AS a, sum(value) FILTER (NOT en) AS b
   FROM fw JOIN lang ON fw.doc_id = lang.doc_id GROUP BY item),
coefs AS (SELECT CASE WHEN length(item) = 2 THEN 'pos_bigrams:' ELSE 'func_words:' END || item AS feature,
   round(coalesce(a, 0) - coalesce(b, 0), 6) AS human, -round(coalesce(a, 0) - coalesce(b, 0), 6) AS gpt,
   CAST(row_number() OVER (ORDER BY item) - 1 AS INTEGER) AS ord FROM m)"""


def coefs(spark, folder):
    long = style.sparse_long(func_word_profiles(spark, folder))
    docs = table(spark, folder, "documents").select("doc_id", (F.col("lang") == "en").alias("en"))
    per = long.join(docs, "doc_id").groupBy("item").agg(
        F.sum(F.when(F.col("en"), F.col("value")).otherwise(-F.col("value"))).alias("c"))
    from pyspark.sql import Window as W
    # at most one row per vocabulary item
    ordinal = F.row_number().over(W.partitionBy().orderBy("item")) - 1
    kind = F.when(F.length("item") == 2, "pos_bigrams:").otherwise("func_words:")
    c = F.round("c", 6)
    return per.select(F.concat(kind, "item").alias("feature"), c.alias("human"), (-c).alias("gpt"),
                      ordinal.alias("ord"))


@query("n1_by_magnitude", f"WITH {_COEFS} SELECT feature, human, gpt, ord FROM coefs")
def by_magnitude(spark, folder):
    return sel.order_by_magnitude(coefs(spark, folder), "gpt")


@query("n2_extremes", f"""WITH {_COEFS} SELECT * FROM (
SELECT *, 'top' AS side, CAST(row_number() OVER (ORDER BY abs(human) DESC, ord) AS INTEGER) AS place FROM coefs
UNION ALL SELECT *, 'bottom', CAST(row_number() OVER (ORDER BY abs(human), ord DESC) AS INTEGER) FROM coefs)
WHERE place <= 10""")
def extremes(spark, folder):
    return sel.extremes(coefs(spark, folder))


@query("n3_top", f"WITH {_COEFS} SELECT * FROM coefs ORDER BY abs(human) DESC, ord LIMIT 12")
def top(spark, folder):
    return sel.top_features(coefs(spark, folder), 12)


_TOP = f"""{_COEFS}, top AS (SELECT split_part(feature, ':', 1) AS feature,
   substr(feature, strpos(feature, ':') + 1) AS item, human, ord FROM
   (SELECT * FROM coefs ORDER BY abs(human) DESC, ord LIMIT 12))"""


@query("n4_by_type", f"""WITH {_TOP} SELECT feature AS type,
  string_agg(item, ' ' ORDER BY abs(human) DESC, ord) AS items FROM top GROUP BY feature""")
def by_type(spark, folder):
    return sel.by_type(sel.top_features(coefs(spark, folder), 12)).select(
        "type", F.array_join("items", " ").alias("items"))


def _chosen(spark, folder):
    top12 = sel.top_features(coefs(spark, folder), 12)
    return top12.select(lb.feature_type(F.col("feature")).alias("feature"),
                        lb.feature_value(F.col("feature")).alias("item"), "ord")


_VOCAB_ROWS = [(f, w, n) for f in VOCABS
               for n, w in enumerate(dict.fromkeys(VOCABS[f]))]


@query("n5_filtered_vocab", f"""WITH {_TOP}, v(feature, item, ord) AS (VALUES {values_table(_VOCAB_ROWS)})
SELECT feature, item, CAST(ord AS INTEGER) AS ord FROM v WHERE feature NOT IN {in_list(fv.SELECTABLE_VOCABS)}
UNION ALL SELECT feature, item, ord FROM top WHERE feature IN {in_list(fv.SELECTABLE_VOCABS)}""")
def filtered_vocab(spark, folder):
    vocab = spark.createDataFrame(_VOCAB_ROWS, "feature string, item string, ord int")
    return sel.filtered_vocab(vocab, _chosen(spark, folder))


@query("n6_config", f"""WITH {_TOP}, t(feature) AS (VALUES {values_table([(t,) for t in fv.CONFIGURABLE_TYPES])})
SELECT feature, CAST(feature IN (SELECT feature FROM top) AS INTEGER) AS enabled FROM t""")
def feature_config(spark, folder):
    return sel.feature_config(_chosen(spark, folder))


KEPT = ["the", "of", "is"]


@query("n7_restricted", f"""WITH {_FW} SELECT doc_id, 'func_words' AS feature, item, value FROM fw
WHERE item IN {in_list(KEPT)}""")
def restricted(spark, folder):
    """Selection before counting: other words never reach the shuffle."""
    vocabs, config = sel.selected_vocabs([f"func_words:{w}" for w in KEPT])
    profiles = style.vectorize(lexical_tokens(spark, folder), config=config, vocabs=vocabs)
    return style.sparse_long(profiles).select("doc_id", "feature", "item", "value")


# ------------------------------------------------------------------------- comparison
# Two vector sets: function words as they are and lower-cased (simple profile, per token).
_OTHER = f"""{_FW}, ab AS (SELECT doc_id, 'func_words:' || item AS feature, value AS a, 0 AS b FROM fw
   UNION ALL SELECT t.doc_id, 'func_words:' || low, 0, CAST(count(*) AS DOUBLE) / max(nt.n) FROM tok t
   JOIN nt ON t.doc_id = nt.doc_id WHERE low IN (SELECT item FROM vocab WHERE item <> 'the')
   GROUP BY t.doc_id, low),
d AS (SELECT doc_id, feature, abs(sum(a) - sum(b)) AS diff FROM ab GROUP BY doc_id, feature)"""


def _two_sets(spark, folder):
    tok = lexical_tokens(spark, folder)
    name = F.concat_ws(":", "feature", "item").alias("feature")
    a = style.sparse_long(style.vectorize(tok, config=FEW)).select("doc_id", name, "value")
    vocabs = VOCABS | {"func_words": [w for w in VOCABS["func_words"] if w != "the"]}
    lower = tok.withColumn("token", F.lower("token"))
    b = style.sparse_long(style.vectorize(lower, config=FEW, vocabs=vocabs)) \
        .select("doc_id", name, "value")
    return a, b


@query("o1_overlap", f"""WITH {_OTHER} SELECT feature, CASE WHEN max(a) > 0 AND max(b) > 0 THEN 'both'
  WHEN max(a) > 0 THEN 'a' ELSE 'b' END AS side FROM ab GROUP BY feature""")
def overlap(spark, folder):
    return cp.column_overlap(*_two_sets(spark, folder))


@query("o1_overlap_by_prefix", f"""WITH {_OTHER}, s AS (SELECT feature, CASE WHEN max(a) > 0 AND max(b) > 0 THEN 'both'
  WHEN max(a) > 0 THEN 'a' ELSE 'b' END AS side FROM ab GROUP BY feature)
SELECT split_part(feature, ':', 1) AS prefix, count(*) FILTER (side = 'a') AS only_a,
  count(*) FILTER (side = 'b') AS only_b, count(*) FILTER (side = 'both') AS both FROM s GROUP BY 1""")
def overlap_by_prefix(spark, folder):
    return cp.overlap_by_prefix(*_two_sets(spark, folder))


@query("o2_differences", f"""WITH {_OTHER} SELECT round(max(diff), 9) AS max_diff,
  round(sum(diff) / count(*), 9) AS mean_diff, count(*) FILTER (diff > 1e-6) AS over FROM d""")
def differences(spark, folder):
    df = cp.difference_summary(*_two_sets(spark, folder))
    return df.withColumns({"max_diff": F.round("max_diff", 9), "mean_diff": F.round("mean_diff", 9)})


@query("o3_most_different", f"""WITH {_OTHER} SELECT feature, max(diff) AS max_diff FROM d GROUP BY feature
ORDER BY max_diff DESC, feature LIMIT 10""")
def most_different(spark, folder):
    return cp.most_different(*_two_sets(spark, folder), 10)
