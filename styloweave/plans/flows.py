"""End-to-end flows: train and report, pairwise, within and across corpora.

All flows take vectors (`doc_id, author_id, model_category, features`) that were computed
once, normally by `sources.materialise`, so each fit reads stored vectors instead of text.
Models of several categories are fitted together, and all accuracies come from one pass of
confusion counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorSlicer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloweave.functions import fixed_values as fv
from styloweave.operators import modeling as md
from styloweave.operators import newton
from styloweave.operators import sampling as sp
from styloweave.operators.tokens import by_repetition
from styloweave.session import checkpointed

RESULT = ("llm string, train_accuracy double, test_accuracy double, "
          "n_train long, n_test long")
HUMAN = "human"


@dataclass
class Fitted:
    """Models fitted together and their confusion counts: (model, part, label, prediction) to rows."""

    names: list[str]
    models: list[md.AuthorshipModel]
    counts: dict[tuple[int, int, int, int], int]
    rows: DataFrame     # packed, with `parts`

    def size(self, k: int, part: int) -> int:
        return sum(n for (m, p, _, _), n in self.counts.items() if (m, p) == (k, part))

    def accuracy(self, k: int, part: int) -> float:
        right = sum(n for (m, p, y, z), n in self.counts.items() if (m, p) == (k, part) and y == z)
        return right / self.size(k, part) if self.size(k, part) else float("nan")

    def results(self) -> DataFrame:
        rows = [(name, self.accuracy(k, newton.TRAIN), self.accuracy(k, newton.TEST), self.size(k, newton.TRAIN),
                 self.size(k, newton.TEST)) for k, name in enumerate(self.names)]
        return md.results_table(self.rows.sparkSession.createDataFrame(rows, RESULT))

    def report(self, k: int = 0) -> DataFrame:
        """The report of a model's test part."""
        classes = self.models[k].classes
        rows = [(classes[y], classes[z], n) for (m, p, y, z), n in self.counts.items() if (m, p) == (k, newton.TEST)]
        return md.report_of(self.rows.sparkSession.createDataFrame(rows, "y string, p string, n long"))


def fit_together(labelled: DataFrame, names: list[str], parts: Column, width: int, label: str = "author_id",
                 keep: list[str] = ()) -> Fitted:
    """Fit one model for each entry of `parts` and count what each predicts. Rows without a label are left out.

    Each model needs training rows of both labels.
    """
    classes = md.two_classes(labelled.where(F.exists(parts, lambda p: p == newton.TRAIN)), label)
    known = labelled.where(F.col(label).isNotNull())
    rows = checkpointed(newton.packed(known, F.col(label).cast("string") == classes[1], parts, keep))
    fits = newton.fit_many(rows, len(names), width)
    counts = {(r["model"], r["part"], r["y"], r["p"]): r["n"] for r in newton.confusions(rows, fits, width).collect()}
    for k, name in enumerate(names):
        if len({y for m, p, y, _ in counts if (m, p) == (k, newton.TRAIN)}) != 2:
            raise ValueError(f"{name}: two classes are needed to train")
    return Fitted(names, [md.as_model(classes, f) for f in fits], counts, rows)


@dataclass
class Evaluation:
    model: md.AuthorshipModel
    predictions: DataFrame
    report: DataFrame
    train_accuracy: float
    test_accuracy: float
    n_train: int
    n_test: int


def _side(df: DataFrame, part: int) -> DataFrame:
    return df.withColumn("parts", F.array(F.lit(part)))


def evaluate(train: DataFrame, test: DataFrame) -> Evaluation:
    """Fit on one set of vectors and score another."""
    columns = ["author_id", "features", "parts"]
    both = _side(train, newton.TRAIN).select(columns).unionByName(_side(test, newton.TEST).select(columns))
    return _evaluation(fit_together(both, ["all"], F.col("parts"), newton.width_of(train)), test)


def _evaluation(done: Fitted, test: DataFrame) -> Evaluation:
    return Evaluation(done.models[0], done.models[0].predict(test), done.report(), done.accuracy(0, newton.TRAIN),
                      done.accuracy(0, newton.TEST), done.size(0, newton.TRAIN), done.size(0, newton.TEST))


def _evaluated(parts: DataFrame) -> Evaluation:
    """Of rows with a `split`."""
    train, test = (parts.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    return evaluate(train, test)


def within_corpus(vectors: DataFrame, fraction: float = 0.2, seed: int = 42) -> Evaluation:
    return _evaluated(sp.stratified_split(vectors, "author_id", fraction, seed))


def train_and_report(vectors: DataFrame, held_out: float = 0.4, seed: int = 42) -> Evaluation:
    """Train on 60 %, report on the test 20 %; the development 20 % stays unused."""
    return _evaluated(sp.three_way_split(vectors, "author_id", held_out, seed))


def on_top_features(vectors: DataFrame, model: md.AuthorshipModel, n: int) -> DataFrame:
    """The vectors restricted to the `n` features of largest weight, ties in column order."""
    weights = model.weights
    order = sorted(range(len(weights)), key=lambda i: (-abs(weights[i]), i))[:n]
    return VectorSlicer(inputCol="features", outputCol="_top", indices=sorted(order)).transform(vectors) \
        .drop("features").withColumnRenamed("_top", "features")


def refit_on_top(vectors: DataFrame, n: int, fraction: float = 0.2, seed: int = 42) -> Evaluation:
    """Select on the training part, restrict both parts, fit again and report."""
    parts = checkpointed(sp.stratified_split(vectors, "author_id", fraction, seed))
    train, test = (parts.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    model = md.train_model(train)
    return evaluate(on_top_features(train, model, n), on_top_features(test, model, n))


def _classed(vectors: DataFrame) -> DataFrame:
    """With `_class`: human, or else the category."""
    return vectors.withColumn("_class", F.when(F.col("author_id") == HUMAN, HUMAN).otherwise(F.col("model_category")))


def fit_pairs(vectors: DataFrame, categories: list[str] | None = None, fraction: float = 0.2, seed: int = 42,
              keep: list[str] = ()) -> Fitted:
    """Human against each category: one split, one optimisation and one count for all pairs."""
    names = list(categories or fv.CORPUS_CATEGORIES[1:])
    wanted = _classed(vectors).where(F.col("_class").isin(HUMAN, *names))
    parts = sp.paired_splits(wanted, "_class", HUMAN, names, fraction, seed)
    return fit_together(parts, names, F.col("parts"), newton.width_of(vectors), keep=keep)


def pairwise(vectors: DataFrame, categories: list[str] | None = None, fraction: float = 0.2,
             seed: int = 42) -> DataFrame:
    """Human against each category: split, fit, and accuracy on both parts."""
    return fit_pairs(vectors, categories, fraction, seed).results()


def fit_across(train: DataFrame, test: DataFrame, categories: list[str] | None = None,
               keep: list[str] = ()) -> Fitted:
    """Fit on one corpus and count on another, as a whole or for all categories together."""
    names = list(categories or ["all"])

    def of(df: DataFrame, part: int) -> DataFrame:
        own = [F.when(F.col("_class").isin(HUMAN, name) if categories else F.lit(True), part).otherwise(newton.ABSENT)
               for name in names]
        return _classed(df).select("author_id", "features", F.array(*own).alias("parts"), *keep)

    both = of(train, newton.TRAIN).unionByName(of(test, newton.TEST))
    return fit_together(both, names, F.col("parts"), newton.width_of(train), keep=keep)


def across_corpora(train: DataFrame, test: DataFrame,
                   categories: list[str] | None = None) -> DataFrame:
    """Fit on one corpus and score another, as a whole or per category."""
    return fit_across(train, test, categories).results()


def _entries(rows: DataFrame, width: int, *keep: str) -> DataFrame:
    """`*keep, y, model, part, e`: the entries of each row in each model, with one for the intercept, as an array."""
    return rows.select(
        *keep, "y", F.posexplode("parts").alias("model", "part"),
        F.arrays_zip(F.concat("indices", F.array(F.lit(width))).alias("ord"),
                     F.concat("values", F.array(F.lit(1.0))).alias("v")).alias("e")).where("part > 0")


def _margins(rows: DataFrame, weights: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """`model, part, y, m` of each row, and `model, ord, s`, what its entries add to the slopes. Nothing but sums is shuffled."""
    lists = weights.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("ord", "factor", "weight"))).alias("w")) \
        .select("model", F.col("w.factor").alias("factors"), F.transform("w", lambda x: x["factor"] * x["weight"]).alias("w"))
    m = F.aggregate("e", F.lit(0.0), lambda t, x: t + x["v"] * F.get("w", x["ord"]))
    margins = _entries(rows, width).join(F.broadcast(lists), "model").select("model", "part", "y", "e", "factors", m.alias("m"))
    r = 1 / (1 + F.exp(-F.col("m"))) - F.col("y")
    parts = margins.where(f"part = {newton.TRAIN}").select("model", F.explode(F.transform(
        "e", lambda x: F.struct(x["ord"].alias("ord"), (x["v"] * F.get("factors", x["ord"]) * r).alias("s")))).alias("e"))
    return margins.select("model", "part", "y", "m"), parts.select("model", "e.ord", "e.s")


def _margins_by_id(rows: DataFrame, key: str, weights: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """`_margins` of rows whose id repeats: their entries meet by it."""
    entries = _entries(rows, width, F.col(key).alias("id")).select("id", "y", "model", "part", F.explode("e").alias("e")) \
        .select("id", "y", "model", "part", F.col("e.ord").alias("ord"), F.col("e.v").alias("v")) \
        .join(F.broadcast(weights), ["model", "ord"])
    margins = entries.groupBy("id", "model", "part", "y").agg(
        F.sum(F.col("v") * F.col("factor") * F.col("weight")).alias("m"))
    residual = margins.where(f"part = {newton.TRAIN}").select(
        "id", "model", (1 / (1 + F.exp(-F.col("m"))) - F.col("y")).alias("r"))
    parts = entries.where(f"part = {newton.TRAIN}").join(residual, ["id", "model"]).select(
        "model", "ord", (F.col("v") * F.col("factor") * F.col("r")).alias("s"))
    return margins.select("model", "part", "y", "m"), parts


def certificate(done: Fitted, key: str = "doc_id") -> DataFrame:
    """`llm, n_train, n_test, slope, counts_agree`, worked out anew by joins from the coefficients.

    `slope` is the largest slope of the penalised loss; the counts are those that accuracies are made
    of. `done` was fitted with `keep=[key]`, and ids are unique.
    """
    spark = done.rows.sparkSession
    weights = spark.createDataFrame(
        [(k, i, float(f), float(w)) for k, m in enumerate(done.models)
         for i, (f, w) in enumerate([*zip(m.factors, m.weights), (1.0, m.intercept)])],
        "model int, ord int, factor double, weight double")
    width = len(done.models[0].weights)
    once, several = by_repetition(done.rows, key)
    margins, parts = _margins(once, weights, width)
    if several is not None:
        more, others = _margins_by_id(several, key, weights, width)
        margins, parts = margins.unionByName(more), parts.unionByName(others)
    slopes = parts.groupBy("model", "ord").agg(F.sum("s").alias("slope")) \
        .join(weights, ["model", "ord"], "right") \
        .withColumn("slope", F.coalesce("slope", F.lit(0.0)) + F.when(F.col("ord") < width, F.col("weight")).otherwise(0.0))
    told = spark.createDataFrame([(*k, n) for k, n in done.counts.items()], "model int, part int, y int, p int, told long")
    found = margins.groupBy("model", "part", F.col("y").cast("int").alias("y"), (F.col("m") > 0).cast("int").alias("p")) \
        .agg(F.count("*").alias("n")).join(told, ["model", "part", "y", "p"], "full")
    counts = found.groupBy("model").agg(
        F.sum(F.when(F.col("part") == newton.TRAIN, F.col("n")).otherwise(0)).alias("n_train"),
        F.sum(F.when(F.col("part") == newton.TEST, F.col("n")).otherwise(0)).alias("n_test"),
        F.bool_and(F.coalesce(F.col("n") == F.col("told"), F.lit(False))).alias("counts_agree"))
    names = spark.createDataFrame(list(enumerate(done.names)), "model int, llm string")
    return slopes.groupBy("model").agg(F.max(F.abs("slope")).alias("slope")).join(counts, "model").join(names, "model") \
        .select("llm", "n_train", "n_test", "slope", "counts_agree")
