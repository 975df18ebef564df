"""Exact stratified splits, samples and limits without sorting a class in one task.

Rows are ordered within their class by a key: a hash of seed and id, or an arrival column. A null
label is a class too. A
histogram of key buckets tells in which bucket each quota is reached; only that bucket is
ranked, which yields one cut point per class and quota. Assigning rows is then a filter
against the cut points. So there are three passes over label and id, texts and other payload
are never shuffled, and a class that holds most rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from styloweave.session import checkpointed, pinned

PREFIX = 4  # hex digits of the hash: 65,536 buckets per class
BUCKETS = 65_536


def hash_key(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_column).cast("string")))


def class_key(label: str) -> Column:
    """The class as text that is never null; a null label is a class of its own, before all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))


def row_key(df: DataFrame) -> Column:
    """Tells rows of the same id apart by all their columns."""
    return F.xxhash64(*[F.col(c) if not t.startswith("map") else F.to_json(c) for c, t in df.dtypes])


def hash_keyed(df: DataFrame, label: str, id_column: str, seed: int) -> DataFrame:
    key = hash_key(id_column, seed)
    return df.select(class_key(label).alias("label"), key.alias("key"),
                     F.coalesce(F.conv(F.substring(key, 1, PREFIX), 16, 10).cast("int"), F.lit(0)).alias("bucket"),
                     F.col(id_column).alias("id"), row_key(df).alias("row"))


def histogram_of(keyed: DataFrame) -> DataFrame:
    """Rows per class and bucket; kept, as sizes, quotas and buckets all read it."""
    return checkpointed(keyed.groupBy("label", "bucket").agg(F.count("*").alias("n")))


def sizes_of(histogram: DataFrame) -> DataFrame:
    return histogram.groupBy("label").agg(F.sum("n").alias("size"))


def held_out_quotas(sizes: DataFrame, fraction: float, size: str = "size", quota: str = "quota",
                    by: list[str] = (), ties: str = "label") -> DataFrame:
    """Held-out rows per class: `ceil(fraction * n)` in total, in proportion to the classes.

    Each class gets the whole part of its share; the largest remainders get one more, ties
    by label. The table has one row per class; with `by`, each group of rows is shared out by itself.
    """
    everyone = W.partitionBy(*by)
    total = F.sum(size).over(everyone)
    held = F.ceil(F.lit(fraction) * total)
    shared = sizes.withColumns({"_n": total, "_held": held})
    parts = shared.withColumns({
        "_base": F.expr(f"(_held * {size}) div _n"), "_rest": F.expr(f"(_held * {size}) % _n")})
    left = F.col("_held") - F.sum("_base").over(everyone)
    order = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("_rest"), ties))
    return (parts.withColumns({"_left": left, "_rank": order})
            .withColumn(quota, F.col("_base") + (F.col("_rank") <= F.col("_left")).cast("long"))
            .drop("_n", "_held", "_base", "_rest", "_left", "_rank"))


def cut_points(keyed: DataFrame, histogram: DataFrame, quotas: DataFrame) -> DataFrame:
    """`label, cut, key, id, row`: the last row within each quota, by key.

    `quotas` has `label, cut, quota`. Quotas of zero have no cut point. `again` tells that the
    next row can't be told from the last one.
    """
    upto = F.sum("n").over(W.partitionBy("label").orderBy("bucket"))
    reached = pinned(histogram.withColumn("upto", upto).join(quotas, "label")
                     .where("quota > upto - n and quota <= upto")
                     .select("label", "cut", "bucket",
                             (F.col("quota") - F.col("upto") + F.col("n")).alias("take")))
    order = W.partitionBy("label", "cut", "bucket").orderBy("key", "id", "row")
    this, following = F.struct("key", "id", "row"), F.lead(F.struct("key", "id", "row")).over(order)
    return (keyed.join(reached, ["label", "bucket"])
            .withColumns({"place": F.row_number().over(order),
                          "again": F.coalesce(this == following, F.lit(False))}).where("place = take")
            .select("label", "cut", "key", "id", "row", "again"))


def _within(df: DataFrame, label: str, here: Column, points: DataFrame,
            cuts: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Rows beside their class's cut points, and per cut whether a row is within its quota."""
    per_class = pinned(points.groupBy(F.col("label").alias("_label")).agg(*[
        F.max(F.when(F.col("cut") == c, F.struct("key", "id", "row"))).alias(f"_cut_{c}")
        for c in cuts], F.bool_or("again").alias("_again")))
    if per_class.where("_again").limit(1).count():
        raise ValueError("equal rows of one id lie on both sides of a cut; drop repeated rows first")
    joined = df.join(per_class, class_key(label) == F.col("_label"), "left")
    return joined, {c: F.coalesce(here <= F.col(f"_cut_{c}"), F.lit(False)) for c in cuts}


def _by_hash(df: DataFrame, label: str, id_column: str, seed: int, quotas_of,
             cuts: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    keyed = hash_keyed(df, label, id_column, seed)
    histogram = histogram_of(keyed)
    points = cut_points(keyed, histogram, quotas_of(sizes_of(histogram)))
    here = F.struct(hash_key(id_column, seed).alias("key"), F.col(id_column).alias("id"), row_key(df).alias("row"))
    return _within(df, label, here, points, cuts)


def stratified_split(df: DataFrame, label: str, fraction: float = 0.2, seed: int = 42,
                     id_column: str = "doc_id") -> DataFrame:
    """`split` is `train` or `test`; sizes are exact and proportional per class."""
    def quotas(sizes):
        return held_out_quotas(sizes, fraction).select(
            "label", F.lit("train").alias("cut"), (F.col("size") - F.col("quota")).alias("quota"))
    rows, within = _by_hash(df, label, id_column, seed, quotas, ["train"])
    return rows.withColumn("split", F.when(within["train"], "train").otherwise("test")).select(
        *df.columns, "split")


def paired_splits(df: DataFrame, label: str, common: str, others: list[str], fraction: float = 0.2, seed: int = 42,
                  id_column: str = "doc_id") -> DataFrame:
    """`parts`: for each of `others`, set against the rows of class `common`: 0 absent, 1 train, 2 test.

    As `stratified_split` of each pair by itself, but with one histogram and one pass for all pairs.
    """
    pairs = df.sparkSession.createDataFrame(
        [(f"p{k}", f"={name}", side) for k, other in enumerate(others) for side, name in ((0, common), (1, other))],
        "cut string, label string, side int")

    def quotas(sizes):
        shares = held_out_quotas(sizes.join(F.broadcast(pairs), "label"), fraction, by=["cut"], ties="side")
        return shares.select("label", "cut", (F.col("size") - F.col("quota")).alias("quota"))

    cuts = [f"p{k}" for k in range(len(others))]
    rows, within = _by_hash(df, label, id_column, seed, quotas, cuts)
    parts = [F.when(F.col(label).isin(common, other), F.when(within[cut], 1).otherwise(2)).otherwise(0)
             for cut, other in zip(cuts, others)]
    return rows.withColumn("parts", F.array(*parts)).select(*df.columns, "parts")


def three_way_split(df: DataFrame, label: str, held_out: float = 0.4, seed: int = 42,
                    id_column: str = "doc_id") -> DataFrame:
    """`train`, `dev` and `test`: a share is held out, then halved, both stratified."""
    def quotas(sizes):
        held = held_out_quotas(sizes, held_out, quota="held")
        halves = held_out_quotas(held, 0.5, size="held", quota="test")
        return halves.select("label", F.explode(F.array(
            F.struct(F.lit("train").alias("cut"), (F.col("size") - F.col("held")).alias("quota")),
            F.struct(F.lit("dev").alias("cut"), (F.col("size") - F.col("test")).alias("quota"))))
            .alias("q")).select("label", "q.*")
    rows, within = _by_hash(df, label, id_column, seed, quotas, ["train", "dev"])
    split = F.when(within["train"], "train").when(within["dev"], "dev").otherwise("test")
    return rows.withColumn("split", split).select(*df.columns, "split")


def _at_most(n: int):
    def quotas(sizes):
        return sizes.select("label", F.lit("n").alias("cut"),
                            F.least(F.col("size"), F.lit(n)).alias("quota"))
    return quotas


def sample_per_class(df: DataFrame, label: str, n: int, seed: int = 42,
                     id_column: str = "doc_id") -> DataFrame:
    """At most `n` rows of each class, chosen by hash."""
    rows, within = _by_hash(df, label, id_column, seed, _at_most(n), ["n"])
    return rows.where(within["n"]).select(*df.columns)


def sample_rows(df: DataFrame, n: int, seed: int = 42, id_column: str = "doc_id") -> DataFrame:
    """`n` rows chosen by hash, without a global sort."""
    one = df.withColumn("_all", F.lit("all"))
    return sample_per_class(one, "_all", n, seed, id_column).drop("_all")


def first_per_class(df: DataFrame, label: str, n: int, arrival: str,
                    id_column: str = "doc_id", accuracy: int = 10_000) -> DataFrame:
    """The first `n` rows of each class by a numeric or time arrival column, ties by id.

    Approximate quantiles bracket the arrival of the n-th row of each class, within their
    guaranteed error; the bracket is cut into equal buckets, whose histogram finds the one
    bucket that holds it. There arrivals are counted before they are ranked, so rows that
    share an arrival are one row. Those at the last arrival are dealt by ranges of their id,
    and only the range in which the quota ends is ranked. Rows without an arrival are never
    among the first.
    """
    at = F.col(arrival)
    number = at.cast("double")
    arrived = df.where(at.isNotNull())
    grid = [i / 1000 for i in range(1001)]
    sketch = arrived.groupBy(class_key(label).alias("label")).agg(
        F.count("*").alias("size"), F.min(number).alias("first"), F.max(number).alias("last"),
        F.percentile_approx(number, grid, accuracy).alias("q"))
    rank = F.least(F.col("size"), F.lit(n)) / F.col("size")
    slack = 4.0 / accuracy
    low_i = F.floor((rank - slack) * 1000).cast("int") - 1
    high_i = F.ceil((rank + slack) * 1000).cast("int") + 1
    bracket = pinned(sketch.select(
        F.col("label").alias("_label"),
        F.when(low_i >= 0, F.get("q", low_i)).otherwise(F.col("first")).alias("low"),
        F.when(high_i <= 1000, F.get("q", high_i)).otherwise(F.col("last")).alias("high")))
    share = F.try_divide(F.col("number") - F.col("low"), F.col("high") - F.col("low"))
    bucket = (F.when(F.col("number") < F.col("low"), -1)
              .when(F.col("number") > F.col("high"), BUCKETS + 1)
              .otherwise(F.floor(F.coalesce(share, F.lit(0.0)) * BUCKETS).cast("int")))
    keyed = (arrived.select(class_key(label).alias("label"), at.alias("key"), number.alias("number"))
             .join(bracket, F.col("label") == F.col("_label"))
             .select("label", "key", bucket.alias("bucket")))
    histogram = histogram_of(keyed)
    quotas = _at_most(n)(sizes_of(histogram))
    upto = F.sum("n").over(W.partitionBy("label").orderBy("bucket"))
    reached = pinned(histogram.withColumn("upto", upto).join(quotas, "label")
                     .where("quota > upto - n and quota <= upto")
                     .select("label", "bucket", (F.col("quota") - F.col("upto") + F.col("n")).alias("take")))
    counted = keyed.join(reached, ["label", "bucket"]).groupBy("label", "key", "take").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(W.partitionBy("label").orderBy("key"))
    last = pinned(counted.withColumn("upto", so_far).where("take > upto - n and take <= upto")
                  .select(F.col("label").alias("_class"), F.col("key").alias("_last"),
                          (F.col("take") - F.col("upto") + F.col("n")).alias("rest")))
    joined = df.join(last, class_key(label) == F.col("_class"))
    before = joined.where(at < F.col("_last")).select(*df.columns)
    tied = joined.where(at == F.col("_last")).select(*df.columns)
    # ranges of the order by id are its buckets
    ranges = checkpointed(tied.select(class_key(label).alias("label"), F.lit("").alias("key"),
                                      F.col(id_column).alias("id"), row_key(df).alias("row"))
                          .repartitionByRange("label", "id").withColumn("bucket", F.spark_partition_id()))
    rest = last.select(F.col("_class").alias("label"), F.lit("n").alias("cut"), F.col("rest").alias("quota"))
    points = cut_points(ranges, histogram_of(ranges), rest)
    here = F.struct(F.lit("").alias("key"), F.col(id_column).alias("id"), row_key(df).alias("row"))
    rows, within = _within(tied, label, here, points, ["n"])
    return before.unionByName(rows.where(within["n"]).select(*df.columns))
