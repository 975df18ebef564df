"""Merkle manifest of a table: a leaf hash for each row, a subroot for each group, one root, and proofs.

Leaves take their places within their group by ranges of the whole order, so a group of any size is
spread over all tasks. A level of the tree is a table (key, idx, n, hash). Fixed-offset lag and lead
columns over the rows of a run, masked by the row's slot and the run's length, supply each node's
siblings; the first row of a run hashes the run into the parent. A level has an `arity`-th of the
rows of the one below it, and only digests are shuffled: texts are hashed where they are read.
From the top down, each level then hands its siblings to its children, so a leaf ends with the list
of (before, after) that a proof needs. Windows hold one run.

A level is stored in the shared folder before the next one, so a lost executor costs a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from styloweave.llm.places import placed
from styloweave.llm.storage import stored
from styloweave.session import broadcast_if_small

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<before:string,after:string>"


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """`nodes` with `run`, and `before` and `after`: the digests of the run on either side, joined."""
    slot = F.col("idx") % arity
    nodes = nodes.withColumn("run", ((F.col("idx") - slot) / arity).cast("long"))
    length = F.least(F.lit(arity), F.col("n") - F.col("run") * arity)
    line = Window.partitionBy("key", "run").orderBy("idx")
    before = [F.when(slot >= k, F.lag("hash", k).over(line)).otherwise("") for k in range(arity - 1, 0, -1)]
    after = [F.when(slot + k < length, F.lead("hash", k).over(line)).otherwise("") for k in range(1, arity)]
    return nodes.withColumns({"before": F.concat(*before), "after": F.concat(*after)})


def levels(nodes: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """All levels of the trees of `nodes` (key, idx, n, hash), one tree for each key; the last holds roots."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = with_siblings(out[-1].where("n > 1"), arity).where(F.col("idx") % arity == 0)
        out.append(stored(first.select("key", F.col("run").alias("idx"),
                                       F.ceil(F.col("n") / arity).cast("long").alias("n"),
                                       F.sha2(F.concat("hash", "after"), 256).alias("hash"))))
        most = -(-most // arity)
    return out


def paths(tree: list[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """The lowest level's rows with `path`, the siblings from there to the end of `above`, and `subroot`.

    `above` has key, path and subroot, for each tree what lies above its root.
    """
    ends = above.select("key", F.col("path").alias("up"), F.col("subroot"))
    higher = None
    for level in reversed(tree):
        alone = level.where("n = 1").join(broadcast_if_small(ends), "key").withColumnRenamed("up", "path")
        if higher is None:
            higher = alone
        else:
            up = higher.select("key", F.col("idx").alias("run"), F.col("path").alias("up"), "subroot")
            wide = with_siblings(level.where("n > 1"), arity).join(up, ["key", "run"])
            step = F.array(F.struct("before", "after"))
            higher = wide.withColumn("path", F.concat(step, "up")).select(*level.columns, "path", "subroot") \
                .unionByName(alone.select(*level.columns, "path", "subroot"))
        if level is not tree[0]:
            higher = stored(higher)
    return higher


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda held, s: F.sha2(F.concat(s["before"], held, s["after"]), 256))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text",
             fields: tuple[str, ...] = FIELDS, tampered: Column | None = None,
             arity: int = ARITY) -> DataFrame:
    """One row per row of `docs`: doc_id, leaf, subroot, root, path, folded_root, verified.

    `path` lists the siblings (before, after) of each level. `folded_root` is computed from the leaf
    as found now and the original siblings; where `tampered` (a condition on `docs`) holds, the leaf
    is found with the text's A-Z lower-cased. Rows of a group ascend by id, nulls first, ties by leaf.
    A null group is a group, and comes first among the groups, which are in UTF-8 order. A null field counts as `-`,
    an empty one as `0:`. Repeated rows are leaves of their own. An empty table gives no rows. Other columns are not carried,
    whatever their names.
    """
    values = [F.col(c) for c in fields]
    changed = [F.translate(c, UPPER, LOWER) if name == text_col else c for name, c in zip(fields, values)]
    hit = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    group = F.col(group_col).cast("string")
    leaves = stored(docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group)).alias("key"),
        leaf_hash(values).alias("hash"), F.when(hit, leaf_hash(changed)).alias("found"),
        F.monotonically_increasing_id().alias("tie")))
    rows = stored(placed(leaves, "key", [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("tie")]))
    tree = levels(rows.select("key", "idx", "n", "hash"), arity)
    subroots = [level.where("n = 1").select("key", "hash") for level in tree]
    tops = subroots[0]
    for more in subroots[1:]:
        tops = tops.unionByName(more)
    tops = stored(placed(tops.select(F.lit("").alias("key"), F.col("key").alias("group"), "hash"),
                         "key", [F.col("group")]))
    upper = levels(tops.drop("group"), arity)
    root = upper[-1].first()
    root = F.lit(root["hash"] if root else None).cast("string")
    above = paths(upper, docs.sparkSession.createDataFrame(
        [("", [], "")], f"key string, path array<{STEP}>, subroot string"), arity)
    above = stored(above.select("idx", "path").join(tops, "idx")
                   .select(F.col("group").alias("key"), "path", F.col("hash").alias("subroot")))
    tree[0] = rows  # with ids
    full = paths(tree, above, arity)
    return full.withColumn("folded_root", folded(F.coalesce("found", "hash"), F.col("path"))).select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), "path", "folded_root",
        (F.col("folded_root") == root).alias("verified"))


def tampering(id_col: str = "doc_id") -> Column:
    """Where 3 divides the CRC of the decimal id; a null id is left alone."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 0


def report(rows: DataFrame) -> DataFrame:
    """The digest of each proof instead of its siblings."""
    joined = F.concat_ws("", F.transform("path", lambda s: F.concat(s["before"], s["after"])))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(joined, 256).alias("proof_sha256"),
                       "folded_root", "verified")
