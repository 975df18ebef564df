"""Syntactic constructions: regular expressions over linearised dependency trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from styloweave.functions import fixed_values as fv


def patterns_for(language: str = "en", add: dict[str, str] | None = None,
                 remove: list[str] = ()) -> dict[str, str]:
    """Pattern table of a language, with additions (which override) and removals."""
    if language not in fv.PATTERNS_BY_LANGUAGE:
        raise ValueError(f"no construction patterns for language {language!r}")
    patterns = {**fv.PATTERNS_BY_LANGUAGE[language], **(add or {})}
    unknown = [name for name in remove if name not in patterns]
    if unknown:
        raise KeyError(f"not registered: {', '.join(unknown)}")
    return {name: p for name, p in patterns.items() if name not in remove}


def _flat(heads: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence of each node, index of its parent in the batch or -1, node offsets of sentences)."""
    at = heads.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    up = heads.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    sentence = np.repeat(np.arange(len(at) - 1), np.diff(at))
    here = np.arange(len(up)) - at[sentence]
    inside = (up >= 0) & (up < np.diff(at)[sentence]) & (up != here)
    return sentence, np.where(inside, up + at[sentence], -1), at


def _levels(parent: np.ndarray, roots: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Nodes of each level below `roots`, siblings in order; and the number of children and children by parent.

    One round for each level of the deepest tree of the batch, over all its sentences at once.
    """
    below = np.argsort(parent, kind="stable")[int((parent < 0).sum()):]
    n_kids = np.bincount(parent[below], minlength=len(parent))
    first = np.concatenate(([0], np.cumsum(n_kids)))
    out, level = [], roots
    while len(level):
        out.append(level)
        level = level[n_kids[level] > 0]
        n = n_kids[level]
        source = np.arange(n.sum()) + np.repeat(first[level] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        level = below[source]
    return out, n_kids, below


def _before(sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sum of the earlier entries of the same group; groups are runs."""
    total = np.cumsum(sizes) - sizes
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return total - np.repeat(total[start], np.diff(start, append=len(group)))


def preorder_trees(heads: pa.Array, labels: pa.Array) -> pa.Array:
    """Trees of a batch of sentences in preorder; `)` follows each leaf, the others come last.

    A node's place is its parent's plus the sizes of its elder siblings, sizes being summed from the
    deepest level up. Nodes that reach no root, as their heads form a ring, are left out.
    """
    if not len(heads):
        return pa.array([], pa.string())
    sentence, parent, at = _flat(heads)
    roots = np.flatnonzero(parent < 0)
    levels, n_kids, _ = _levels(parent, roots)
    size, place = np.ones(len(parent), np.int64), np.full(len(parent), -1)
    for level in reversed(levels[1:]):      # siblings are runs; a level costs its own nodes, not those of the batch
        own = parent[level]
        runs = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        size[own[runs]] += np.add.reduceat(size[level], runs)
    if len(roots):
        place[roots] = _before(size[roots], sentence[roots])
    for level in levels[1:]:
        place[level] = place[parent[level]] + 1 + _before(size[level], parent[level])
    reached = np.flatnonzero(place >= 0)
    order = reached[np.lexsort((place[reached], sentence[reached]))]
    leaf = pa.array(n_kids[order] == 0)
    nodes = pa.compute.binary_join_element_wise(
        pa.scalar("("), labels.flatten().take(pa.array(order)), pa.compute.if_else(leaf, ")", ""), "")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(sentence[order], minlength=len(at) - 1)))).astype(np.int32)
    joined = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(bounds), nodes), "")
    closing = np.bincount(sentence[n_kids > 0], minlength=len(at) - 1)
    ends = pa.compute.binary_repeat(pa.array([")"] * len(closing)), pa.array(closing))
    return pa.compute.binary_join_element_wise(joined, ends, "")


def _preorder(heads, labels) -> str:
    """The tree of one sentence."""
    return preorder_trees(pa.array([list(heads)], pa.list_(pa.int32())), pa.array([list(labels)], pa.list_(pa.string())))[0].as_py()


@F.arrow_udf(T.StringType())
def linear_tree(heads: pa.Array, labels: pa.Array) -> pa.Array:
    return preorder_trees(heads, labels)


TREE_SHAPE = T.StructType([T.StructField(n, T.IntegerType())
                           for n in ("depth", "width", "parents")])


def shapes(heads: pa.Array) -> pa.Array:
    """Depth in nodes, largest level and number of nodes with children, per sentence.

    Only nodes that head themselves are roots.
    """
    sentence, parent, at = _flat(heads)
    up = heads.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    own = up == np.arange(len(up)) - at[sentence]
    n = len(at) - 1
    depth, width = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for level in _levels(parent, np.flatnonzero(own))[0]:
        held = np.bincount(sentence[level], minlength=n)
        depth += held > 0
        width = np.maximum(width, held).astype(np.int32)
    named = np.unique(np.stack([sentence[~own], up[~own]]), axis=1)[0] if len(up) else np.zeros(0, np.int64)
    parents = np.bincount(named, minlength=n).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(depth), pa.array(width), pa.array(parents)], names=TREE_SHAPE.names)


@F.arrow_udf(TREE_SHAPE)
def tree_shape(heads: pa.Array) -> pa.Array:
    return shapes(heads)


def sentence_rows(tok: DataFrame) -> DataFrame:
    """One row per sentence: words, labels and heads (as positions), in order.

    A sentence is the unit of every tree pattern and is kept whole.
    """
    label = F.concat_ws("-", "token", "lemma", "tag", "dep")
    return (tok.groupBy("doc_id", "sentence_id")
            .agg(F.sort_array(F.collect_list(F.struct(
                "token_id", "token", label.alias("label"), "head_token_id"))).alias("s"))
            .select("doc_id", "sentence_id",
                    F.array_join("s.token", " ").alias("sentence"),
                    F.col("s.label").alias("labels"),
                    F.transform("s", lambda x: x.head_token_id - F.col("s")[0].token_id)
                    .alias("heads")))


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables that end with a group, such as a sentence; a new one begins where the last column is 0."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        first = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy() == 0)
        if len(first):
            held.append(batch.slice(0, first[-1]))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
            batch = batch.slice(first[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _per_sentence(tok: DataFrame, of: Callable[[pa.Array, Callable], dict[str, pa.Array]], schema: str) -> DataFrame:
    """Rows of `schema` for each sentence of a table in order, without a shuffle.

    `of` gets the heads as positions and a function that gathers a column by sentence.
    """
    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            if not len(rows):
                continue
            own = {name: rows[name].combine_chunks() for name in rows.column_names}
            own = {name: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for name, c in own.items()}
            first = np.flatnonzero(own["sent_pos"].to_numpy() == 0)
            bounds = np.append(first, len(rows)).astype(np.int32)
            start = own["token_id"].to_numpy()[np.repeat(first, np.diff(bounds))]

            def gathered(values: pa.Array) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(bounds), values)
            heads = gathered(pa.array((own["head_token_id"].to_numpy() - start).astype(np.int32)))
            keys = {name: own[name].take(pa.array(first)) for name in ("doc_id", "sentence_id")}
            out = keys | of(heads, lambda name, own=own, gathered=gathered: gathered(own[name]))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    label = F.concat_ws("-", "token", "lemma", "tag", "dep").alias("label")
    kind = tok.schema["doc_id"].dataType.simpleString()
    return tok.select("doc_id", "sentence_id", "token_id", "head_token_id", "token", label, "sent_pos") \
        .mapInArrow(sentences, f"doc_id {kind}, sentence_id int, {schema}")


def ordered_trees(tok: DataFrame) -> DataFrame:
    """`linear_trees` of a token table whose partitions hold each sentence's rows together, in order, from its
    first token (`sent_pos` 0) on, as tokenising leaves them. Nothing is shuffled.

    Documents are not merged: use `linear_trees` for ids that repeat.
    """
    return _per_sentence(tok, lambda heads, column: {
        "sentence": pa.compute.binary_join(column("token"), " "),
        "tree": preorder_trees(heads, column("label"))}, "sentence string, tree string")


def ordered_shapes(tok: DataFrame) -> DataFrame:
    """`doc_id, sentence_id, n, t` (see `tree_shape`) of a token table as `ordered_trees` takes it."""
    def of(heads: pa.Array, _) -> dict[str, pa.Array]:
        return {"n": heads.value_lengths(), "t": shapes(heads)}
    bare = tok.withColumns({c: F.lit("") for c in ("token", "lemma", "tag", "dep")})
    return _per_sentence(bare, of, "n int, t struct<depth:int,width:int,parents:int>")


def linear_trees(tok: DataFrame) -> DataFrame:
    """`doc_id, sentence_id, sentence, tree`."""
    return sentence_rows(tok).select("doc_id", "sentence_id", "sentence",
                                     linear_tree("heads", "labels").alias("tree"))


def _contains_required(tree: Column, name: str, pattern: str) -> Column:
    """Plain substring tests every match must pass; true for patterns of the user."""
    if all(known.get(name) != pattern for known in fv.PATTERNS_BY_LANGUAGE.values()):
        return F.lit(True)
    tests = [reduce(Column.__or__, [tree.contains(t) for t in any_of])
             for any_of in fv.REQUIRED_TEXT[name]]
    return reduce(Column.__and__, tests)


def java_pattern(pattern: str) -> str:
    """Make `\\w`, `\\s` cover Unicode and `.` stop at newlines only."""
    return "(?dU)" + pattern


def matching(tree: Column, name: str, pattern: str) -> Column:
    """Whether a tree matches; substring tests come first, so most never meet the regular expression."""
    return _contains_required(tree, name, pattern) & tree.rlike(java_pattern(pattern))


def matches_in_trees(trees: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """`doc_id, sentence_id, pattern_name, matched, sentence` for each matching pattern.

    Substring tests come first, so most sentences never meet a regular expression.
    """
    patterns = patterns if patterns is not None else fv.ENGLISH_PATTERNS
    if not patterns:
        return trees.select("doc_id", "sentence_id", F.lit("").alias("pattern_name"),
                            F.lit("").alias("matched"), "sentence").where("false")
    tree = F.col("tree")
    hits = [F.when(matching(tree, name, p),
                   F.struct(F.lit(name).alias("pattern_name"),
                            F.regexp_extract(tree, java_pattern(p), 0).alias("matched")))
            for name, p in patterns.items()]
    return (trees.select("doc_id", "sentence_id", "sentence",
                         F.explode(F.array_compact(F.array(*hits))).alias("m"))
            .select("doc_id", "sentence_id", "m.pattern_name", "m.matched", "sentence"))


def construction_matches(tok: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    return matches_in_trees(linear_trees(tok), patterns)


def sentence_types(tok: DataFrame, patterns: dict[str, str] | None = None,
                   trees: DataFrame | None = None) -> DataFrame:
    """Constructions per document; for documents with none, its sentences by end mark.

    Returns `doc_id, item, n` (declarative, interrogative or exclamatory as the fallback).
    The sentence ends and the matches meet in one aggregation keyed by document. `trees` are those of `tok`, if known.
    """
    trees = linear_trees(tok) if trees is None else trees
    found = (matches_in_trees(trees, patterns)
             .groupBy("doc_id", F.col("pattern_name").alias("item"))
             .agg(F.count("*").alias("n")).withColumn("found", F.lit(1)))
    last = F.col("token")
    ends = (tok.where(F.col("next_pos").isNull())
            .groupBy("doc_id", F.when(last.endswith("?"), "interrogative")
                     .when(last.endswith("!"), "exclamatory")
                     .otherwise("declarative").alias("item"))
            .agg(F.count("*").alias("n")).withColumn("found", F.lit(0)))
    both = found.unionByName(ends).groupBy("doc_id").agg(
        F.collect_list(F.struct("found", "item", "n")).alias("x"))
    wanted = F.when(F.exists("x", lambda e: e.found == 1), 1).otherwise(0)
    return (both.select("doc_id", F.explode(F.filter("x", lambda e: e.found == wanted))
                        .alias("e")).select("doc_id", "e.item", "e.n"))
