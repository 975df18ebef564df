"""Chat formatting of reply trees.

Messages name their parents. The paths from leaves to roots are enumerated by self-joins that
double: each round knows all ancestors nearer than 2^k and each node's 2^k-th ancestor, so a thread
of n turns takes log2 n joins. Branches are ranked by the sum of their scores, and each chosen path
is formatted as one conversation.

Template: `<s>`, then the turns: `[INST] text [/INST]` of a user, `[SYS] text [/SYS]` of the
system, bare text and `</s>` of an assistant, `[ROLE]name[TEXT]text[/ROLE]` of any other role. In
texts and names a backslash goes before each backslash and each control string. A control string
has no `<`, `[` or blank inside and the template puts only control strings and blanks next to texts, so none
can arise across an edge, and reading is unambiguous.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from styloweave.llm.ordering import with_neighbours
from styloweave.llm.storage import stored

BEGIN, END = "<s>", "</s>"
CONTROLS = (BEGIN, END, "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[TEXT]")
_ANY = "|".join(map(re.escape, CONTROLS))
_TO_ESCAPE = re.compile(rf"\\|{_ANY}")
_ESCAPED = re.compile(rf"\\(\\|{_ANY})")
_SCAN = re.compile(rf"\\(?:\\|{_ANY})|({_ANY})")
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("", END)}


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the spans that bear loss: the assistant's texts."""
    parts, spans, at = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        before, after = MARKS.get(role) or (f"[ROLE]{escape(role)}[TEXT]", "[/ROLE]")
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        parts += (before, body, after)
        at += len(before) + len(body) + len(after)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    marks = [(m.start(), m.end(), m[1]) for m in _SCAN.finditer(formatted) if m[1]]
    out, i, at = [], 1, len(BEGIN)
    while at < len(formatted):
        start, end, mark = marks[i]
        if mark == "[ROLE]" and start == at:
            (name_end, text_start, _), (close, stop, _) = marks[i + 1], marks[i + 2]
            out.append((unescape(formatted[end:name_end]), unescape(formatted[text_start:close])))
            i, at = i + 3, stop
        elif mark in ("[INST]", "[SYS]") and start == at:
            close, stop, _ = marks[i + 1]
            out.append(("user" if mark == "[INST]" else "system", unescape(formatted[end + 1:close - 1])))
            i, at = i + 2, stop
        else:
            out.append(("assistant", unescape(formatted[at:start])))
            i, at = i + 1, end
    return out


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(leaf, node, distance) of all nodes on the way from each leaf to its root.

    `nodes` has node (unique) and parent (null at a root; an unknown parent counts as null).
    """
    ids = nodes.select("node")
    known = nodes.where("parent IS NOT NULL").select("node", "parent") \
        .join(ids.withColumnRenamed("node", "parent"), "parent", "left_semi").select("node", "parent")
    jump = stored(known.select("node", F.col("parent").alias("up")))
    parents = jump.select(F.col("up").alias("node"))
    paths = stored(ids.join(parents, "node", "left_anti")
                   .select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance")))
    step, nodes_ = 1, ids.count()
    while jump.limit(1).count():
        if step > nodes_:       # no path is longer than the nodes are many
            raise ValueError("some node is its own ancestor")
        further = paths.join(jump, "node").select("leaf", F.col("up").alias("node"),
                                                  (F.col("distance") + step).alias("distance"))
        paths = stored(paths.unionByName(further))
        next_ = jump.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = stored(jump.join(next_, "up").select("node", F.col("top").alias("up")))
        step *= 2
    return paths


def conversations(messages: DataFrame, tree_col: str = "tree", node_col: str = "node", parent_col: str = "parent",
                  role_col: str = "role", text_col: str = "text", score_col: str | None = None,
                  best: int | None = None) -> DataFrame:
    """One row per chosen path: tree, leaf, score, rank, formatted, spans (start, end of loss).

    With `best`, the `best` paths of each tree by summed score (ties: smaller leaf); else all, with
    a null rank. Nodes must be unique and free of cycles. Null roles and texts count as empty, null scores as 0.
    """
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    nodes = messages.select(F.col(tree_col).alias("tree"), F.col(node_col).alias("node"),
                            F.col(parent_col).alias("parent"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                            F.coalesce(F.col(text_col), F.lit("")).alias("text"), score.alias("score"))
    paths = tree_paths(nodes)
    leaves = paths.join(nodes.select("node", "score"), "node").groupBy("leaf").agg(F.sum("score").alias("score")) \
        .join(nodes.select("tree", F.col("node").alias("leaf")), "leaf")
    if best is None:
        leaves = leaves.withColumn("rank", F.lit(None).cast("int"))
    else:
        order = Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf")
        leaves = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    turns = paths.join(leaves.select("leaf"), "leaf").join(nodes.select("node", "role", "text"), "node") \
        .groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("at"), "role", "text")))
                             .alias("turns"))

    def formatted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in f["turns"]]
            yield pd.DataFrame({"leaf": f["leaf"], "formatted": [x for x, _ in done],
                                "spans": [[{"start": a, "end": b} for a, b in s] for _, s in done]})

    texts = turns.mapInPandas(formatted, f"leaf {nodes.schema['node'].dataType.simpleString()}, formatted string, "
                                         "spans array<struct<start:long,end:long>>")
    return leaves.join(texts, "leaf").select("tree", "leaf", "score", "rank", "formatted", "spans")


def threads(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Messages of linear conversations as trees: each turn replies to the one before.

    Turns are ordered by number (null first), then role and text; repeated rows stay. Rows with a
    null conversation form one conversation with a null id.
    """
    rows = table.select(F.col(conv_col).cast("long").alias("tree"), F.col(turn_col).alias("turn"),
                        F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = stored(rows.withColumn("node", F.monotonically_increasing_id())
                  .withColumn("tree_key", F.coalesce(F.col("tree").cast("string"), F.lit(""))))
    keys = rows.select("tree_key", "turn", "role", F.xxhash64("text").alias("text_key"), "node")
    placed = with_neighbours(keys, ["tree_key", "turn", "role", "text_key", "node"], ["tree_key", "node"])
    parents = placed.select("node", F.when(F.col("prev_tree_key") == F.col("tree_key"), F.col("prev_node")).alias("parent"))
    return rows.join(parents, "node").select("tree", "node", "parent", "role", "text")


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for tree, text, spans in zip(f["tree"], f["formatted"], f["spans"]):
            turns = read_turns(text)
            loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
            whole = "".join(f"{role}\n{body}\n" for role, body in turns)
            out.append((tree, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                        hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                           "formatted_chars"])
        yield frame.astype({"conv_id": "Int64"})


def report(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted conversations."""
    return formatted.select("tree", "formatted", "spans").mapInPandas(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
               "formatted_chars long")
