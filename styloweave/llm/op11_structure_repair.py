"""Structure repair of conversations: the cheapest edits that make roles alternate, by a run-length DP.

Rows are kept, given another role, deleted, or empty turns inserted, until the roles' initials read
`(s?(ua)+)?`. The automaton of that pattern has four states; a row is one of few symbols (initial,
fault), and each symbol a 4 x 4 min-plus matrix of costs, with the insertions before the row in it.
Equal consecutive symbols form a run; a run of n takes the binary powers of its matrix, which are
kept per worker. From the end, each run so gets the costs to go at its end; then choices are
unrolled from the start, the least letter among those of least cost. What is put out so far
determines the state, hence that choice is the least audit.

Equal rows are counted before they move. Rows are dealt by ranges of (conversation, turn, role,
text), so a conversation of any size spreads over tasks; a task packs its rows into chunks of
bounded size. A conversation that may cross tasks is joined up by its chunks' matrices: products
within a task's part, then over parts (at most as many as tasks), then within the part again.
Only the digest of such a conversation reads its chunks one after the other, one at a time.

The chunks are stored in the shared folder; a lost executor costs no more than a stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloweave.llm.storage import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1   # costs
INF = 1 << 60
NEXT = (2, 2, 3, 2)         # of states: nothing yet, after s, after u, after a
ROLE = ("user", "user", "assistant", "user")              # what the next turn of each state is
END = (0, 4, 2, 0)          # cost to go with no rows left
OK, BLANK, DUPLICATE, CUT = range(4)
SPACES = " \t\n\x0b\x0c\r"
CHUNK_ROWS, CHUNK_CHARS = 4_096, 1 << 20
CHUNK = ("key string, part int, chunk int, edge boolean, turn array<long>, role array<string>, text array<string>, "
         "copies array<long>, fault array<int>, matrix array<long>")
REPORT = ("key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
TURNS = "key string, place long, role string, text string, edit string"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


# ------------------------------------------------------------------ the program
def initial(role: str) -> int:
    return "sua".find(role[:1]) if role else -1


def options(symbol: tuple[int, int], state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state afterwards) of the row itself."""
    first, fault = symbol
    out = [("D", DELETE, state)]
    if fault in (OK, CUT):
        extra = TRUNCATED if fault == CUT else 0
        if first == 0 and state == 0:
            out.append(("K", KEEP + extra, 1))
        elif first == NEXT[state] - 1:
            out.append(("K", KEEP + extra, NEXT[state]))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


def product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(INF, *(x + b[k][j] for k, x in enumerate(row))) for j in range(4)) for row in a)


def applied(a: tuple, costs: tuple) -> tuple:
    return tuple(min(x + c for x, c in zip(row, costs)) for row in a)


UNIT = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))


def _inserts() -> tuple:
    rows = []
    for state in range(4):
        row, at, cost = [INF] * 4, state, 0
        for _ in range(3):  # a third insertion leads where the first did
            row[at] = min(row[at], cost)
            at, cost = NEXT[at], cost + INSERT
        rows.append(tuple(row))
    return tuple(rows)


@lru_cache(maxsize=None)  # 12 symbols, up to 63 powers each
def power(symbol: tuple[int, int], bit: int) -> tuple:
    """The matrix of 2^bit rows of a symbol."""
    if bit:
        half = power(symbol, bit - 1)
        return product(half, half)
    row = [[INF] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in options(symbol, state):
            row[state][to] = min(row[state][to], cost)
    return product(_inserts(), tuple(map(tuple, row)))


def bits(n: int) -> list[int]:
    return [k for k in range(n.bit_length()) if n >> k & 1]


def runs(symbols: Iterable[tuple[tuple[int, int], int]]) -> list[tuple[tuple[int, int], int]]:
    """Equal consecutive symbols, with counts, as one."""
    return [(s, sum(n for _, n in g)) for s, g in groupby(symbols, key=lambda x: x[0])]


def matrix(symbols: list) -> tuple:
    out = UNIT
    for symbol, n in runs(symbols):
        for k in bits(n):
            out = product(out, power(symbol, k))
    return out


def choices(symbols: list, state: int, after: tuple) -> Iterator[tuple[str, int, int]]:
    """(edits, state before, entry of `symbols`) from `state`, with costs to go `after` the last row.

    A run of deletions is one item. Insertions behind the last row are left to what follows.
    """
    parts = runs(symbols)
    ends = [after]
    for symbol, n in reversed(parts[1:]):
        costs = ends[-1]
        for k in bits(n):
            costs = applied(power(symbol, k), costs)
        ends.append(costs)
    entry = 0
    for (symbol, n), end in zip(parts, reversed(ends)):
        if symbol[1] in (BLANK, DUPLICATE):
            while n:  # a deletion is the least letter, and may always come before an insertion
                yield "D" * symbols[entry][1], state, entry
                n -= symbols[entry][1]
                entry += 1
            continue
        togo = [end]
        for _ in range(n):
            togo.append(applied(power(symbol, 0), togo[-1]))
        while n:
            here, then = togo[n], togo[n - 1]
            edits = [(e, c + then[to], to) for e, c, to in options(symbol, state)]
            edits.append(("I", INSERT + here[NEXT[state]], NEXT[state]))
            edit, _, to = min(x for x in edits if x[1] == here[state])
            yield edit, state, entry
            state = to
            if edit != "I":
                n, entry = n - 1, entry + 1


# ------------------------------------------------------------------ chunks
def symbols_of(roles: list, copies: list, faults: list) -> tuple[list, list]:
    """Symbols with counts, and the row of each; copies of a sound row are duplicates."""
    out, rows = [], []
    for i, (role, n, fault) in enumerate(zip(roles, copies, faults)):
        first = initial(role)
        if fault in (BLANK, DUPLICATE):
            out.append(((first, fault), n))
            rows.append(i)
        else:
            out.append(((first, fault), 1))
            rows.append(i)
            if n > 1:
                out.append(((first, DUPLICATE), n - 1))
                rows.append(i)
    return out, rows


def chunked(rows_of_chunk: int, chars: int):
    """Packs sorted rows of a task into chunks. Only the first and last conversation of a task, and large ones, are edges."""
    names = [c.split()[0] for c in CHUNK.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []     # rows of the current chunk
        state = {"key": None, "chunk": 0, "first": True, "size": 0}
        out: list[tuple] = []

        def close(edge: bool) -> None:
            if held:
                turn, role, text, copies, fault = map(list, zip(*held))
                product_ = [x for row in matrix(symbols_of(role, copies, fault)[0]) for x in row] if edge else []
                out.append((state["key"], part, state["chunk"], edge, turn, role, text, copies, fault, product_))
                held.clear()
                state["chunk"] += 1
                state["size"] = 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()),
                     pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return made

        for block in batches:
            for key, *row in zip(*(c.to_pylist() for c in block.columns)):
                if key != state["key"]:
                    close(state["first"] or state["chunk"] > 0)
                    state.update(first=state["key"] is None, key=key, chunk=0)
                elif len(held) >= rows_of_chunk or state["size"] >= chars:
                    close(True)
                    if sum(len(t) for o in out for t in o[6]) >= 4 * chars:
                        yield batch()
                held.append(tuple(row))
                state["size"] += len(row[2])
            if len(out) >= 2_000:
                yield batch()
        close(True)
        if out:
            yield batch()

    return pack


def _suffixes(frame: pd.DataFrame, order: str, after: tuple) -> pd.DataFrame:
    """Costs to go behind each row of a few, and before the first."""
    frame = frame.sort_values(order)
    held, out = after, []
    for flat in reversed(frame["matrix"].tolist()):
        out.append(list(held))
        held = applied([flat[i:i + 4] for i in range(0, 16, 4)], held)
    return frame.assign(after=out[::-1])


def _joined_up(edges: DataFrame) -> DataFrame:
    """(key, part, chunk, after): costs to go behind each chunk of conversations that may cross tasks."""
    light = edges.select("key", "part", "chunk", "matrix")

    def multiply(frame: pd.DataFrame) -> pd.DataFrame:
        held = UNIT
        for flat in frame.sort_values("chunk")["matrix"]:
            held = product(held, [flat[i:i + 4] for i in range(0, 16, 4)])
        return frame.iloc[:1][["key", "part"]].assign(matrix=[[int(x) for row in held for x in row]])

    parts = light.groupBy("key", "part").applyInPandas(multiply, "key string, part int, matrix array<long>")
    ends = parts.groupBy("key").applyInPandas(
        lambda f: _suffixes(f, "part", END)[["key", "part", "after"]], "key string, part int, after array<long>")
    within = light.join(ends.withColumnRenamed("after", "end"), ["key", "part"]).groupBy("key", "part").applyInPandas(
        lambda f: _suffixes(f, "chunk", tuple(int(x) for x in f["end"].iloc[0]))[["key", "part", "chunk", "after"]],
        "key string, part int, chunk int, after array<long>")
    return within


class Repair:
    """One conversation, chunk by chunk."""

    def __init__(self, with_turns: bool):
        self.counts, self.illegal, self.cost, self.distinct = [0] * 4, 0, 0, 0
        self.low = self.high = self.last_turn = self.last_initial = None
        self.state, self.place, self.audit, self.digest = 0, 0, [], hashlib.sha256()
        self.turns = [] if with_turns else None

    def put(self, role: str, text: str, edit: str) -> None:
        self.digest.update(("\n" * (self.place > 0) + f"{role}:{text}").encode())
        if self.turns is not None:
            self.turns.append((self.place, role, text, edit))
        self.place += 1

    def add(self, turn: list, roles: list, texts: list, copies: list, faults: list, after: tuple) -> None:
        for t, role, n, fault in zip(turn, roles, copies, faults):
            self.counts[fault] += n if fault in (BLANK, DUPLICATE) else 1
            self.counts[DUPLICATE] += n - 1 if fault in (OK, CUT) else 0
            if t is not None and t != self.last_turn:
                self.distinct, self.last_turn = self.distinct + 1, t
                self.low, self.high = t if self.low is None else self.low, t
            first = role[:1]
            self.illegal += n - 1 + (self.last_initial is not None and (self.last_initial, first) not in LEGAL)
            self.last_initial = first
        symbols, rows = symbols_of(roles, copies, faults)
        for edit, state, entry in choices(symbols, self.state, after):
            i, (first, fault) = rows[entry], symbols[entry][0]
            self.audit.append(edit)
            if edit[0] == "D":
                self.cost += DELETE * len(edit)
            elif edit == "I":
                self.insert()
            else:
                self.cost += (REROLE if edit == "R" else KEEP) + (TRUNCATED if fault == CUT else 0)
                self.put(roles[i] if edit == "K" else ROLE[state], texts[i], edit)
                self.state = 1 if edit == "K" and first == 0 else NEXT[state]

    def insert(self) -> None:
        self.cost += INSERT
        self.put(ROLE[self.state], "", "I")
        self.state = NEXT[self.state]

    def finish(self) -> tuple:
        while END[self.state]:
            self.audit.append("I")
            self.insert()
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)
        return (gaps, *(self.counts[k] for k in (BLANK, DUPLICATE, CUT)), self.illegal, self.cost,
                "".join(self.audit), self.digest.hexdigest())


def _finished(chunks: DataFrame, with_turns: bool) -> DataFrame:
    """Reports or turns of conversations whose chunks come one after the other."""
    schema = TURNS if with_turns else REPORT
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * (1 if with_turns else 6), *[pa.string()] * (3 if with_turns else 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, out = None, None, []

        def close() -> None:
            if open_ is not None:
                row = open_.finish()
                out.extend([(now, *t) for t in open_.turns] if with_turns else [(now, *row)])

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return made

        for block in batches:
            for i in range(block.num_rows):
                key, turn, role, text, copies, fault, after = (block.column(c)[i].as_py() for c in range(7))
                if key != now:
                    close()
                    now, open_ = key, Repair(with_turns)
                open_.add(turn, role, text, copies, fault, tuple(after))
                if with_turns and len(open_.turns) > 10_000:
                    out.extend((now, *t) for t in open_.turns)
                    open_.turns.clear()
                if len(out) >= 10_000:
                    yield batch()
        close()
        if out:
            yield batch()

    return chunks.select("key", "turn", "role", "text", "copies", "fault", "after").mapInArrow(run, schema)


def _chunks(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str,
            chunk_rows: int, chunk_chars: int) -> DataFrame:
    conv = F.col(conv_col).cast("string")
    counted = rows.select(
        F.when(conv.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), conv)).alias("key"),
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    ).groupBy("key", "turn", "role", "text").agg(F.count("*").alias("copies")) \
        .withColumn("digest", F.sha2("text", 256))
    repeats = counted.groupBy("key", "role", "digest").agg(
        F.count("*").alias("times"), F.max(F.col("turn").isNull()).alias("from_null"), F.min("turn").alias("least")) \
        .where("times > 1").drop("times")
    seen = F.col("from_null").isNotNull() & F.col("turn").isNotNull() & (F.col("from_null") | (F.col("turn") > F.col("least")))
    body = F.rtrim("text", F.lit(SPACES))
    fault = F.when(body == "", BLANK).when(seen, DUPLICATE) \
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), CUT).otherwise(OK)
    order = ["key", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), "digest"]
    return counted.join(repeats, ["key", "role", "digest"], "left") \
        .withColumn("fault", fault).repartitionByRange(*order).sortWithinPartitions(*order) \
        .select("key", "turn", "role", "text", "copies", "fault") \
        .mapInArrow(chunked(chunk_rows, chunk_chars), CHUNK)


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text", with_turns: bool = False, chunk_rows: int = CHUNK_ROWS,
             chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per conversation with its faults, the cost, the audit and the repaired text's digest.

    With `with_turns`, the repaired turns instead: conv_id, place, role, text, edit (K, R or I);
    conversations of which nothing is left have none. Rows are taken by turn, nulls first; ties by role, the text's first 64
    characters and its digest. A null conversation is one too. Null roles and texts count as one
    space; an empty role has no initial. Equal rows are duplicates of the first of them. An empty
    table gives no rows; other columns are not carried, whatever their names.
    """
    chunks = stored(_chunks(rows, conv_col, turn_col, role_col, text_col, chunk_rows, chunk_chars))
    whole = chunks.where("NOT edge").withColumn("after", F.array(*map(F.lit, END)).cast("array<long>"))
    edges = chunks.where("edge")
    crossing = edges.join(_joined_up(edges), ["key", "part", "chunk"]) \
        .repartition("key").sortWithinPartitions("key", "part", "chunk")
    both = _finished(whole, with_turns).unionByName(_finished(crossing, with_turns))
    kind = rows.schema[conv_col].dataType
    return both.select(F.when(F.col("key") != "0", F.expr("substring(key, 2)")).cast(kind).alias("conv_id"),
                       *both.columns[1:])


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations with faults put in, by the CRC of `conv_id:turn` modulo 20; nulls become one space."""
    def known(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = known("text")
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(known("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1)))
                  .otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def report(rows: DataFrame) -> DataFrame:
    """The report of the damaged conversations, with a row for each conversation of `rows`."""
    found = repaired(damaged(rows))
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
