"""Structure repair against a brute-force search of all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

from styloweave.llm import op11_structure_repair as structure

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = BLANKS.sub("", text)
        out.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repair(rows):
    """Least (cost, audit) and the repaired turns, by trying every edit."""
    kinds = faults(rows)

    @lru_cache(maxsize=None)
    def go(i, made, first_s, inserted):
        # turns made so far, whether the first is s, insertions since the last row
        place = made - first_s
        want = "user" if place % 2 == 0 else "assistant"
        found = []
        if i == len(rows) and place % 2 == 0 and (place or not first_s):
            found.append((0, "", ()))
        if inserted < 4:
            c, a, t = go(i, made + 1, first_s, inserted + 1)
            found.append((c + 2, "I" + a, ((want, ""),) + t))
        if i < len(rows):
            (role, text), kind = rows[i], kinds[i]
            c, a, t = go(i + 1, made, first_s, 0)
            found.append((c + 3, "D" + a, t))
            if kind not in ("b", "d"):
                more = kind == "t"
                if made == 0 and role[:1] == "s":
                    c, a, t = go(i + 1, 1, True, 0)
                    found.append((c + more, "K" + a, ((role, text),) + t))
                c, a, t = go(i + 1, made + 1, first_s, 0)
                if role[:1] == want[0]:
                    found.append((c + more, "K" + a, ((role, text),) + t))
                found.append((c + 2 + more, "R" + a, ((want, text),) + t))
        return min(found) if found else (10**9, "~", ())

    return go(0, 0, False, 0)


def brute(rows, damage):
    convs = {}
    for conv, turn, role, text in rows:
        held = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held.extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = []
    for conv, held in convs.items():
        if not held and not damage:
            continue
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))
        pairs = [r[1:] for r in held]
        kinds, turns = faults(pairs), [r[0] for r in held if r[0] is not None]
        cost, audit, body = repair(pairs)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("b"), kinds.count("d"),
                    kinds.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in body).encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows(seed, convs, longest=9):
    r, rows = random.Random(seed), []
    for conv in range(convs):
        for turn in range(r.randrange(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire", "s"])
            text = r.choice(["Hi.", "Hi.", "Yes!", "no end", " \n", "", None, f"own {turn}?", f"cut {turn} \t", "é。", "Long " * 40 + "."])
            rows.append((conv, r.choice([turn, turn, turn, turn * 3, None, -2]), role, text))
    return rows + rows[: convs // 3]  # repeated rows


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_repair_equals_brute_force(spark):
    rows = random_rows(1, 150) + [(None, 1, "user", "Null."), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(structure.repaired(df)) == brute(rows, False)
    assert got(structure.report(df.selectExpr("*", "1 AS key", "2 AS id", "3 AS copy", "4 AS fault", "5 AS digest"))) == brute(rows, True)
    assert got(structure.repaired(df.where("false"))) == [] and got(structure.report(df.where("false"))) == []


def test_long_conversations_cross_chunks_and_tasks(spark):
    rows = random_rows(2, 4, 60) + random_rows(3, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    exact = brute(rows, False)
    for chunk_rows, chars in ((1, 1 << 20), (3, 1 << 20), (4_096, 30)):
        assert got(structure.repaired(df, chunk_rows=chunk_rows, chunk_chars=chars)) == exact


def test_hot_rows_are_counted(spark):
    """Copies are one row with a number; a run of them takes powers of a matrix."""
    df = spark.range(30_000).selectExpr("7L AS conv_id", "1L AS turn", "'user' AS role", "'Again.' AS text")
    r, = structure.repaired(df).collect()
    assert (r["duplicate"], r["illegal"], r["cost"], r["audit"]) == (29_999, 29_999, 3 * 29_999 + 2, "K" + "D" * 29_999 + "I")
    df = spark.range(3000).selectExpr("7L AS conv_id", "id AS turn", "'user' AS role", "concat(id, '.') AS text")
    r, = structure.repaired(df, chunk_rows=64).collect()
    assert r["cost"] == 2 * 1500 and r["audit"] == "KR" * 1500


def test_turns_are_the_text_of_the_digest(spark):
    rows = random_rows(5, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    body = {}
    for t in structure.repaired(df, with_turns=True).orderBy("conv_id", "place").collect():
        body.setdefault(t["conv_id"], []).append(f"{t['role']}:{t['text']}")
    for r in structure.repaired(df).collect():
        assert hashlib.sha256("\n".join(body.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_powers_equal_single_steps():
    for first in range(-1, 3):
        for fault in range(4):
            costs, symbol = structure.END, (first, fault)
            for n in range(1, 40):
                costs = structure.applied(structure.power(symbol, 0), costs)
                fast = structure.END
                for k in structure.bits(n):
                    fast = structure.applied(structure.power(symbol, k), fast)
                assert fast == costs == structure.applied(structure.matrix([(symbol, n)]), structure.END)
