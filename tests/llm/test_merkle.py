"""The Merkle manifest against a brute-force tree."""

import hashlib
import zlib

from styloweave.llm import op12_merkle as merkle
from tests.llm import fixtures as fx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lower(text):
    return text if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(hashes, arity):
    """The root, and the (before, after) of each leaf from the bottom up."""
    steps, below = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        up, held = [], []
        for a in range(0, len(hashes), arity):
            run = hashes[a:a + arity]
            for k in range(len(run)):
                for i in below[a + k]:
                    steps[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h("".join(run)))
            held.append(sum(below[a:a + arity], []))
        hashes, below = up, held
    return hashes[0], steps


def brute(rows, arity=8):
    groups, out = {}, []
    for doc, text, lang, source, n in rows:
        leaf, changed = (h("".join(map(field, (doc, source, lang, n, t)))) for t in (text, lower(text)))
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        groups.setdefault(lang, []).append((doc, leaf, changed if hit else leaf))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = tree([x[1] for x in groups[lang]], arity)
    root, top = tree([trees[x][0] for x in langs], arity) if langs else (None, [])
    for lang, over in zip(langs, top):
        for (doc, leaf, found), way in zip(groups[lang], trees[lang][1]):
            held = found
            for before, after in way + over:
                held = h(before + held + after)
            out.append((doc, leaf, trees[lang][0], root, h("".join(a + b for a, b in way + over)), held, held == root))
    return sorted(out, key=repr)


def result(df, arity=8):
    return sorted(map(tuple, merkle.report(merkle.manifest(df, tampered=merkle.tampering(), arity=arity)).collect()), key=repr)


def awkward():
    rows = [(i, f"Text {i} Ä", "en", "s", i) for i in range(74)]  # runs of 8, a last run of 2, a last run of one above
    rows += [(i, None, "de", None, None) for i in range(65)]      # 65 leaves: a run of one at two levels
    rows += [(7, "SAME", None, "s", 1)] * 9 + [(None, "Null id", None, "s", 1), (None, None, None, None, None)]
    rows += [(900, "", "", "", 0), (901, "X" * 200_000, "\U0001F600", "s", 5), (902, "Z", "￿", "s", 5), (903, "lone", "zz", "-", -1)]
    return rows


def test_awkward_rows(spark):
    rows = awkward()
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    rows = rows[:5] + rows[-6:]
    assert result(spark.createDataFrame(rows, SCHEMA), arity=2) == brute(rows, arity=2)


def test_small_tables(spark):
    for n in (0, 1, 9):
        rows = [(i, "T", "en", "s", 1) for i in range(n)]
        assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    rows = [(i, "T", f"l{i}", "s", 1) for i in range(20)]  # many groups of one leaf
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_clashing_columns_and_the_given_table(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(awkward())],
                               "idx int, " + SCHEMA).selectExpr("*", "1 AS key", "2 AS n", "3 AS hash", "4 AS path", "5 AS tie", "6 AS run")
    assert result(df) == brute(awkward())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = result(docs)
    assert got == brute(rows) and any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_proofs_verify_and_find_changes(spark):
    """A proof holds for its own leaf only."""
    rows = fx.documents(spark).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    kept = merkle.manifest(rows).collect()
    assert all(r["verified"] for r in kept)
    for r, other in zip(kept, kept[1:]):
        held = other["leaf"]
        for step in r["path"]:
            held = h(step["before"] + held + step["after"])
        assert (held == r["root"]) == (other["leaf"] == r["leaf"])
