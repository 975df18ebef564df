"""Packing by the configuration program: rebuilt from its pieces, compared with bounds and best fit."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from styloweave.llm import byte_bpe
from styloweave.llm import op13_config_packing as packing
from tests.llm import fixtures as fx

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "The", " ", "'s", "'", "é", "É,", "<|endoftext|>", "<|", "1", "\n", "!!", "日本", "x're", "  ", "\t", "…", "×", "÷",
         " ", "\n\n", "ß", "-", "\x1c", "\x85", "　", "Ω", "İ"]


def library_ids(texts):
    whole = byte_bpe.encoder(PATH).whole
    return [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_units_equal_the_library():
    r = random.Random(4)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(30))) for _ in range(3000)] + [None, "", " a", "a "] + [t for _, t in fx.texts()]
    coder = byte_bpe.ByteEncoder(PATH)
    assert coder.cuts
    for part in (texts[:900], texts[900:], [t for t in texts if t and "<|" not in t]):
        for cut in (True, False):
            coder.cuts = cut
            ids, at = coder.of(pa.array(part, pa.string()))
            assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(part))] == library_ids(part)


def test_other_rules_are_not_cut():
    assert not byte_bpe.ByteEncoder(public_tokenizers.path("word_bpe_49k.json")).cuts


def test_knapsack_equals_brute_force():
    r = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.sort(r.choice(np.arange(1, 30), 5, replace=False))
        prices = r.random(5)
        best, last = packing.knapsack(prices, lengths, 40)
        exact = [0.0] * 41
        for room in range(1, 41):
            exact[room] = max([exact[room - 1]] + [exact[room - n] + p for n, p in zip(lengths.tolist(), prices) if n <= room])
        assert np.allclose(best, exact)
        for k in range(5):
            config = packing.trace(40, k, last, lengths)
            assert sum(lengths[i] * a for i, a in config) <= 40
            assert np.isclose(sum(prices[i] * a for i, a in config), prices[k] + best[40 - lengths[k]])


@pytest.mark.parametrize("sizes", [[400] * 1000, [600] * 7, [1], [], [1024] * 5, list(range(1, 1025)) * 9,
                                   np.random.default_rng(0).integers(300, 700, 4000).tolist()])
def test_plan(sizes):
    made = packing.plan(Counter(sizes))
    held = Counter()
    for config, copies in made.sequences:
        assert 0 < sum(n * a for n, a in config) <= 1024 and copies > 0
        for n, a in config:
            held[n] += a * copies
    assert held == Counter(sizes)
    best_fit = len(packing.best_fit(sizes, 1024))
    assert made.lower_bound <= made.n_sequences + 1e-6 and made.n_sequences <= best_fit * 1.002 + 1
    assert made.n_sequences <= made.lower_bound * 1.01 + 2


def checked(rows, docs, capacity=1024):
    """The rows rebuild every document, and each sequence is gapless."""
    ids = {}
    for (doc, _), own in zip(docs, library_ids([t for _, t in docs])):
        ids.setdefault(doc, []).append([*own, 2])
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    assert set(got) == set(ids)
    for doc, texts in ids.items():
        exact = []
        for own in texts:
            first = len(own) % capacity or capacity
            starts = [0, *range(first, len(own), capacity)]
            exact += [(k, a, b - a, own[a:b]) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(own)]))]
        assert sorted(got[doc]) == sorted(exact)


def test_pack_rebuilds_documents(spark):
    docs = fx.texts() + [(900, "word " * 5000), (901, None), (902, ""), (None, "a null id"), (903, "b " * 1022), (903, "b " * 1022)]
    df = spark.createDataFrame(docs, "doc_id long, text string") \
        .selectExpr("*", "1 AS length", "2 AS part", "3 AS number", "4 AS first", "5 AS sequence_id")
    plans = []
    rows = packing.pack(df, PATH, with_ids=True, plans=plans).collect()
    checked(rows, docs)
    assert len({r["sequence_id"] for r in rows}) == plans[0].n_sequences
    assert packing.pack(df.where("false"), PATH).collect() == []


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    rows = packing.pack(df, PATH, with_ids=True).collect()
    checked(rows, [(r["doc_id"], r["text"]) for r in df.collect()])
    volume = -(-sum(r["length"] for r in rows) // 1024)
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * volume + 1
