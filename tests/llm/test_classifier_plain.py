"""The quality classifier against a plain version: text by text statistics, all rows in one matrix, a full fit."""

import re
import zlib

import numpy as np
import pytest

from styloweave.llm import op08_classifier as classifier
from tests.llm import fixtures as fx

SPACES = " \t\n\v\f\r"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS, SYMBOLS = ".,;:!?'\"()-", "#*$%&|<>"


def statistics(text):
    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    lines = [x for x in raw.split(b"\n") if x]

    def share(kind):
        return sum(b < 128 and chr(b) in kind for b in raw) / max(len(raw), 1)

    def mean(values):
        values = list(values)
        return sum(values) / len(values) if values else 0.0

    def repeats(items):
        return (len(items) - len(set(items))) / max(len(items), 1)

    def has(byte, kind):
        return byte < 128 and chr(byte) in kind

    lengths = [len(w) for w in words]
    average = mean(lengths)
    return [np.log1p(len(words)), np.log1p(len(raw)), average, max(mean(x * x for x in lengths) - average**2, 0) ** 0.5,
            share(LOWER), share(UPPER), share("0123456789"), share(MARKS), share(SYMBOLS), share(SPACES), share("\n"),
            sum(b >= 128 for b in raw) / max(len(raw), 1),
            repeats(words), repeats([tuple(words[i:i + 3]) for i in range(len(words) - 2)]), repeats(lines),
            mean(n <= 3 for n in lengths), mean(n >= 12 for n in lengths), mean(has(w[-1], SYMBOLS) for w in words),
            mean(has(w[0], UPPER) for w in words), mean(has(w[0], UPPER) and has(w[min(1, len(w) - 1)], UPPER) for w in words),
            mean(has(w[-1], MARKS) for w in words), np.log1p(len(lines)), mean(len(w) == 1 and has(w[0], SYMBOLS) for w in words)]


def pooled(points):
    """Non-decreasing least squares: the largest mean over starts of the smallest over ends."""
    x, y, w = (np.array(c, float) for c in zip(*points))
    fit = [max(min(np.average(y[a:b + 1], weights=w[a:b + 1]) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
    knots, values = [], []
    for v in dict.fromkeys(np.round(fit, 12)):
        own = np.isclose(fit, v, atol=1e-11)
        knots.append(np.average(x[own], weights=w[own]))
        values.append(np.average(y[own], weights=w[own]))
    return knots, values


def plain(docs, labels, features=classifier.FEATURES, ridge=classifier.RIDGE, width=classifier.WIDTH):
    stats = {i: np.array(statistics(t)) for i, t in docs}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in stats}
    known = [(i, y) for i, y in labels if y in (0, 1) and i in stats and fold[i]]
    x, y, f = np.array([stats[i] for i, _ in known]), np.array([q for _, q in known], float), np.array([fold[i] for i, _ in known])
    rng = np.random.default_rng(8)
    deviation = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    weights = rng.normal(size=(x.shape[1], features)) / (width * np.sqrt(x.shape[1]))
    phase = rng.uniform(0, 2 * np.pi, features)

    def kernel(s):
        z = np.cos(np.clip((s - x.mean(0)) / deviation, -6, 6) @ weights + phase) * np.sqrt(2 / features)
        return np.hstack([z, np.ones((len(z), 1))])

    def ridged(rows):
        z, penalty = kernel(x[rows]), np.eye(features + 1) * ridge * rows.sum()
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(z.T @ z + penalty, z.T @ y[rows])

    def place(raw):
        return (raw + 0.5) / 2 * classifier.BINS

    bins = {}
    for k in set(f):
        held = kernel(x[f == k]) @ ridged(f != k)
        for at, q in zip(np.clip(np.round(place(held)), 0, classifier.BINS).astype(int), y[f == k]):
            n, total = bins.get(at, (0, 0.0))
            bins[at] = (n + 1, total + q)
    knots, values = pooled([(at, total / n, n) for at, (n, total) in sorted(bins.items())])
    final = ridged(np.ones(len(y), bool))
    return {i: float(np.clip(np.interp(place((kernel(s[None]) @ final)[0]), knots, values), 0, 1)) for i, s in stats.items()}


def test_statistics_equal_plain_counts():
    import pyarrow as pa
    texts = [t for _, t in fx.texts()] + ["", None, "A b#\nA b#\n\nÉ long-word-over-twelve 12 *", " \n"]
    assert np.allclose(classifier.statistics(pa.array(texts, pa.string())), [statistics(t) for t in texts])


def test_scores_equal_the_plain_fit(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows, marks = [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["doc_id"], r["quality"]) for r in labels.collect()]
    exact = plain(rows, marks)
    got = {r["doc_id"]: r for r in classifier.quality_scores(docs.repartition(3), labels).collect()}
    assert set(got) == set(exact)
    for i, score in exact.items():
        assert got[i]["score"] == pytest.approx(score, abs=1e-5)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)
