"""Brute-force versions and awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, text_key string, words int, "
          "hash string, part int, label string, row int, size int, a int, b int, digest string")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def texts():
    base, other = prose(1, 200), prose(2, 300)
    near = base.split()
    near[50] = "changed"
    shared = " ".join(prose(3, 120).split())
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, other), (5, prose(5, 60) + " " + shared + " " + prose(6, 70)),
        (6, prose(7, 40) + "\n" + shared + "\n" + prose(8, 45)), (7, None), (8, ""), (9, " \t\n"), (10, "one"), (11, "one"),
        (12, "a b c d"), (13, "a b c d"), (None, base), (None, None), (4, other), (14, "x" * 5000),
        (15, "Ünï É ß 日本語 …! ok é, <|endoftext|> I'm"), (16, prose(9, 4000)), (17, "same line here\n" * 60),
        (18, "a a a a a a a a"), (19, "### *** $$$ |||")]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, ["en", "fr", None, "xx"][k % 4], "s", None if t is None else len(t), "k", 1, "h", 2, "l", 3, 4, 5, 6, "d")
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def jaccard_classes(rows):
    """Smallest id of each class under 5-word shingle similarity of 0.8 or more, by all pairs."""
    sets, parent = {}, {}
    for i, t in rows:
        words = PLAIN.findall(t or "")
        parent[i] = i
        if words:
            sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in sets:
        for y in sets:
            if x < y and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {i: find(i) for i in parent}


def substring_removals(rows, window=50):
    starts = defaultdict(set)
    for i, t in rows:
        words = PLAIN.findall(t or "")
        for k in range(len(words) - window + 1):
            starts[tuple(words[k:k + window])].add(i)
    out = []
    for i, t in rows:
        words, gone = PLAIN.findall(t or ""), set()
        for k in range(len(words) - window + 1):
            if min(starts[tuple(words[k:k + window])]) < i:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contamination(rows, items, window=13):
    def words(t):
        return ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = defaultdict(set)
    for name, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k:k + window])].add(str(name))
    out = []
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    names |= windows[tuple(w[k:k + n])]
                    hit.update(range(k, k + n))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def base_counts(text):
    words = PLAIN.findall(text or "")
    lines = [x for x in (text or "").split("\n") if PLAIN.search(x)]
    triples = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    times, inside = Counter(triples), set()
    for k, t in enumerate(triples):
        if times[t] > 1:
            inside.update((k, k + 1, k + 2))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w),
            len(lines) - len(set(lines)), len(inside))
