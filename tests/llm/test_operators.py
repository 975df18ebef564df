"""Each operator against a brute-force version, on awkward rows and on the small tables."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from styloweave.llm import bpe, sharing
from styloweave.llm import op01_html as pages
from styloweave.llm import op02_token_counts as counts
from styloweave.llm import op03_divergence as divergence
from styloweave.llm import op04_near_dedup as near
from styloweave.llm import op05_substring_dedup as substrings
from styloweave.llm import op06_masked_lm as masked
from styloweave.llm import op07_chat as chat
from styloweave.llm import op08_classifier as classifier
from styloweave.llm import op09_packing as packing
from styloweave.llm import op10_decontamination as decontamination
from styloweave.llm.components import components
from styloweave.llm.ordering import with_neighbours
from styloweave.llm.words import split, windows
from tests.llm import fixtures as fx

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ITEMS = [(0, fx.prose(2, 300)[:200]), (1, "a b c d"), (2, None), (None, "w1 w2"), (3, ""), (2, "ONE")]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def library_ids(texts):
    e = bpe.encoder(TOKENIZER).whole.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [x.ids for x in e]


# ------------------------------------------------------------------ words and tokens
def test_words_and_windows():
    column = pa.array(["a bb  a bb", None, "", "\x0bx\ty", "é é é"])
    words = split(column)
    assert [words.texts(np.arange(len(words.start)))[i] for i in range(4)] == ["a", "bb", "a", "bb"]
    assert words.counts().tolist() == [4, 0, 0, 2, 3]
    h = words.hashes()
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    two = windows(h, 2)
    assert two[0] == two[2] and two[0] != two[1]
    values = np.random.default_rng(0).integers(0, 3, 300).astype(np.uint64)
    for n in (1, 3, 7, 20, 50):
        w = windows(values, n)
        exact = [tuple(values[i:i + n]) for i in range(len(w))]
        assert len(set(w.tolist())) == len(set(exact)) and len(w) == 301 - n


def test_word_encoder_equals_the_library():
    r = random.Random(4)
    parts = ["a", "The", " ", "'s", "é", "é", "…", "É,", "<|endoftext|>", "<|", "1", "\n", "!!", "日本", "x're", " ", "İ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(400)] + [t for _, t in fx.texts()]
    coder = bpe.WordEncoder(TOKENIZER)
    for _ in range(2):  # from the library and from what is kept
        for part in (texts[:150], texts[150:], [t for t in texts if t and "<|" not in t]):
            units = bpe.units(pa.array(part, pa.string()))
            ids, at = coder.rows(units)
            assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(part))] == library_ids(part)
            assert coder.counts(units).tolist() == [len(x) for x in library_ids(part)]


def test_splicing_equals_the_whole():
    coder, r = bpe.encoder(TOKENIZER).whole, random.Random(5)
    for k in range(80):
        text = "".join(r.choice(["a", "the ", " ", "'s", "é", "日本", "<|endoftext|>", "12", "\n"]) for _ in range(150))
        whole = coder.encode(text, add_special_tokens=False).ids
        assert counts.encode_spliced(coder, text, 10 + k, 2) == whole
    assert counts.encode_spliced(coder, "x" * 300, 20, 2) == coder.encode("x" * 300, add_special_tokens=False).ids


def test_token_counts(spark):
    got = rows_of(counts.token_counts(fx.documents(spark), TOKENIZER, huge=900, chunk=200))
    want = [(i, len((t or "").encode()), n := len(x), n > 2048) for (i, t), x in
            zip(fx.texts(), library_ids([t for _, t in fx.texts()]))]
    assert got == sorted(want, key=repr)


# ------------------------------------------------------------------ html
def test_longest_common_lines():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randrange(5) for _ in range(r.randrange(13))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        kept = [x for x, k in zip(a, pages.common_lines(a, b)) if k]
        there = iter(b)
        assert len(kept) == table[-1][-1] and all(x in there for x in kept)


def test_differencing_decides_where_a_page_marks_no_main_part(spark):
    page = "<html><body><p>Site name</p><p>About us</p><p>{}</p><p>{}</p><p>All rights</p></body></html>"
    rows = [(1, "http://h/a/1", page.format("first story", "its end")), (2, "http://h/a/2", page.format("second", "more")),
            (3, "http://h/zz", page.format("far", "away").replace("About us", "Contact")), (4, "http://other/a/1", "<p>alone</p>"),
            (5, "http://copy/1", "<p>twin</p>"), (6, "http://copy/2", "<p>twin</p>"), (7, None, None), (None, "http://h/a/3", ""),
            (8, "http://x/", "<nav>menu</nav><article><header><h1>T&eacute;</h1></header><p>a<b>b</b>&nbsp; c<br>d"
                             "<p class=advert-box>buy<p>e</p><h2 class='related-posts'>more<div class='share'>tweet</div><section id=comments><p>first!</p></section></article><aside>s</aside>"),
            (8, "http://x/", "<main><form>f</form><div role='alert'>!</div><p>in main</p><script>x='</p>'</script></main><p>out</p>")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, text string, lines int")
    got = rows_of(pages.extract(df))
    texts = {(1, "first story its end"), (2, "second more"), (3, "Contact far away"), (4, "alone"), (5, "twin"), (6, "twin"),
             (7, ""), (None, ""), (8, "Té ab c d e"), (8, "in main")}
    assert {(g[0], g[2]) for g in got} == texts and len(got) == 10 and all(g[3] == len(g[2]) for g in got)


def test_differencing_decides_around_articles(spark):
    inside = "<nav>menu</nav><main><h1>{0}</h1><p>lead of {0}</p><p>Read more</p><article>body of {0}</article></main><footer>f</footer>"
    around = "<div>Site</div><h1>{0}</h1><article>text of {0}</article><div>Imprint</div>"
    rows = [(1, "http://m/1", inside.format("one")), (2, "http://m/2", inside.format("two")),
            (3, "http://o/1", around.format("three")), (4, "http://o/2", around.format("four")),
            (5, "http://c/1", inside.format("twin")), (6, "http://c/2", inside.format("twin")),
            (7, "http://cards/1", "<main><div>All of the story</div><article>teaser</article></main>"),
            (8, "http://u/1", "<div>Other</div><article>lone</article>"), (9, "http://u/2", "<div>Unlike</div><article>pair</article>")]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    twin = "twin lead of twin Read more body of twin"
    assert got == {1: "one lead of one body of one", 2: "two lead of two body of two", 3: "three text of three", 4: "four text of four",
                   5: twin, 6: twin, 7: "All of the story teaser", 8: "lone", 9: "pair"}


def test_article_text_is_not_cut():
    def text(page, other=None):
        return pages.main_text(pages.page_blocks(page), other and pages.outline(pages.page_blocks(other)))

    for icon in ('<svg class="icon"/>', "<math />", '<svg title="a>b"/>', "<svg><svg/><path/></svg>", "<svg>x</svg>"):
        assert text(f"<article><h1>T</h1>{icon}<p>All of the article.</p></article>") == "T All of the article."
    for mark in ('id="discussion"', 'id="recommendations"', 'id="consent-and-ethics"', 'class="discussion"', 'class="recommended"'):
        assert text(f"<article><p>a</p><section {mark}><p>b</p></section></article>") == "a b"
    assert text('<article><h2 id="search">Search</h2><h2 id="comments">Comments</h2><p>a</p></article>') == "Search Comments a"
    page = '<nav>n</nav><article><p>{}</p><div id="promo-box">Get the app</div></article>'
    assert text(page.format("a"), page.format("b")) == "a" and text(page.format("a"), page.format("a")) == "a Get the app"
    assert text('<article><p>a</p><div class="sidebar">s</div><div role="search">s</div></article>') == "a"


def test_pages_of_the_table(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.read.parquet(f"{folder}/pages.parquet")).collect()}
    for r in pq.read_table(f"{folder}/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>|<br>", article))
        assert got[r["page_id"]] == " ".join(p for p in parts if p)


def test_neighbours_meet_across_ranges(spark):
    keys = spark.createDataFrame([(f"h{i % 2}", i) for i in range(200)], "host string, id long").repartition(7)
    got = rows_of(with_neighbours(keys, ["host", "id"], ["host", "id"]))
    order = sorted((f"h{i % 2}", i) for i in range(200))
    want = [(*k, *(p or (None, None)), *(n or (None, None))) for p, k, n in zip([None, *order], order, [*order[1:], None])]
    assert got == sorted(want, key=repr)


# ------------------------------------------------------------------ rules
def test_base_counts(spark):
    got = [tuple(r)[:6] for r in divergence.judge(fx.documents(spark)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()]
    assert sorted(got, key=repr) == sorted([(i, *fx.base_counts(t)) for i, t in fx.texts()], key=repr)


def test_divergence_finds_odd_texts(spark):
    good = "the cat and the dog of that house, with a bird for it. " * 2
    rows = [(i, " ".join(f"{good} {fx.prose(i * 10 + k, 9)}" for k in range(6))) for i in range(20)]
    rows.append((99, " ".join(f"###{i}***" for i in range(200))))
    docs = fx.documents(spark, rows).withColumn("lang", divergence.F.lit("en"))
    got = {r["doc_id"]: r for r in divergence.judge(docs).collect()}
    assert not got[99]["kept"] and not got[99]["base_failed"]
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in range(20)) and got[99]["char_distance"] > 0.28
    p, q = [3.0, 1.0, 0.0], [1.0, 1.0, 2.0]
    F = divergence.F
    d = spark.range(1).select(divergence.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    a, b = np.array(p) / 4, np.array(q) / 4
    m = (a + b) / 2
    want = np.sqrt(sum(x * np.log2(x / y) / 2 for u in (a, b) for x, y in zip(u, m) if x))
    assert abs(d - want) < 1e-12


# ------------------------------------------------------------------ duplicates
def test_shared_pairs_across_tasks(spark):
    r = random.Random(2)
    pairs = [(r.randrange(30), r.randrange(40)) for _ in range(300)] + [(7, d) for d in range(100)]
    docs = {}
    for h, d in pairs:
        docs.setdefault(h, set()).add(d)
    df = spark.createDataFrame(pairs, "h long, d long").repartition(5)

    def hashes_of(batch):
        yield batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy()

    for smaller in (False, True):
        got = {tuple(x) for x in sharing.shared_pairs(df, hashes_of, smaller).collect()}
        assert got == {(d, h) for h, ds in docs.items() for d in ds if (d > min(ds) if smaller else len(ds) > 1)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 80), (200, 200), (300, 301), (301, 302), (302, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 80 for i in (80, 90, 100)} | {i: 300 for i in (300, 301, 302)}


def test_prob_min_hash_estimates_weighted_similarity():
    r = np.random.default_rng(3)
    ids = r.integers(1, 2**43, 120).astype(np.uint64)
    wa, wb = r.integers(1, 5, 120).astype(float), r.integers(1, 5, 120).astype(float)
    wa[:30], wb[90:] = 0, 0
    row = np.concatenate([np.zeros(90, int), np.ones(90, int)])
    k = 4000
    s = near.prob_min_hash(row, np.concatenate([ids[30:], ids[:90]]), np.concatenate([wa[30:], wb[:90]]), 2, k)
    both = range(30, 90)
    want = sum(1 / sum(max(wa[j] / wa[i], wb[j] / wb[i]) for j in range(120)) for i in both)
    assert abs((s[0] == s[1]).mean() - want) < 5 * np.sqrt(want * (1 - want) / k)


def test_near_classes(spark):
    rows = fx.texts()
    r = random.Random(9)
    for g in range(4):  # chains of copies that drift
        words = fx.prose(100 + g, 150).split()
        for k in range(12):
            rows.append((1000 + 20 * g + k, " ".join(words)))
            words[r.randrange(150)] = f"v{r.randrange(10**6)}"
    got = [tuple(x)[:2] for x in near.near_classes(fx.documents(spark, rows)).collect()]
    classes = fx.jaccard_classes([(i, t) for i, t in rows if i is not None])
    assert sorted(got, key=repr) == sorted([(i, None if i is None else classes[i]) for i, _ in rows], key=repr)
    kept = sorted((x["doc_id"] for x in near.deduplicate(fx.documents(spark, rows)).collect()), key=repr)
    assert kept == sorted([*set(classes.values()), None, None], key=repr)


def test_near_classes_of_texts_that_repeat_passages(spark):
    rows = []
    for k in range(24):  # similar sets; a quarter of the shared shingles 200 times in one text
        words = fx.prose(500 + k, 10).split()[:1] + [f"p{k}x{i}" for i in range(300)]
        rows.append((2 * k, " ".join(words + [f"a{k}x{i}" for i in range(20)])))
        rows.append((2 * k + 1, " ".join(words[:75] * 200 + words + [f"b{k}x{i}" for i in range(20)])))
    classes = fx.jaccard_classes(rows)
    assert all(classes[2 * k + 1] == 2 * k for k in range(24))
    got = {r["doc_id"]: r["class_id"] for r in near.near_classes(fx.documents(spark, rows)).collect()}
    assert got == classes


def test_difference_cover():
    assert substrings.is_cover(substrings.COVER, substrings.PERIOD) and not substrings.is_cover((0, 1), 7)


def test_substring_removals(spark):
    rows = [(i, t) for i, t in fx.texts() if i is not None]
    rows += [(50 + k, fx.prose(60 + k, 30 + k) + " " + " ".join(fx.prose(3, 120).split()[k:k + 49 + k % 3])) for k in range(20)]
    got = rows_of(substrings.report(substrings.removals(fx.documents(spark, rows))))
    assert got == sorted(fx.substring_removals(rows), key=repr)
    docs = fx.documents(spark)
    cut = {r["doc_id"]: r for r in substrings.deduplicate(docs).collect() if r["doc_id"] is not None}
    assert 2 not in cut and cut[7]["text"] is None and cut[8]["text"] == ""
    assert cut[6]["text"] == fx.texts()[5][1].replace(fx.prose(3, 120) + "\n", "")
    assert substrings.deduplicate(docs).columns == docs.columns
    nulls = substrings.report(substrings.removals(fx.documents(spark, [(None, fx.prose(1, 80)), (1, fx.prose(1, 80))])))
    assert {r["n_removed"] for r in nulls.collect()} == {0}


# ------------------------------------------------------------------ language model
def test_masked_model(spark):
    def sentence(k):
        return " ".join(random.Random(k).choice([["red", "cat", "sat"], ["big", "dog", "ran"]])[j % 3] for j in range(60))
    rows = [(i, sentence(i)) for i in range(60)] + fx.texts()
    docs = fx.documents(spark, rows)
    got = masked.pseudo_likelihood(docs, batch=256).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"]) for r in got) == sorted(
        (i is None, i or 0, len(fx.PLAIN.findall(t or ""))) for i, t in rows)
    assert all(r["log_prob"] < 0 if r["n_words"] else r["log_prob"] == 0 for r in got)
    words = masked.vocabulary(docs.select("doc_id", "text"))
    network = masked.trained(docs.select("doc_id", "text"), words, batch=64)
    text = split(pa.array([sentence(3), "red cat"]))
    ids = words.of(text.hashes())
    around = masked.contexts(ids, text)
    quick = network.log_probabilities(ids, around)
    p = network.p
    for i in range(len(ids)):  # one word at a time, each whole softmax
        row = text.row[i]
        h = p["bias"] + sum(p["embed"][k][ids[i + s] if 0 <= i + s < len(ids) and text.row[i + s] == row else masked.PAD]
                            for k, s in enumerate(masked.CONTEXT))
        h = np.tanh(h)
        g = np.exp(h @ p["group"] + p["group_bias"])
        k, j = divmod(int(ids[i]), masked.GROUP_SIZE)
        w = np.exp(h @ p["word"][k] + p["word_bias"][k])
        assert abs(quick[i] - np.log(g[k] / g.sum()) - np.log(w[j] / w.sum())) < 1e-3
    start = masked.Network(words.frequency).log_probabilities(ids, around).mean()
    assert quick.mean() > start


def test_words_outside_the_vocabulary_count_by_their_share(spark):
    common = " ".join(f"c{i % 960}" for i in range(960 * 60))
    rare = {f"r{i}": 1 + 7 * (i % 5) for i in range(300)}
    rows = [(0, common), (1, " ".join(w for w, n in rare.items() for _ in range(n - 1)))]
    rows += [(10 + i, w) for i, w in enumerate(rare)] + [(10, "r0"), (None, "r1 r1"), (9, None)]
    docs = fx.documents(spark, rows).repartition(3)
    got = masked.pseudo_likelihood(docs, batch=256).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["log_prob"] for r in got}
    buckets = {}
    hashes = dict(zip(rare, split(pa.array([" ".join(rare)])).hashes()))
    for i, w in enumerate(rare):
        buckets.setdefault(int(hashes[w] % np.uint64(masked.BUCKETS)), []).append((by[10 + i], rare[w] + (w in ("r0", "r1")) * (1 if w == "r0" else 2)))
    pairs = [(a, b) for found in buckets.values() for a in found for b in found if a[1] > b[1]]
    assert len(pairs) > 100
    for (p, n), (q, m) in pairs:  # one context, one bucket: only the counts differ
        assert abs((p - q) - np.log(n / m)) < 1e-3


def test_vocabulary_grows_with_the_distinct_words():
    sizes = [masked.buckets_for(n) for n in (0, masked.FEW, masked.FEW + 1, 4 * masked.FEW + 1, 400 * masked.FEW)]
    assert sizes == [64, 64, 128, 256, 2048]
    words = masked.Vocabulary(np.arange(100, dtype=np.uint64), np.ones(100), np.ones(256))
    network = masked.Network(words.frequency)
    ids, around = np.array([0, words.listed, words.pad - 1]), np.full((3, 4), words.pad)
    assert np.isfinite(network.log_probabilities(ids, around)).all() and len(network.p["group_bias"]) == 128


def test_training_follows_the_gradient():
    network = masked.Network(np.ones(masked.PAD))
    r = np.random.default_rng(0)
    ids, around = r.integers(0, 40, 500), r.integers(0, 40, (500, 4))
    before = network.log_probabilities(ids, around).mean()
    for _ in range(20):
        network.train(ids, around, 0.05)
    assert network.log_probabilities(ids, around).mean() > before + 0.5


# ------------------------------------------------------------------ chat
def test_template_round_trip():
    r = random.Random(3)
    parts = ["\\", *chat.CONTROLS, "[", "<", "/", "a", " ", "]", "s>"]
    for _ in range(2000):
        turns = [(r.choice(["user", "assistant", "system", "tool", "", "[ROLE]", "\\"]),
                  "".join(r.choice(parts) for _ in range(r.randrange(9)))) for _ in range(r.randrange(6))]
        text, spans = chat.format_turns(turns)
        assert chat.read_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]


def test_reply_trees(spark):
    r = random.Random(6)
    nodes = []
    for tree in range(3):
        for k in range(25):
            parent = None if k == 0 else tree * 100 + r.randrange(k)
            nodes.append((tree, tree * 100 + k, parent, r.choice(["user", "assistant"]), f"t{k}", float(r.randrange(5))))
    nodes += [(7, 700 + k, 699 + k if k else None, "user", str(k), 1.0) for k in range(70)]
    df = spark.createDataFrame([(*n, "x") for n in nodes],
                               "tree long, node long, parent long, role string, text string, score double, leaf string")
    by = {n[1]: n for n in nodes}
    leaves = set(by) - {n[2] for n in nodes}
    want = []
    for leaf in leaves:
        path = [leaf]
        while by[path[-1]][2] is not None:
            path.append(by[path[-1]][2])
        want.append((by[leaf][0], leaf, sum(by[n][5] for n in path), chat.format_turns([by[n][3:5] for n in path[::-1]])[0]))
    got = [(x["tree"], x["leaf"], x["score"], x["formatted"]) for x in chat.conversations(df, score_col="score").collect()]
    assert sorted(got) == sorted(want)
    best = {(x["tree"], x["rank"]): x["leaf"] for x in chat.conversations(df, score_col="score", best=2).collect()}
    for tree in (0, 1, 2, 7):
        order = sorted((-s, leaf) for t, leaf, s, _ in want if t == tree)[:2]
        assert [best[tree, i + 1] for i in range(len(order))] == [leaf for _, leaf in order]


def test_threads(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 3, None, "gap"), (2, 1, "user", "b"), (2, 1, "user", "b"),
            (2, 0, "system", ""), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, None, "user", "n")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, node int")
    got = {x["conv_id"]: x for x in chat.report(chat.conversations(chat.threads(df))).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda x: (repr(x[0]), -1 if x[1] is None else x[1])):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        whole = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        assert tuple(got[c])[1:5] == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                                      hashlib.sha256(loss.encode()).hexdigest())


# ------------------------------------------------------------------ classifier
def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in classifier.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
               and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    held = [(got[i]["score"], q) for i, q in marks.items() if got[i]["held_out"]]
    good = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x == 1 and y == 0]
    assert np.mean(good) > 0.9


def test_isotonic():
    x, y = classifier.isotonic(np.arange(6.0), np.array([0.1, 0.3, 0.2, 0.2, 0.9, 0.8]), np.array([1.0, 1, 1, 2, 1, 1]))
    assert (np.diff(y) > 0).all() and np.allclose(y, [0.1, 0.9 / 4, 0.85])


# ------------------------------------------------------------------ packing
def test_packing(spark):
    rows = fx.texts()
    df = packing.pack(fx.documents(spark, rows).repartition(3), TOKENIZER, capacity=64, with_ids=True)
    got, ids = df.collect(), dict(zip([repr(x) for x in rows], library_ids([t for _, t in rows])))
    sequences, docs = {}, {}
    for g in got:
        sequences.setdefault(g["sequence_id"], []).append(g)
        docs.setdefault(g["doc_id"], []).append(g)
        assert g["ids_crc32"] == zlib.crc32(np.array(g["ids"], "<u4").tobytes()) and g["length"] == len(g["ids"])
    for s in sequences.values():
        at = 0
        for g in sorted(s, key=lambda g: g["offset"]):
            assert g["offset"] == at
            at += g["length"]
        assert at <= 64 and at & (at - 1) == 0  # full, or a power of two
    single = [(i, t) for i, t in rows if i is not None and i != 4]
    for i, t in single:
        parts = sorted(docs[i], key=lambda g: g["start"])
        assert sum((list(g["ids"]) for g in parts), []) == [*ids[repr((i, t))], 1]
        assert {g["doc_tokens"] for g in parts} == {len(ids[repr((i, t))]) + 1}
    assert all(sum(n for _, n in packing.pieces(k)) == k for k in range(0, 5000, 37))


# ------------------------------------------------------------------ decontamination
@pytest.mark.parametrize("block_words", [200_000, 20])
def test_decontamination(spark, block_words):
    found = decontamination.matches(fx.documents(spark), bench(spark), block_words=block_words)
    items = [("" if i is None else i, t) for i, t in ITEMS]
    assert rows_of(decontamination.report(found)) == sorted(fx.contamination(fx.texts(), items), key=repr)


def test_automaton_on_small_alphabets():
    r = random.Random(8)
    for _ in range(200):
        items = [(str(k), [r.randrange(3) for _ in range(r.randrange(1, 14))]) for k in range(4)]
        text, n = [r.randrange(3) for _ in range(40)], r.randrange(2, 6)
        spans, names = [], set()
        decontamination.Automaton(items, n).stream(text, 0, spans, names)
        hit, found = set(), set()
        for name, w in items:
            for k in range(max(1, len(w) - n + 1)):
                part = w[k:k + n]
                for i in range(len(text) - len(part) + 1):
                    if text[i:i + len(part)] == part:
                        found.add(name)
                        hit.update(range(i, i + len(part)))
        assert names == found and {i for s, e in spans for i in range(s, e)} == hit


def test_clean_cuts_long_spans(spark):
    item = fx.prose(11, 30)
    rows = [(1, fx.prose(12, 900) + " " + item + " tail end"), (2, item), (3, fx.prose(13, 50)), (4, None)]
    out = {r["doc_id"]: r["text"] for r in decontamination.clean(fx.documents(spark, rows), bench(spark, [(0, item)]),
                                                                   max_span=20).collect()}
    assert set(out) == {1, 3, 4} and item not in out[1] and out[1].endswith("  tail end") and out[4] is None


# ------------------------------------------------------------------ empty tables
def test_empty_tables(spark):
    docs = fx.documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (counts.token_counts(docs, TOKENIZER), divergence.judge(docs), near.near_classes(docs),
               substrings.removals(docs), masked.pseudo_likelihood(docs), classifier.quality_scores(docs, labels),
               packing.pack(docs, TOKENIZER), decontamination.matches(docs, bench(spark)),
               decontamination.matches(docs, bench(spark, [])), near.deduplicate(docs), substrings.deduplicate(docs),
               pages.extract(spark.createDataFrame([], "page_id long, url string, html string")),
               chat.conversations(chat.threads(spark.createDataFrame(
                   [], "conv_id long, turn long, role string, text string")))):
        assert df.count() == 0
    some = classifier.quality_scores(fx.documents(spark), labels).collect()
    assert {r["score"] for r in some} == {0.5} and len(some) == len(fx.texts())


def test_prefix_pairs_miss_none(spark):
    r, rows = random.Random(12), []
    for g in range(12):
        shared = fx.prose(200 + g, 90).split()
        for k in range(12):
            words = list(shared)
            for _ in range(r.randrange(3)):
                words[r.randrange(90)] = f"v{r.randrange(10**6)}"
            rows.append((20 * g + k, " ".join(words + fx.prose(900 + 20 * g + k, r.randrange(12)).split())))
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    df = spark.createDataFrame([(i, i, t) for i, t in rows], "doc long, label long, text string")
    got = {tuple(x) for x in near.prefix_pairs(df, 0.8).collect()}
    assert want <= got and len(want) > 30 and len(got) < len(rows) ** 2 / 8
