"""Tree strings and construction patterns."""

import random
import re

import pytest

from styloweave.functions import fixed_values as fv
from styloweave.operators import syntax


def node(token, lemma, tag, dep, head):
    return {"token": token, "lemma": lemma, "tag": tag, "dep": dep, "head": head}


CLEFT = [node("It", "it", "PRP", "nsubj", 1), node("was", "be", "VBD", "ROOT", 1),
         node("John", "John", "NNP", "attr", 1), node("who", "who", "WP", "nsubj", 4),
         node("left", "leave", "VBD", "relcl", 2)]


def test_tree_string(tokens):
    tree = syntax.linear_trees(tokens({"d": [CLEFT]})).first()
    assert tree["tree"] == ("(was-be-VBD-ROOT(It-it-PRP-nsubj)(John-John-NNP-attr"
                            "(left-leave-VBD-relcl(who-who-WP-nsubj))))")
    assert tree["sentence"] == "It was John who left"


def test_cleft_matches(tokens):
    names = {r["pattern_name"] for r in syntax.construction_matches(tokens({"d": [CLEFT]})).collect()}
    assert names == {"it-cleft", "subj-relcl"}


POSITIVES = {
    "it-cleft": "(was-be-VBD-ROOT(It-it-PRP-nsubj)(John-John-NNP-attr(left-leave-VBD-relcl(who-who-WP-nsubj))))",
    "pseudo-cleft": "(is-be-VBZ-ROOT(want-want-VBP-csubj(What-what-WP-dobj)(I-I-PRP-nsubj))(rest-rest-NN-attr)))",
    "all-cleft": "(is-be-VBZ-ROOT(All-all-DT-nsubj(want-want-VBP-relcl(I-I-PRP-nsubj))(rest-rest-NN-attr)))",
    "there-cleft": "(is-be-VBZ-ROOT(There-there-EX-expl)(man-man-NN-attr(waits-wait-VBZ-relcl(who-who-WP-nsubj))))",
    "if-because-cleft": "(is-be-VBZ-ROOT(goes-go-VBZ-advcl(If-if-IN-mark)(he-he-PRP-nsubj))(it-it-PRP-nsubj))",
    "passive": "(bitten-bite-VBN-ROOT(dog-dog-NN-nsubjpass(The-the-DT-det)(was-be-VBD-auxpass)))",
    "subj-relcl": "(man-man-NN-ROOT(left-leave-VBD-relcl(who-who-WP-nsubj)))",
    "obj-relcl": "(is-be-VBZ-ROOT(man-man-NN-nsubj(saw-see-VBD-relcl(whom-whom-WP-dobj)(I-I-PRP-nsubj)))(old-old-JJ-acomp)))",
    "tag-question": "(is-be-VBZ-ROOT(it-it-PRP-nsubj)(?-?-.-punct))",
    "coordinate-clause": "(came-come-VBD-ROOT(He-he-PRP-nsubj)(and-and-CC-cc)(left-leave-VBD-conj(she-she-PRP-nsubj)))",
    "parenthetical": "(idea-idea-NN-ROOT(one-one-NN-nsubj(,-,-,-punct)(good-good-JJ-x(say-say-UH-appos)(,-,-,-punct)))",
    "passive_rus": "(сдела-сделать-VERB-ROOT-Voice=Pass(дом-дом-NOUN-nsubj-))",
    "parataxis_rus": "(знаю-знать-VERB-parataxis-)",
    "participle_rus": "(идёт-идти-VERB-ROOT-(читающий-читать-VERB-acl-VerbForm=Part))",
    "gerund_rus": "(шёл-идти-VERB-ROOT-(читая-читать-VERB-advcl-VerbForm=Conv))",
    "conj_rus": "(шёл-идти-VERB-ROOT-(пел-петь-VERB-conj-))",
    "nested_structure_rus": "(знал-знать-VERB-ROOT-(придёт-прийти-VERB-ccomp-(что-что-SCONJ-mark-)))",
    "one_word_sent_rus": "(Ночь-ночь-NOUN-ROOT-x(.-.-PUNCT-punct-))",
    "diminutive_rus": "(домик-домик-NOUN-ROOT-)",
    "multiple_punct_rus": "(Да-да-PART-ROOT-(...-...-PUNCT-punct-))",
    "additional_info_rus": "(Да-да-X-ROOT-(,-,-PUNCT-punct-x)(,-,-PUNCT-punct-x))",
}


def trees_frame(spark, trees):
    return spark.createDataFrame([("d", i, "s", t) for i, t in enumerate(trees)],
                                 "doc_id string, sentence_id int, sentence string, tree string")


def random_tree(rng, language):
    tags = ["NN", "VB", "VBD", "PRP", "WP", "WDT", "IN", "CC", "JJ", ".", "EX", "DT", "VERB", "NOUN", "PUNCT"]
    deps = ["nsubj", "attr", "relcl", "conj", "cc", "punct", "dobj", "advcl", "auxpass", "nsubjpass", "expl",
            "mark", "appos", "acl", "amod", "parataxis"]
    lemmas = ["be", "it", "there", "all", "if", "do", "?", "cat", "who", "дом", "домик", "читать"]
    n = rng.randint(2, 14)
    heads = [0] + [rng.randrange(i) for i in range(1, n)]
    tail = "-" if language == "ru" else ""
    labels = ["-".join([rng.choice(["It", "was", "cat", "?", "дом"]), rng.choice(lemmas), rng.choice(tags),
                        "ROOT" if i == 0 else rng.choice(deps)]) + tail for i in range(n)]
    return syntax._preorder(heads, labels)


@pytest.mark.parametrize("language", ["en", "ru"])
def test_patterns_agree_with_the_python_engine(spark, language):
    rng = random.Random(7)
    patterns = syntax.patterns_for(language)
    trees = [random_tree(rng, language) for _ in range(300)] + [POSITIVES[n] for n in patterns]
    got = {(r["sentence_id"], r["pattern_name"]): r["matched"] for r in
           syntax.matches_in_trees(trees_frame(spark, trees), patterns).collect()}
    want = {}
    for i, tree in enumerate(trees):
        for name, pattern in patterns.items():
            if m := re.search(pattern, tree):
                want[(i, name)] = m.group()
    assert got == want
    missing = set(patterns) - {name for _, name in want} - {"one_word_sent_rus"}
    assert not missing


def test_preorder_equals_recursion():
    rng = random.Random(3)

    def brute(heads, labels):
        kids = {i: [j for j, h in enumerate(heads) if h == i and j != i] for i in range(len(heads))}
        def visit(i):
            inner = "".join(visit(k) for k in kids[i])
            return "(" + labels[i] + (inner if kids[i] else ")")
        root = next(i for i, h in enumerate(heads) if h == i)
        return visit(root) + ")" * sum(bool(k) for k in kids.values())

    for _ in range(300):
        n = rng.randint(1, 30)
        root = rng.randrange(n)
        order = [root] + rng.sample([i for i in range(n) if i != root], n - 1)
        heads = [0] * n
        heads[root] = root
        for k in range(1, n):
            heads[order[k]] = order[rng.randrange(k)]
        labels = [f"w{i}" for i in range(n)]
        assert syntax._preorder(heads, labels) == brute(heads, labels)


def test_deep_sentence_stays_whole(spark, tokens):
    n = 20_000
    chain = [node("w", "w", "NN", "dep", max(i - 1, 0)) for i in range(n)]
    row = syntax.linear_trees(tokens({"d": [chain]})).first()
    assert row["tree"].count("(") == n and row["tree"].endswith(")" * n)


def test_pattern_table():
    assert "mine" in syntax.patterns_for(add={"mine": "x"})
    assert "passive" not in syntax.patterns_for(remove=["passive"])
    with pytest.raises(KeyError):
        syntax.patterns_for(remove=["nothing"])
    with pytest.raises(ValueError):
        syntax.patterns_for("fr")
    assert len(fv.ENGLISH_PATTERNS) == 11 and len(fv.RUSSIAN_PATTERNS) == 10


def test_sentence_type_fallback(tokens):
    tok = tokens({"a": [["Go", "!"], ["Why", "?"], ["So"]], "b": [CLEFT, ["Go", "!"]]})
    got = {(r["doc_id"], r["item"]): r["n"] for r in syntax.sentence_types(tok).collect()}
    assert got == {("a", "exclamatory"): 1, ("a", "interrogative"): 1, ("a", "declarative"): 1,
                   ("b", "it-cleft"): 1, ("b", "subj-relcl"): 1}
