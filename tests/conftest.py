import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from styloweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores="4", partitions=3)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


class Tokens:
    """Builds a token table from `doc -> sentences -> (token, fields)`."""

    def __init__(self, spark):
        self.spark = spark

    def __call__(self, docs):
        from styloweave.operators.tokens import from_annotations
        rows = []
        for doc, sents in docs.items():
            at = 0
            for s, sent in enumerate(sents):
                first = at
                for w in sent:
                    f = {"token": w} if isinstance(w, str) else dict(w)
                    token = f["token"]
                    head = f.get("head")
                    rows.append((doc, s, at, token, f.get("lemma", token.lower()),
                                 f.get("pos", "NOUN"), f.get("tag", "NN"),
                                 first + head if head is not None else first,
                                 f.get("dep", "dep"), f.get("morph", ""),
                                 f.get("ent_type", "")))
                    at += 1
        df = self.spark.createDataFrame(
            rows, "doc_id string, sentence_id int, token_id int, token string, lemma string, "
                  "pos string, tag string, head_token_id int, dep string, morph string, "
                  "ent_type string")
        return from_annotations(df)


@pytest.fixture(scope="session")
def tokens(spark):
    return Tokens(spark)
