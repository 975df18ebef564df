"""The pipeline's stages, each against a brute-force version of its step on its own input."""

import hashlib
import zlib

import public_tokenizers

import __spark_entry__ as entry
import corpus_pipeline
from styloweave.llm import bpe, queries
from styloweave.llm.storage import stored
from tests.llm import fixtures as fx

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], FOLDER)))
    start, good, single, cut, clean, packed = (x.collect() for x in steps)
    assert [x.columns for x in steps[:5]] == [columns] * 5

    accepted = {r["doc_id"] for r in queries.QUERIES["op8_quality_classifier"](spark, FOLDER).collect() if r["predicted"]}
    assert {r["doc_id"] for r in good} == accepted and len(good) < len(start)
    assert [r for r in sorted(start) if r["doc_id"] in accepted] == sorted(good)

    classes = fx.jaccard_classes([(r["doc_id"], r["text"]) for r in good])
    assert sorted(single) == [r for r in sorted(good) if classes[r["doc_id"]] == r["doc_id"]]

    want = {i: (kept, gone) for i, _, gone, kept in fx.substring_removals([(r["doc_id"], r["text"]) for r in single])}
    texts = {r["doc_id"]: r["text"] for r in single}
    for r in cut:
        words = " ".join(fx.PLAIN.findall(r["text"]))
        kept, gone = want.pop(r["doc_id"])
        assert hashlib.sha256(words.encode()).hexdigest() == kept and r["n_chars"] == len(r["text"])
        assert gone or r["text"] == texts[r["doc_id"]]
    assert {kept for kept, _ in want.values()} <= {hashlib.sha256(b"").hexdigest()}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {x[0] for x in fx.contamination([(r["doc_id"], r["text"]) for r in cut], items) if x[5]}
    assert sorted(clean) == [r for r in sorted(cut) if r["doc_id"] not in bad]

    coder = bpe.encoder(public_tokenizers.path("word_bpe_49k.json")).whole
    sizes, ends = {}, {}
    for r in clean:
        ids = [*coder.encode(r["text"], add_special_tokens=False).ids, 1]
        sizes[r["doc_id"]] = len(ids)
        for g in (g for g in packed if g["doc_id"] == r["doc_id"]):
            part = b"".join(i.to_bytes(4, "little") for i in ids[g["start"]:g["start"] + g["length"]])
            assert zlib.crc32(part) == g["ids_crc32"]
    for g in packed:
        ends.setdefault(g["doc_id"], []).append((g["start"], g["start"] + g["length"]))
    for i, parts in ends.items():
        parts.sort()
        assert [a for a, _ in parts] == [0, *[b for _, b in parts[:-1]]] and parts[-1][1] == sizes[i]
    assert set(ends) == set(sizes)


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(queries.ORACLES) <= set(names)
