"""The pipeline against its steps in plain Python."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import sentencepiece

from fathomline.llm import mixing, queries

SMALL = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    one = stages["toxicity"](spark, docs, SMALL)
    scores = {r["doc_id"]: r["predicted"] for r in queries.op9_toxicity(spark, SMALL).collect()}
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == {i for i in kept if not scores[i]}

    two = stages["exact dedup"](spark, one, SMALL)
    last = {}
    for r in one.collect():
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        last[key] = max(last.get(key, r["doc_id"]), r["doc_id"])
    assert two.columns == columns and sorted(r["doc_id"] for r in two.collect()) == sorted(last.values())

    three = stages["SimHash near-dedup"](spark, two, SMALL)
    grams = {}
    for r in two.collect():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "").split(" ")
        w = [x for y in w for x in y.replace("\t", "\n").replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\n").split("\n") if x]
        grams[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, first = sorted(grams), {}
    for i in ids:  # components, with each one's smallest id
        near = [j for j in first if grams[i] & grams[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) or not grams[i] | grams[j]]
        low = min((first[j] for j in near), default=i)
        met = {first[j] for j in near}
        first = {j: low if r in met else r for j, r in first.items()} | {i: low}
    left = {r["doc_id"] for r in three.collect()}
    assert three.columns == columns and left == set(first.values())

    four = stages["mixing sources to target weights"](spark, three, SMALL)
    times = {}
    for r in four.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(three).collect()}
    assert four.columns == columns and times == {i: n for i, n in taken.items() if n} and max(times.values()) <= 3

    five = stages["SentencePiece encoding and decoding"](spark, four, SMALL).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    assert len(five) == sum(times.values())
    for r in five:
        want = library.encode(kept[r["doc_id"]]["text"], add_eos=True)
        assert list(r["ids"]) == want and r["n_tokens"] == len(want) and r["decoded_sha256"] == hashlib.sha256(library.decode(want).encode()).hexdigest()

    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.count() == len(five) and whole.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
