"""The stages against what they are to keep."""

from collections import Counter

import numpy as np

import corpus_pipeline
from tracemill.llm import mixing, queries

from .test_operators import DOCUMENTS, brute_contamination, brute_similar


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "tokens"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        own = [r.doc_id for r in docs.select("doc_id").collect()]
        assert own and set(own) <= before
        if i < 3:
            assert len(own) == len(set(own))
        if i < 4:
            assert docs.columns == names
        before = set(own)
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def written(spark, folder, texts):
    """A folder of tables: documents with nulls, empty texts, copies and repeated rows, and what the stages ask for."""
    data = [(i, t, "en", ["a", "b", None][i % 3], 0) for i, t in enumerate(texts)]
    data += [data[4], (None, "a row without an id that says something of its own", "en", "a", 0), (None, None, None, None, None), (3, "another text under an id that is taken already", "en", "b", 0)]
    spark.createDataFrame(data, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "Ann has seven red apples and eats two of them before noon"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return data


def test_stages_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " \n", "one two", *(" ".join(rng.choice(words, 60)) for _ in range(12))]
    texts += [texts[5], texts[6] + " and a new end", "Intro: Bob has 9 red apples and eats 4 of them before noon. Ha", "word " * 3000]
    data = written(spark, str(tmp_path), texts)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert by_name["tokens"](spark, docs.limit(0), str(tmp_path)).count() == 0

    kept = Counter((r.doc_id, r.text) for r in by_name["simhash"](spark, docs, str(tmp_path)).collect())
    groups = brute_similar([(r[0], r[1]) for r in data])
    firsts = Counter((r[0], r[1]) for r in data if r[0] is None)
    assert sum(kept.values()) == len(groups) + sum(firsts.values()) and max(kept[k] for k in kept if k[0] is not None) == 1
    for g in groups:  # of each group one row, of the least id
        own = [k for k in g if kept[k]]
        assert len(own) == 1 and own[0][0] == min(i for i, _ in g)

    clean = Counter((r.doc_id, r.text) for r in by_name["decontamination"](spark, docs, str(tmp_path)).collect())
    held = brute_contamination([r[1] for r in data], {1: "Ann has seven red apples and eats two of them before noon"})
    assert held and clean == Counter((r[0], r[1]) for k, r in enumerate(data) if k not in {k for k, _ in held})

    mixed = Counter(r.doc_id for r in by_name["mixing"](spark, docs, str(tmp_path)).collect())
    known = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert set(mixed) <= set(known) and all(mixed[i] <= 3 * sum(r[0] == i for r in data) for i in mixed)
    assert not any(mixed[i] for i in (0, 1, 2))

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = Counter((r.doc_id, r.n_tokens) for r in by_name["tokens"](spark, docs, str(tmp_path)).collect())
    assert got == Counter((r[0], len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in data)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
