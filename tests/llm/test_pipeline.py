"""The pipeline's stages against plain versions, and on awkward rows."""

import corpus_pipeline
from govaudit.llm import severity
from tests.llm import brute
from tests.llm.test_operators import awkward_rows


def by_hand(docs, model_toxic):
    clean = {i: t for i, t in docs.items() if i not in model_toxic}
    label, _ = brute.components(clean)
    kept = sorted((i, t) for i, t in clean.items() if label[i] == i)
    cut = {i: x[3].decode("utf-8", "ignore") for i, x in brute.without_repeats(kept).items()}
    return {i: brute.BYTE_BPE.encode(t, add_special_tokens=False).ids + [1] for i, t in cut.items()}


def test_pipeline(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = severity.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = {r.doc_id for r in severity.score(documents, model).where("toxic").collect()}
    want = by_hand({r.doc_id: r.text or "" for r in documents.collect()}, toxic)
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in pieces} == set(want)
    for i, ids in want.items():
        mine = sorted((r.start, r.length, r.ids_crc32) for r in pieces if r.doc_id == i)
        assert sum(n for _, n, _ in mine) == len(ids)
        assert all(brute.crc(ids[a: a + n]) == c for a, n, c in mine)


def test_stages_take_awkward_rows(spark, sf_dir, tmp_path):
    rows = [(i, t, None, None, None, "x", "y") for i, t in awkward_rows()] + [(None, "p q r", "en", "s", 5, None, None)] * 2 + [(None, None, None, None, None, None, None)]
    full = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, row string")
    for name, docs in (("full", full), ("empty", full.limit(0))):
        for k, (stage, function) in enumerate(corpus_pipeline.STAGES):
            out = function(spark, docs, sf_dir)
            if stage != "packing":
                assert out.columns == full.columns
            out.write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
        assert (docs.count() > 0) == (name == "full")
    kept = spark.read.parquet(f"{tmp_path}/full1")
    assert kept.where("doc_id IS NULL AND text = 'p q r'").count() == 1 and kept.where("doc_id = 7").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "packing"]
