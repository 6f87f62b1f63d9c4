"""The pipeline's stages, each judged on its own input, by brute force."""

import re

import corpus_pipeline

from nearfield.llm import simhash


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.toPandas()
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns
        after = kept.toPandas()
        assert set(after["doc_id"]) <= set(before["doc_id"]) and len(after) > 0.4 * len(before), name
        if name == "exact dedup":
            norm = before["text"].map(lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t))
            assert set(after["doc_id"]) == set(before.groupby(norm)["doc_id"].max())
        if name.startswith("simhash"):
            fps = [simhash.fingerprint(t) for t in after["text"]]
            assert all(bin(a ^ b).count("1") > 2 for i, a in enumerate(fps) for b in fps[:i])
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf).toPandas()
    assert set(packed["doc_id"]) == set(kept.toPandas()["doc_id"])
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
