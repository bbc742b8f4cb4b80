import hashlib

import corpus_pipeline


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now.count()
        now = stage(spark, now, small)
        rows = now.collect()
        assert now.columns == docs.columns and 0.8 * before <= len(rows) <= before, name
        now = spark.createDataFrame(rows, docs.schema)
    kept = {r.doc_id: r.text for r in now.collect()}
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert {i: r.decoded_sha256 for i, r in final.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in kept.items()}
    assert all(len(r.ids) == 4 * r.n_tokens for r in final.values())
