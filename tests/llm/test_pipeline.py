"""The pipeline's stages on one another's results."""

import corpus_pipeline


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert ids <= {r.doc_id for r in spark.read.parquet(f"{tmp_path}/2").select("doc_id").collect()}


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert rows and max(fill.values()) <= 4096
