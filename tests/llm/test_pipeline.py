"""The pipeline's stages in order, each on all its predecessor kept, against what brute force expects of each."""

import corpus_pipeline
from taxolith.llm import decontaminate, pieces, registry

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0
    codec = pieces.codec(pieces.model_path())
    texts = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
    for r in docs.collect():
        assert codec.decode(r.ids) == (texts[r.doc_id] or "")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.contaminated(before, bench).isEmpty()
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]


def test_registry_names():
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in registry.QUERIES) == 1
