"""The pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline
from tests.llm.test_llm import DOCS, sentence


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    texts = ["\n".join(sentence(rng, 14) for _ in range(4)) for _ in range(400)]
    bench = [sentence(rng, 30) for _ in range(3)]
    labels = []
    for i in range(400):
        toxic = i % 5 == 4
        if toxic:
            lines = texts[i].split("\n")
            texts[i] = "\n".join(f"{x} vile grubby wretchedly" for x in lines)
        labels.append((i, 1, int(toxic)))
    texts[10] = texts[10] + " " + bench[0]
    texts[20] = texts[1]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    clean = {i for i in range(400) if i % 5 != 4} - {10, 20}
    assert kept == clean
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
