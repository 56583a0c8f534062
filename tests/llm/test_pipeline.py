"""The pipeline: columns, effects of every stage, and planted cases."""

import corpus_pipeline
import __spark_entry__


def test_registered():
    names = __spark_entry__.queries()
    assert names["pipeline"] is corpus_pipeline.run
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_on_a_small_table(spark, sf0001, tmp_path):
    docs = spark.read.parquet(f"{sf0001}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, docs, sf0001).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs.count())
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.where("n_chars != length(text)").count() == 0 or number == 0
    assert kept == sorted(kept, reverse=True) and kept[1] < kept[0] and kept[-1] > 0.5 * kept[0]
    assert {"doc_id", "n_tokens", "ids"} <= set(docs.columns)
