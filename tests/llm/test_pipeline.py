"""The pipeline's stages take effect one after the other."""

import corpus_pipeline
from quotaflow.llm.quality import quality_bands


def test_stages_on_the_small_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "mixing"]
    kept = quality_bands(docs).where("kept")
    first = corpus_pipeline.quality_rules(spark, docs, sf_small)
    assert first.columns == columns and 0 < first.count() == kept.count() <= before
    out = corpus_pipeline.run(spark, sf_small).toPandas()
    assert set(columns) < set(out.columns) and 0 < len(out) <= before
    assert out.doc_id.is_unique and (out.n_chars == out.text.str.len()).all()
    assert (out.taken == out["size"] * out.repeats + out.part_words).all()


def test_near_dedup_keeps_one_of_each_group(spark, sf_small):
    text = " ".join(f"word{i}" for i in range(60))
    data = [(5, text), (3, text), (9, text + " more"), (4, "other words here and there"), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_dedup(spark, docs, sf_small).collect()
    assert sorted(x.doc_id for x in left) == [3, 4, 6, 7]
