"""op8: every labelled row outside the held-out fold is learnt from."""

from pyspark.sql import functions as F

from quotaflow.llm.common import crc_mod
from quotaflow.llm.toxicity import toxicity


def test_rows_beyond_any_sample_are_learnt(spark):
    """Rows 4,001 and on by the hash that once chose a sample hold a word that
    makes a text harmless; nothing else tells it."""
    ids = [r.id for r in spark.range(8000).where(crc_mod(F.col("id"), 4) != 2).orderBy(F.xxhash64("id", F.lit(17)), "id").collect()]
    texts = {i: ("nasty words here" if k % 10 == 0 else "kind words here") if k < 4500 else "nasty zebra words" for k, i in enumerate(ids)}
    labels = [(i, int(t == "nasty words here")) for i, t in texts.items()]
    held = [r.id for r in spark.range(8000, 9000).where(crc_mod(F.col("id"), 4) == 2).limit(20).collect()]
    texts |= {i: "nasty zebra words" if k % 2 else "nasty words here" for k, i in enumerate(held)}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    got = {r.doc_id: r.predicted for r in toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()}
    assert [got[i] for i in held] == [0 if k % 2 else 1 for k in range(len(held))]


def test_the_driver_gets_one_model_a_pass(spark, monkeypatch):
    """However many tasks train copies, no more than one model is collected."""
    from pyspark.sql.classic.dataframe import DataFrame

    from quotaflow.llm import toxicity as T

    monkeypatch.setattr(T, "SHARE", 25)
    monkeypatch.setattr(T, "EPOCHS", 2)
    monkeypatch.setattr(T, "ENOUGH", 1)
    sent, collect = [], DataFrame.collect

    def counted(df):
        rows = collect(df)
        sent.append(sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    rows = [(i, f"{'nasty' if i % 5 == 0 else 'kind'} words {i}", "en", int(i % 5 == 0)) for i in range(300)]
    model = T.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").withColumn(
        "text", F.col("text").cast("binary")))
    one = sum(p.nbytes for p in model.parts())
    assert len([n for n in sent if n > one // 2]) >= 3  # the passes
    assert max(sent) <= one


def test_a_mean_of_copies():
    """A table's row is averaged over the copies that changed it, the rest over all."""
    import numpy as np

    from quotaflow.llm.toxicity import TextConvolution

    model = TextConvolution()
    copies = [TextConvolution() for _ in range(3)]
    copies[0].tables[1][7] += 3
    copies[0].seen_tables[1][7] += 3
    for c in copies[1:]:
        c.out += 3
    want, out = model.tables.copy(), model.out + 2
    want[1][7] += 3
    arrays = [[p.astype(np.float32) for p in c.parts()] for c in copies]
    changes = [model.change(k, [a[k] for a in arrays]) for k in range(len(arrays[0]))]
    for k, change in enumerate(changes):
        model.move(k, change)
    assert np.allclose(model.tables[1][7], want[1][7], atol=1e-6) and np.allclose(model.out, out, atol=1e-6)
