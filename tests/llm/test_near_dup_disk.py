"""near_duplicates: what is written while the pairs are verified."""

import glob

from quotaflow.llm import jaccard_join as J


def test_neither_blocks_nor_a_copy_of_the_texts_while_pairs_are_verified(spark, monkeypatch):
    left, names, written = [], [], J.written

    def watched(df, name):
        names.append(name)
        done = written(df, name)
        if name == "verified":
            root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
            left.extend(f for kind in ("sets", "texts") for f in glob.glob(f"{root}/llm-{kind}-*") if f not in before)
        return done

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(glob.glob(f"{root}/llm-*"))
    monkeypatch.setattr(J, "written", watched)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(words[:40 + i % 3])) for i in range(6)] + [(9, "alone here"), (10, None)]
    got = {r.doc_id: r.component_id for r in J.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 9: 9, 10: 10}
    assert "verified" in names and not left
