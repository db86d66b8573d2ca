"""The pipeline's stages on nulls, empty and long texts, equal rows, empty tables and clashing columns."""

import random
import uuid

import pytest

import corpus_pipeline as P
from quotaflow.session import scratch_path

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, n_lines string, "
          "contaminated string, hub string, size string, note string")
EXTRA = {"kept": "mine", "n_words": "w", "n_lines": "l", "contaminated": "c", "hub": "h", "note": "n"}


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


def rows():
    out = [(i, prose(i), "en", "ab"[i % 2]) for i in range(30)]
    out += [(100, None, None, None), (101, "", "en", "a"), (102, " \n\t ", "en", "a"), (None, prose(200), None, None), (103, prose(3), "en", None),
            (104, prose(7, 4000), "en", "b"), (5, prose(5), "en", "a"), (5, prose(5), "en", "a")]
    return [(i, t, lang, s, 1, *[EXTRA[k] for k in ("kept", "n_words", "n_lines", "contaminated", "hub")], "s", EXTRA["note"]) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def sf(spark):
    path = scratch_path(spark, f"edges-{uuid.uuid4().hex}")
    spark.createDataFrame([(1, prose(9)), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(2).write.parquet(f"{path}/documents.parquet")
    return path


def test_further_columns_pass_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, sf), f"edges-{name}")
        assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns, name
        assert docs.count() > 0
        for r in docs.collect():
            assert {k: r[k] for k in EXTRA} == EXTRA and r["size"] == "s", name


def test_run_over_edges(spark, sf):
    got = P.run(spark, sf).collect()
    ids = [r.doc_id for r in got]
    assert {100, 101, 102, 9}.isdisjoint(ids)  # no words, or the benchmark's text
    assert not (3 in ids and 103 in ids)  # equal texts: the smaller id alone can stay
    assert len(ids) == len([r for r in got if r.taken > 0]) and all(r.note == "n" for r in got)


@pytest.mark.parametrize("stage", [name for name, _ in P.STAGES])
def test_empty_tables(spark, sf, stage):
    none = spark.createDataFrame([], SCHEMA)
    assert dict(P.STAGES)[stage](spark, none, sf).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in P.STAGES])
def test_null_rows(spark, sf, stage):
    nulls = spark.createDataFrame([(None,) * 12, (None,) * 12], SCHEMA)
    got = dict(P.STAGES)[stage](spark, nulls, sf).collect()
    assert len(got) == (0 if stage in ("quality_rules", "mixing") else 2)
