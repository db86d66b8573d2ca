"""The mix's decision takes effect: what is left adds up to the targets."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from quotaflow.llm.common import first_words
from quotaflow.llm.mixing import mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return len(WORD.findall(text or ""))


def check(docs, got):
    whole = {x.doc_id: x for x in mix_sources(docs).collect()}
    taken, target = {}, {}
    for x in got:
        before = whole[x.doc_id]
        assert x.taken > 0 and x.n_chars == len(x.text)
        assert x.text == before.text if x.repeats else (x.text == x.part_text and before.text.startswith(x.text))
        assert words(x.part_text) == x.part_words and (x.part_text is None) == (x.part_words == 0)
        assert before.text.startswith(x.part_text or "")
        made = words(x.text) * x.repeats + words(x.part_text)
        assert made == x.taken
        taken[x.source] = taken.get(x.source, 0) + made
        target[x.source] = x.target
    assert {x.doc_id for x in got} == {i for i, x in whole.items() if x.taken > 0}
    for s, n in taken.items():
        assert abs(n - target[s]) <= 1, s


def test_a_source_over_its_target_is_cut(spark, sf_small):
    r = random.Random(7)
    gaps = [" ", "  ", "\n", "\t \r\n", "\x0b"]
    data = []
    for i in range(400):
        text = "".join(r.choice(gaps) + r.choice(["a", "bé", "日本", "word", "x.y"]) for _ in range(r.randint(0, 60)))
        data.append((i, text, "en", "a" if i % 3 else "bcd"[i % 9 // 3], len(text)))
    data += [(1000, None, None, "b", 0), (1001, "", None, "a", 0), (1002, "long " * 300, None, "d", 1500)]
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = corpus_pipeline.mixing(spark, docs, sf_small).collect()
    check(docs, got)
    assert len(got) < len(data) - 50
    assert any(x.part_words and not x.repeats for x in got)


def test_first_words_of_a_long_text(spark):
    text = "\n  " + "long  wörd\t" * 30_000
    d = spark.createDataFrame([(text, 1), (text, 59_999), (text, 60_000), ("a", 1)], "t string, n long")
    got = [x[0] for x in d.select(first_words(F.col("t"), F.col("n"))).collect()]
    assert got == ["\n  long", text[: -len("  wörd\t")], text[:-1], "a"]


def test_stage_on_the_small_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = corpus_pipeline.mixing(spark, docs, sf_small).collect()
    assert 0 < len(got) < docs.count()
    check(docs, got)
