"""Tree concatenation against the tokenizer library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quotaflow.llm.bpe_tree import PIECES, WORDS, Decoder, TreeEncoder, decode_ids, encode_texts, unpacked

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
DECODER = Decoder(PATH)
PARTS = ["a", "b", "'s", "'ll", "'", " ", "  ", "\n", "\t", "é", "中", "ह", "ि", "1", "٣", "²", "!", "--", " ", "　", "the",
         "ing ", "<|endoftext|>", "<|endof", "text|>", "\x1c", "\x00", "\x85", "😀", "́", "ß", "​", "'re", "s", " '"]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [6, 16, 50])
def test_joins_are_exact(leaf):
    r, encoder = random.Random(leaf), TreeEncoder(PATH, leaf)
    for _ in range(400):
        some = r.sample(PARTS, r.randint(1, 8))
        text = "".join(r.choice(some) for _ in range(r.choice([3, 8, 30, 120])))
        want = ids(text)
        assert encoder.encode(text) == want
        rows = encoder.segments(text, 2 * leaf)
        assert unpacked(encoder.assemble([(*x, *encoder.segment(x[0], x[2])) for x in rows[::-1]])).tolist() == want
        assert DECODER.decode(want) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 60_000, "- " * 20_000, "lorem" * 20_000, " " * 50_000, "中文字" * 20_000, "'" * 30_000])
def test_long_unbroken_texts(text):
    assert TreeEncoder(PATH).encode(text) == ids(text)


def test_ascii_classes_are_the_library_s():
    pieces = LIBRARY.pre_tokenizer.pre_tokenize_str
    for code in range(128):
        for text in (f"a{chr(code)}", f"0{chr(code)}", f"\t{chr(code)}", f" {chr(code)}", f"!{chr(code)}"):
            assert [b - a for _, (a, b) in pieces(text)] == list(map(len, PIECES.findall(text))), repr(text)


def test_characters_python_classes_otherwise_go_the_other_way():
    encoder = TreeEncoder(PATH)
    for text in ("a²b", "x\x1cy", "١٢", "é ü", "中文。", "a_b", "\x85 a", "Ⅷ", "ª", "a\u0301"):
        kinds, find = encoder.view(text)
        assert [b - a for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)] == list(map(len, find(kinds))), repr(text)
    assert encoder.view("Plain ASCII and é")[1] == WORDS.findall and encoder.view("a²")[1] == PIECES.findall


def test_decoding_takes_any_ids():
    broken = ids("é😀")
    for part in (broken[1:], broken[:-1], [50256, *broken[:1], 50256]):
        assert DECODER.decode(part) == LIBRARY.decode(part, skip_special_tokens=False)
    assert DECODER.decode([None, 10**6, -5]) == "" == DECODER.decode([])


def test_encode_texts(spark):
    r = random.Random(3)
    texts = [None, "", " ", "same", "same", "x" * 700, "".join(r.choice(PARTS) for _ in range(3000)), "<|endoftext|>" * 90]
    rows = [(None if i == 3 else i, t, "clash", i, "clash", "clash", "clash") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, ids string, n_tokens int, key string, decoded string, place string"
    docs = spark.createDataFrame(rows, schema)
    for spread in (100, 65_536):
        got = decode_ids(encode_texts(docs, PATH, leaf=16, spread=spread), PATH).collect()
        assert len(got) == len(rows)
        for x in got:
            want = ids(x.text or "")
            assert list(x.ids) == want and x.n_tokens == len(want) and x.decoded == (x.text or "")
            assert x.key == x.place == "clash"
    assert decode_ids(encode_texts(docs.where("false"), PATH), PATH).count() == 0


def test_query_digests(spark, sf_small):
    from quotaflow.llm.queries import op11_bpe_tree

    got = {x.doc_id: x for x in op11_bpe_tree(spark, sf_small).collect()}
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = ids(d.text or "")
        text = LIBRARY.decode(want, skip_special_tokens=False)
        assert tuple(got[d.doc_id])[1:] == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(),
                                            hashlib.sha256(text.encode()).hexdigest())
