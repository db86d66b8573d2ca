"""Words of any length are counted in memory and time that grow with them."""

import random
import time
import tracemalloc

import pytest

from quotaflow.llm.token_counts import LONG, PrefixCounter

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    return PrefixCounter(path), Tokenizer.from_file(path)


def counted(tok, text):
    return len(tok.encode(text, add_special_tokens=False).ids)


def long_runs():
    r = random.Random(12)
    letters = "".join(r.choices("etaoinshrdlu", k=200_000))
    cjk = "".join(chr(r.randint(0x4E00, 0x9FA0)) for _ in range(20_000))
    return {"letters": letters, "dashes": "-" * 200_000, "symbols": "".join(r.choices("-=_*#~", k=200_000)), "one letter": "a" * 200_000, "cjk": cjk,
            "quotes": letters[:100_000] + "'" + letters[:100_000] + "'ll'x", "in a text": "some words " + letters[:50_000] + " and more"}


@pytest.mark.parametrize("kind", list(long_runs()))
def test_long_runs_equal_the_library(pair, kind):
    counter, tok = pair
    text, start = long_runs()[kind], time.monotonic()
    tracemalloc.start()
    table = counter.table(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(table) == len(text) and table[-1] == counted(tok, text)
    for i in (1, LONG - 1, LONG, LONG + 1, 5000, 19_999):
        assert table[i - 1] == counted(tok, text[:i]), i
    assert peak < 400e6 and time.monotonic() - start < 60


def test_prefixes_around_quotes_equal_the_library(pair):
    counter, tok = pair
    r = random.Random(3)
    for _ in range(150):
        text = "".join(r.choices(["'", "'", "s", "t", "re", "ve", "ll", "d", "m", "a", "r", "7", "!", "é", "日", " "], k=r.randint(1, 14)))
        text = counter.normal(text).strip()
        want = [counted(tok, text[:i]) for i in range(1, len(text) + 1)]
        assert list(counter.table(text)) == want, text
    long = "x" * LONG + "'re" + "y" * LONG + "'" + "!" * (LONG + 2) + "'s"
    table = counter.table(long)
    assert list(table) == [counted(tok, long[:i]) for i in range(1, len(long) + 1)]
