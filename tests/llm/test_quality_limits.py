"""Noise and repetition at every length, and inside long texts."""

import base64
import random
import string

import pytest
import zstandard

from quotaflow.llm.quality import BANDS, CHUNK, quality_bands

LENGTHS = [192, 223, 255, 256, 319, 383, 511, 700, 767, 1023, 1500, 2047, 2048, 4095, 4096, 5000, 16_383, 20_000, 65_535, 200_000]
STEMS = "der die das Haus stream water light nuit jour pays ciudad tiempo house walk across between Straße garçon niño después".split()


def prose(n, r):
    """Words of many forms, capitals, commas and stops; ``n`` bytes."""
    vocabulary = [*STEMS, *("".join(r.choice("aeiouaeinrstlmdbcpgfhvuk") for _ in range(r.randint(2, 9))) for _ in range(500))]
    out, size = [], 0
    while size < n:
        w = r.choice(vocabulary[: 40] if r.random() < 0.5 else vocabulary) + r.choice(["", "", "", "", "", "", ",", "."])
        out.append(w)
        size += len(w.encode()) + 1
    return " ".join(out).encode()[:n].decode("utf-8", "ignore")


def noise(n, r):
    out = ""
    while len(out) < n:
        out += "".join(r.choices(string.ascii_letters + string.digits, k=r.choice((8, 9)))) + " "
    return out[:n]


def verdicts(spark, texts):
    d = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(8)
    return {x.doc_id: x for x in quality_bands(d).collect()}


def test_every_band_rejects_noise_and_repetition(spark):
    r, texts = random.Random(3), {}
    for n in LENGTHS:
        texts[f"noise {n}"] = noise(n, r)
        texts[f"prose {n}"] = prose(n, r)
    for n in (1500, 2500):
        texts[f"base64 {n}"] = base64.encodebytes(r.randbytes(n)).decode()[:n]
    for n in (300, 700, 1500, 5000, 20_000, 100_000):  # few repeated windows of five words, yet repetitive
        texts[f"repeated {n}"] = "".join(f"{'=' * 60} {i:x} " for i in range(n // 62))
    got = verdicts(spark, texts)
    for k, x in got.items():
        if not k.startswith("repeated"):
            assert not x.base_failed, k
        assert x.kept == k.startswith("prose"), (k, x.zstd_ratio, x.bad_chunks)


@pytest.mark.parametrize("n", [6000, 30_000, 70_000])
def test_a_stretch_inside_a_long_text(spark, n):
    r = random.Random(n)
    clean = prose(n, r)
    at, line = n // CHUNK // 2 * CHUNK, "=" * 60
    texts = {
        "clean": clean,
        "noise": clean[:at] + " " + noise(2 * CHUNK, r) + " " + clean[at:],
        "repeated": clean[:at] + " " + "".join(f"{line} {i:x} " for i in range(2 * CHUNK // 62)) + clean[at:],
        "last": clean.encode()[: n // CHUNK * CHUNK].decode("utf-8", "ignore") + noise(1500, r),
    }
    got = verdicts(spark, texts)
    assert {k: x.kept for k, x in got.items()} == {"clean": True, "noise": False, "repeated": False, "last": False}


def test_a_last_chunk_of_a_few_bytes_is_no_fault(spark):
    r = random.Random(6)
    texts = {str(n): prose(CHUNK, r).ljust(CHUNK, "a") + "zq"[:n] for n in (0, 1, 2)}
    assert all(x.kept and x.bad_chunks == 0 for x in verdicts(spark, texts).values())


def test_limits_are_below_random_letters_and_digits():
    r, packer = random.Random(1), zstandard.ZstdCompressor(level=3)
    for below, _, high in BANDS[2:]:
        n = int(min(below - 1, 200_000))
        assert high < min(len(packer.compress(noise(n, r).encode())) / n for _ in range(10)), below
