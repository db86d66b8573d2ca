"""The training-data operators against brute force on small tables, with
nulls, empty and long texts, equal rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quotaflow.llm.decontaminate import contamination, phrase_matches, positional_index, proximity_matches
from quotaflow.llm.html_text import extract_text, main_text
from quotaflow.llm.jaccard_join import near_duplicates
from quotaflow.llm.language_id import language_id
from quotaflow.llm.line_dedup import build_shard, drop_frequent_lines, probe
from quotaflow.llm.lm_scoring import lm_scores
from quotaflow.llm.mixing import mix_sources
from quotaflow.llm.quality import quality_bands
from quotaflow.llm.token_counts import PrefixCounter, prefix_fit, token_tables
from quotaflow.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(4)
VOCAB = ["".join(rng.choice("abcdeéüñ") for _ in range(rng.randint(1, 6))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + (r.choice([".\n", ",", "", ""]) if r.random() < 0.3 else "") for _ in range(n))


def rows():
    out = [(i, prose(20 + i * 3, i)) for i in range(60)]
    out += [(60, out[3][1]), (61, out[3][1].upper()), (62, out[10][1] + " extra words"), (63, None), (64, ""), (65, " \n\t "),
            (66, "12 345 ..."), (67, prose(20_000, 9)), (68, "same same same " * 40), (None, out[5][1]), (0, out[0][1])]
    return [(i, t, None if k % 9 == 0 else "ab"[k % 2], [None, "x", "y", "z"][k % 4], 1, "clash", "clash", "clash")
            for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def test_mixing_reaches_targets(docs, none):
    got = mix_sources(docs).toPandas()
    sizes = Counter()
    for _, t, _, s, *_ in rows():
        sizes[s] += len(words(t))
    order = [*sorted(x for x in sizes if x), None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= 3 * sizes[s]]
        for s in over or open_:
            target[s] = 3 * sizes[s] if over else left * weight[s] / total
        if not over:
            break
        open_ -= set(over)
        left -= sum(target[s] for s in over)
    assert len(got) == len(rows())
    for s in order:
        mine = got[got.source.isna()] if s is None else got[got.source == s]
        assert np.allclose(mine.target, target[s])
        assert abs(mine.taken.sum() - target[s]) <= 1
    assert (got.taken <= 3 * got["size"]).all()
    assert (got.taken == got["size"] * got.repeats + got.part_words).all()
    again = mix_sources(docs.repartition(5)).toPandas()
    cols = ["doc_id", "size", "taken"]
    assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, again[cols].values.tolist()))
    assert mix_sources(none).count() == 0


def test_language_id_predicts_unseen_rows(spark, none):
    a, b = "the of and to in is that with".split(), "der die und zu ist nicht ein mit".split()
    r = random.Random(2)
    texts = [(i, " ".join(r.choice(a if i % 2 else b) for _ in range(30)), "en" if i % 2 else "de") for i in range(200)]
    texts += [(900, None, "en"), (901, "12 34", "de"), (902, "", None), (None, "the of and", None)]
    got = language_id(spark.createDataFrame(texts, "doc_id long, text string, lang string")).toPandas()
    truth = dict((i, x) for i, _, x in texts)
    assert len(got) == len(texts)
    for row in got.itertuples():
        if row.doc_id in (900, 901, 902):
            assert (row.lang_pred, row.score) == ("und", 0)
        elif row.doc_id == row.doc_id:
            assert row.held_out == (zlib.crc32(str(int(row.doc_id)).encode()) % 4 == 2)
            assert row.lang_pred == truth[row.doc_id] and 0 <= row.score <= 1
    assert language_id(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id(unlabelled).first().lang_pred == "und"


def contaminated_by_hand(text, items, width=13):
    def toks(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    w, hit, ids = toks(text), set(), set()
    for i, t in items:
        b = toks(t)
        n = min(width, len(b))
        windows = {tuple(b[s:s + n]) for s in range(len(b) - n + 1)} if b else set()
        for s in range(len(w) - n + 1):
            if n and tuple(w[s:s + n]) in windows:
                hit.update(range(s, s + n))
                ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_equals_brute_force(spark, docs, none):
    items = [(1, prose(40, 3)), (2, prose(29, 4)[5:160]), (3, VOCAB[0] + " " + VOCAB[1]), (4, "..."), (5, None),
             (6, prose(13, 200)), (6, prose(13, 201)), (7, "same " * 30), (8, "same same same same")]
    more = [(100, prose(5, 50) + " " + prose(13, 200) + " " + prose(13, 200)), (101, prose(13, 201).upper()), (102, prose(12, 201))]
    d = docs.unionByName(spark.createDataFrame([(i, t, *[None] * 6) for i, t in more], SCHEMA))
    got = contamination(d, spark.createDataFrame(items, "item_id long, text string")).toPandas()
    assert got.contaminated.sum() > 2
    for x in got.itertuples():
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == contaminated_by_hand(x.text, items), x.doc_id
    assert contamination(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    clean = contamination(docs, spark.createDataFrame([], "item_id long, text string")).toPandas()
    assert clean.n_hit.sum() == 0 and not clean.contaminated.any()


def test_phrase_and_proximity_search(spark):
    texts = [(1, "a b c a b d a b c"), (2, "b c"), (3, "c x x a"), (4, None)]
    index = positional_index(spark.createDataFrame(texts, "doc_id long, text string"))
    phrases = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b"]), (3, ["z"]), (4, ["a", "a"])], "phrase_id long, terms array<string>")
    assert sorted(map(tuple, phrase_matches(index, phrases).collect())) == [(1, 1, 0), (1, 1, 6), (2, 1, 1), (2, 1, 4), (2, 1, 7), (2, 2, 0)]
    pairs = spark.createDataFrame([(1, "c", "a")], "pair_id long, a string, b string")
    near = sorted(map(tuple, proximity_matches(index, pairs, 3).collect()))
    assert near == [(1, 1, 2, 0), (1, 1, 2, 3), (1, 1, 8, 6), (1, 3, 0, 3)]


def test_quality_measures_and_verdict(docs, none):
    got = quality_bands(docs).toPandas()
    assert len(got) == len(rows())
    for x in got.itertuples():
        w = words(x.text)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        often = Counter(grams)
        hit = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
        lines = [s for s in (x.text or "").split("\n") if words(s)]
        assert (x.n_words, x.word_chars, x.n_repeat_words, x.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert x.n_symbols == sum(c in "#*$%&|<>" for c in x.text or "")
        assert x.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (x.kept and x.base_failed)
    assert not got[got.doc_id == 68].kept.any() and not got[got.text.isna()].kept.any()
    assert quality_bands(none).count() == 0


def test_compression_bands_reject_both_ends(spark):
    r = random.Random(5)
    noise = " ".join("".join(chr(r.randint(33, 126)) for _ in range(20)) for _ in range(900))
    low = " ".join(f"w{i % 7} {i % 11}" for i in range(4000))
    seen = {x.doc_id: x.kept for x in quality_bands(spark.createDataFrame([(1, noise), (2, low), (3, prose(900, 1))], "doc_id long, text string")).collect()}
    assert seen == {1: False, 2: False, 3: True}


def components_by_hand(pairs, width, percent):
    sets = {}
    for i, t in pairs:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, none, width, percent):
    r = random.Random(percent)
    out, base = [(0, None), (1, ""), (2, "a"), (3, "A"), (4, "a b"), (5, "b a")], prose(90, 77).split()
    for i in range(6, 130):
        w = list(base if i % 3 else out[r.randrange(5, len(out))][1].split())
        for _ in range(r.randrange(5)):
            k = r.randrange(len(w) + 1)
            w[k:k + r.randrange(2)] = [r.choice(VOCAB)] * r.randrange(2)
        out.append((i, " ".join(w)))
    df = spark.createDataFrame([*out, (None, out[7][1]), out[8]], "doc_id long, text string").repartition(4)
    got = near_duplicates(df, width, percent).collect()
    assert len(got) == len(out) + 2
    truth = components_by_hand(out, width, percent)
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None
        else:
            assert (x.n_shingles, x.component_id) == truth[x.doc_id], x.doc_id
    assert len({c for _, c in truth.values()}) > 8
    assert near_duplicates(none, width, percent).count() == 0


def test_token_counts_equal_library(spark, docs, none):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    counter = PrefixCounter(path)
    hard = ["don't they'll 'x ''s I'VE", "foo<|endoftext|>bar <|endof <|startoftext|><|endoftext|>", "ΑΣ ΟΔΥΣΣΕΥΣ İ é   x\x1cy\x85z ½²", "日本語 😀👍🏽",
            "aaaaaaaaaaaa", "x" * 900, " a  b ", "<|endoftext|>"]
    for text in hard + [t for _, t, *_ in rows()[:8]]:
        table = counter.table(text)
        assert (table[-1] if len(table) else 0) == len(tok.encode(text, add_special_tokens=False).ids), text
        if "<|" not in text:
            normal = counter.normal(text[:200])
            table = counter.table(text[:200])
            assert list(table) == [len(tok.encode(normal[:i], add_special_tokens=False).ids) for i in range(1, len(normal) + 1)]
            fit = prefix_fit(table, 5)
            assert fit == max([i for i in range(1, len(normal) + 1) if table[i - 1] <= 5], default=0)
    got = token_tables(docs, path, budget=50, keep_table=True).toPandas()
    for x in got.itertuples():
        n = len(tok.encode(x.text or "", add_special_tokens=False).ids)
        table = np.frombuffer(x.prefix_tokens, "<i4")
        assert (x.n_tokens, x.n_bytes, x.over_limit) == (n, len((x.text or "").encode()), n > 50)
        assert (table[-1] if len(table) else 0) == n and x.fit_chars == prefix_fit(table, 50)
    assert token_tables(none, path).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy now and save a lot of money on everything today, this week only.</div><article><h1>Caf&eacute; &amp; bar</h1>
<p><b>First   block
with words</b> that go on for a while, so that the window has text.<br><p>Second.</p><div class="comments"><p>A reader says something long about it all.</p></div>
<p>Third one.</p></article><form><p>Your name</p></form><footer>&copy; somebody</footer></body></html>"""


def test_html_keeps_the_article(spark):
    want = "Café & bar\n\nFirst block with words that go on for a while, so that the window has text.\n\nSecond.\n\nThird one."
    assert main_text(PAGE) == want
    assert main_text(PAGE[: PAGE.index("Second") + 3]).endswith("text.\n\nSec")
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("<div>" * 20_000 + "deep text") == "deep text"
    data = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, None), (None, "v", "", "")]
    got = extract_text(spark.createDataFrame(data, "page_id long, url string, html string, text string")).collect()
    assert sorted((x.page_id or 0, x.text, x.n_chars) for x in got) == [(0, "", 0), (1, want, len(want)), (1, want, len(want)), (2, "", 0)]


def test_toxicity_learns_stems(spark, none):
    r = random.Random(8)
    data, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = [r.choice(VOCAB) for _ in range(40)]
        if bad:
            w[r.randrange(40)] = r.choice(["scoundrel", "knavix", "knavor", "knavum"])
        data.append((i, " ".join(w), "en"))
        labels.append((i, int(bad)))
    data += [(1000, None, None), (1001, "", "en"), (None, "scoundrel", "en")]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity(d, lab).toPandas()
    assert len(got) == len(data) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    truth = dict(labels)
    held = [(x.predicted, truth[x.doc_id]) for x in got.itertuples() if x.held_out and x.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert got[got.doc_id.isin([1000, 1001])].score.nunique() == 1
    assert toxicity(none, lab).count() == 0
    assert toxicity(d, lab.where("toxic = 0")).agg({"score": "max"}).first()[0] == 0


def test_lm_base_score_and_probability(spark, docs, none):
    got = lm_scores(docs).toPandas()
    table = [(i, (t or "").translate({c: c + 32 for c in range(65, 91)})) for i, t, *_ in rows()]
    lines = [(i, [*words(t), " "], zlib.crc32(str("" if i is None else i).encode()) % 10 == 0) for i, t in table]
    count = Counter(w for _, ws, held in lines if not held for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if i is None else i, held, len(ws), sum(count[w] > 0 for w in ws), n,
                   round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws, held in lines)
    have = sorted((-1 if x.doc_id != x.doc_id else int(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6))
                  for x in got.itertuples())
    assert have == want
    assert (got.score < 0).all() and (got.score > got.base_score).mean() > 0.8
    assert lm_scores(none).count() == 0


def test_lm_is_a_distribution(spark):
    """Over the training words and one unknown, a context's probabilities add up to 1."""
    train = [(i, "a b a c") for i in range(1, 40)]
    asked = [(10_000 + k, "a " + w) for k, w in enumerate(["a", "b", "c", "zz"])]
    d = spark.createDataFrame(train + asked, "doc_id long, text string")
    held = {i for i, _ in train + asked if zlib.crc32(str(i).encode()) % 10 == 0}
    got = lm_scores(d).toPandas().set_index("doc_id")
    assert set(got.index[got.held_out]) == held
    assert (got.score <= 0).all()


def test_lines_equal_brute_force(spark, docs, none):
    extra = [(200 + i, f"Shared Line\n{prose(5, i)}\n  shared line \n\n" + ("ÄRGER\n" if i % 2 else "ärger\n"), *[None] * 6) for i in range(14)]
    every = rows() + extra
    d = spark.createDataFrame(every, SCHEMA).repartition(3)
    low = {c: c + 32 for c in range(65, 91)}
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(low)
    for least in (10, 3):
        often = Counter(k for _, t, *_ in every for k in {key(s) for s in (t or "").split("\n")})
        gone = {k for k, c in often.items() if c >= least and k}
        got = drop_frequent_lines(d, least).collect()
        want = [(i, len((t or "").split("\n")), sum(key(s) in gone for s in (t or "").split("\n")),
                 "\n".join(s for s in (t or "").split("\n") if key(s) not in gone)) for i, t, *_ in every]
        assert sorted(map(str, want)) == sorted(str((x.doc_id, x.n_lines, x.n_dropped, x.text)) for x in got)
    assert drop_frequent_lines(none).count() == 0


def test_minimal_perfect_hash_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    counts = np.arange(len(keys)) % 300 + 1
    shard = build_shard(keys, counts, 200)
    assert len(shard["prints"]) == 4 * len(keys) and len(shard["counts"]) == len(keys)
    assert (probe(shard, keys) == np.minimum(counts, 200)).all()
    other = np.setdiff1d(np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64), keys)
    assert (probe(shard, other) > 0).sum() <= 1
    tiny = build_shard(keys[:1], counts[:1], 10)
    assert probe(tiny, keys[:1])[0] == 1
