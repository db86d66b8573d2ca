"""BPE encoding by tree concatenation, and decoding.

A text that is longer than a leaf is halved, its halves are encoded apart, and
the two encodings are joined: a window around the seam is encoded anew and
grows on both sides until it ends, left and right, where the halves' own
encodings have the same ends. Beyond those places the halves' tokens stand.

Encoding is scanning (a text is cut into pieces, the tokenizer's pattern) and
merging (a piece becomes tokens). Both joins are exact:

* pieces: the scan from a piece's start depends on nothing before it, and a
  piece of the left half that ends MARGIN characters before the seam is not
  changed by what follows. The window's scan starts at such a place; from the
  first end it shares with the right half's scan, both go on alike.
* tokens: in a piece that crosses the seam and is too long to encode anew, the
  window is of tokens. If its encoding starts with the left half's token and
  ends with the right half's, every pair of neighbours in the result is one
  that some encoding left as it is, which makes it the encoding of the whole.

Halves of texts over ``spread`` characters are rows of their own, encoded by
any task, and come together by document for the joins near the root; shorter
texts are encoded where they are.

Special strings inside texts are single tokens and part the text, as the
library does by default. Defined results: null and empty texts have no tokens
and decode to an empty text; equal rows are encoded alike; an empty table gives
no rows; a text of any length is encoded whole; input columns with the name of
a result column are replaced. Null and unknown ids decode to nothing; bytes
that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.llm.common import widened, without, worker_cache, written
from quotaflow.llm.token_counts import byte_symbols

# The tokenizer's word pattern (fixed value) for texts whose characters are all
# classed alike by Python, and for classed text, where every letter beyond ASCII
# is an "a", digit a "0", white space a tab, anything else a "!".
WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
LIKE = {"a": re.compile(r"[^\W\d_]"), "0": re.compile(r"\d"), "\t": re.compile(r"\s"), "!": re.compile(r"[^\s\w]|_")}
MARGIN = 3  # characters of the longest fixed alternative of the pattern
LEAF = 2048  # characters encoded in one go
SPREAD = 65_536  # characters encoded in one task
MEMO = 150_000  # pieces in each of the two generations that a worker remembers

ROWS = 256  # texts in each batch that a worker returns

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Classes(dict):
    """Code point -> class character; the library itself is asked once for each.
    ``alike`` are the characters that Python's patterns class as the library does."""

    def __init__(self, pieces) -> None:
        self.pieces = pieces
        self.alike: set[str] = set()
        self.met: set[str] = set()

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = next((k for k in "a0\t" if len(self.pieces(k + c)) == 1), "!")
        self[code] = c if code < 128 else kind
        if LIKE[kind].match(c):
            self.alike.add(c)
        return self[code]

    def all_alike(self, text: str) -> bool:
        """Whether Python's patterns class all characters of ``text`` as the library does."""
        found = set(text)
        if not found <= self.alike:
            for c in found - self.met:
                self.met.add(c)
                self[ord(c)]
        return found <= self.alike


class Node:
    """The exact encoding of text[start:end]: where its pieces end, and their
    tokens (the bytes of their ids)."""

    __slots__ = ("start", "end", "ends", "ids")

    def __init__(self, start: int, end: int, ends: list[int], ids: list[bytes]) -> None:
        self.start, self.end, self.ends, self.ids = start, end, ends, ids


Find = Callable[[str], list[str]]  # cuts a (classed) text into pieces


def packed(ids) -> bytes:
    return array("i", ids).tobytes()


def unpacked(ids: bytes) -> array:
    return array("i", ids)


class Decoder:
    """Bytes of each token of a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {s: b for b, s in enumerate(byte_symbols())}

        def raw(token: str) -> bytes:
            return bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode("utf-8")

        tokens = {i: raw(t) for t, i in spec["model"]["vocab"].items()}
        tokens |= {a["id"]: raw(a["content"]) for a in spec["added_tokens"]}
        listed = [tokens.get(i, b"") for i in range(max(tokens) + 2)]  # the last stands for unknown ids
        self.bytes = np.frombuffer(b"".join(listed), np.uint8)
        self.sizes = np.array([len(x) for x in listed], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of several id lists, given one after the other."""
        ids = np.where((ids >= 0) & (ids < len(self.sizes)), ids, len(self.sizes) - 1)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        raw = self.bytes[at].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids) -> str:
        known = np.array([-1 if i is None else i for i in ids], np.int64)
        return self.decode_all(known, np.array([len(known)]))[0]


class TreeEncoder:
    """Encoder for one byte-level tokenizer file."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) for a in spec["added_tokens"])
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or not plain:
            raise ValueError("the tokenizer file must be byte-level BPE with the usual word pattern and plain special strings")
        tokenizer = Tokenizer.from_file(path)
        self.leaf = max(leaf, 2 * MARGIN)
        self.model = tokenizer.model
        self.classes = Classes(tokenizer.pre_tokenizer.pre_tokenize_str)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.parts = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        self.symbols = byte_symbols()
        self.token = {i: t for t, i in spec["model"]["vocab"].items()}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # -- merging ------------------------------------------------------------
    def merge(self, symbols: str) -> list[int]:
        return [t.id for t in self.model.tokenize(symbols)]

    def piece(self, text: str) -> bytes:
        """Tokens of one piece; those of up to a leaf are remembered."""
        got = self.memo.get(text)
        if got is None:
            got = self.older.get(text)
            if got is None:
                got = packed(self.merge("".join(map(self.symbols.__getitem__, text.encode("utf-8")))))
            if len(text) <= self.leaf:
                if len(self.memo) >= MEMO:
                    self.older, self.memo = self.memo, {}
                self.memo[text] = got
        return got

    def join_tokens(self, left: bytes, right: bytes) -> bytes:
        """Tokens of one piece from those of its two parts."""
        k, wide = 4, array("i").itemsize
        while True:
            a, b = unpacked(left[max(len(left) - k * wide, 0):]), unpacked(right[:k * wide])
            window = self.merge("".join([self.token[i] for i in (*a, *b)]))
            if (k * wide >= len(left) or window[0] == a[0]) and (k * wide >= len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a) * wide] + packed(window) + right[len(b) * wide:]
            k *= 2

    # -- scanning and joining -----------------------------------------------
    def view(self, text: str) -> tuple[str, Find]:
        """What is scanned in place of ``text``, and how it is cut into pieces."""
        if self.classes.all_alike(text):
            return text, WORDS.findall
        return text.translate(self.classes), PIECES.findall

    def scan(self, kinds: str, find: Find, start: int, end: int) -> list[int]:
        """Ends of the pieces of text[start:end] as a text of its own."""
        return list(accumulate(map(len, find(kinds[start:end])), initial=start))[1:]

    def leaf_node(self, text: str, kinds: str, find: Find, start: int, end: int) -> Node:
        words = find(kinds[start:end])
        ends = list(accumulate(map(len, words), initial=start))
        if kinds is not text:
            words = map(text.__getitem__, map(slice, ends, ends[1:]))
        get, piece = self.memo.get, self.piece  # a turned memo is still right
        return Node(start, end, ends[1:], [get(w) or piece(w) for w in words])

    def tree(self, text: str, kinds: str, find: Find, start: int, end: int) -> Node:
        if end - start <= self.leaf:
            return self.leaf_node(text, kinds, find, start, end)
        middle = (start + end) // 2
        return self.join(text, kinds, find, self.tree(text, kinds, find, start, middle), self.tree(text, kinds, find, middle, end))

    def join(self, text: str, kinds: str, find: Find, left: Node, right: Node) -> Node:
        """The encoding of two neighbouring stretches from those of each."""
        if not left.ends or not right.ends:
            return left if left.ends else right
        seam = left.end
        sure = bisect_right(left.ends, seam - MARGIN)  # these pieces of the left stay
        anchor = left.ends[sure - 1] if sure else left.start
        grow = 2
        while True:
            first = max(sure - grow, 0)
            begin = left.ends[first - 1] if first else left.start
            stop = right.ends[min(grow, len(right.ends)) - 1]
            window = self.scan(kinds, find, begin, stop)
            agrees = window[: sure - first] == left.ends[first:sure]
            limit = stop if stop == right.end else stop - MARGIN
            ends = window[sure - first:]
            for n, e in enumerate(ends if agrees else ()):
                if e > limit:
                    break
                if e == seam:
                    return self.joined(text, left, right, sure, anchor, ends[: n + 1], 0)
                if e > seam:
                    at = bisect_left(right.ends, e)
                    if at < len(right.ends) and right.ends[at] == e:
                        return self.joined(text, left, right, sure, anchor, ends[: n + 1], at + 1)
            grow *= 2

    def joined(self, text: str, left: Node, right: Node, sure: int, anchor: int, ends: list[int], used: int) -> Node:
        """left's first ``sure`` pieces, the pieces from ``anchor`` to each of
        ``ends``, and right's pieces but the first ``used``."""
        out_ends, out_ids = left.ends[:sure], left.ids[:sure]
        for e in ends:
            if anchor < left.end < e and e - anchor > self.leaf:
                ids = self.join_tokens(self.part(text, left, anchor, left.end), self.part(text, right, left.end, e))
            elif e - anchor > self.leaf:
                ids = self.part(text, left if e <= left.end else right, anchor, e)
            else:
                ids = self.piece(text[anchor:e])
            out_ends.append(e)
            out_ids.append(ids)
            anchor = e
        return Node(left.start, right.end, out_ends + right.ends[used:], out_ids + right.ids[used:])

    def part(self, text: str, node: Node, start: int, end: int) -> bytes:
        """Tokens of a stretch of one piece, from the node if a piece of its own there."""
        at = bisect_left(node.ends, end)
        if at < len(node.ends) and node.ends[at] == end and (node.ends[at - 1] if at else node.start) == start:
            return node.ids[at]
        return self.piece(text[start:end])

    # -- whole texts ----------------------------------------------------------
    def split(self, text: str) -> list[str]:
        """Plain parts at even places, special strings at odd ones."""
        return self.parts.split(text) if self.parts and any(s in text for s in self.special) else [text]

    def encode_packed(self, text: str) -> bytes:
        out: list[bytes] = []
        for k, part in enumerate(self.split(text)):
            if k % 2:
                out.append(packed([self.special[part]]))
            elif part:
                out += self.tree(part, *self.view(part), 0, len(part)).ids
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return unpacked(self.encode_packed(text)).tolist()

    # -- long texts over several rows ----------------------------------------
    def segments(self, text: str, size: int) -> list[tuple[int, int, str]]:
        """(part, place in the part, text) rows that make up ``text``."""
        return [(k, i, part if k % 2 else part[i:i + size]) for k, part in enumerate(self.split(text))
                for i in (range(1) if k % 2 else range(0, len(part), size))]

    def segment(self, part: int, text: str) -> tuple[list[int], list[int], bytes]:
        """(ends, bytes of ids by piece, ids) of one row."""
        if part % 2:
            ids = packed([self.special[text]])
            return [len(text)], [len(ids)], ids
        node = self.tree(text, *self.view(text), 0, len(text))
        return node.ends, [len(x) for x in node.ids], b"".join(node.ids)

    def assemble(self, rows: list[tuple[int, int, str, list[int], list[int], bytes]]) -> bytes:
        """Ids of a document from (part, place, text, *segment) of all its rows."""
        out: list[bytes] = []
        by_part: dict[int, list] = {}
        for row in sorted(rows, key=lambda r: r[:2]):
            by_part.setdefault(row[0], []).append(row)
        for part, found in by_part.items():
            if part % 2:
                out.append(found[0][5])
                continue
            text = "".join([r[2] for r in found])
            kinds, find = self.view(text)
            level = []
            for _, at, own, ends, sizes, ids in found:
                cuts = list(accumulate(sizes, initial=0))
                level.append(Node(at, at + len(own), [at + e for e in ends], [ids[a:b] for a, b in zip(cuts, cuts[1:])]))
            while len(level) > 1:
                level = [self.join(text, kinds, find, *level[k:k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
            out += level[0].ids
        return b"".join(out)


def id_lists(rows: list[bytes]) -> pa.ListArray:
    """An Arrow list of ids for each packed list."""
    ends = np.cumsum([0, *map(len, rows)]) // array("i").itemsize
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def sliced(batches):
    """The batches in parts of ROWS rows, so that a worker holds few at once."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def encode_texts(docs: DataFrame, path: str, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """``docs`` (text, ...) with ids (array<int>) and n_tokens."""
    docs = without(docs, "ids", "n_tokens")
    schema = widened(docs, ("ids", "array<int>"))

    def encode(batches):
        encoder = worker_cache(("bpe_tree", path, leaf), lambda: TreeEncoder(path, leaf))
        for b in sliced(batches):
            ids = [encoder.encode_packed(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, id_lists(ids)], [*b.schema.names, "ids"])

    size = F.coalesce(F.char_length("text"), F.lit(0))
    short = docs.where(size <= spread).mapInArrow(encode, schema)
    # Long texts: one row each under a key that the written table fixes.
    key = next(f"key{n or ''}" for n in range(len(docs.columns) + 1) if f"key{n or ''}" not in {c.lower() for c in docs.columns})
    long = written(docs.where(size > spread).withColumn(key, F.monotonically_increasing_id()), "bpe-long")
    fields = "long_key long, part int, place int, text string"

    def cut(batches):
        encoder = worker_cache(("bpe_tree", path, leaf), lambda: TreeEncoder(path, leaf))
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = encoder.segments(text, spread)
                for at in range(0, len(rows), 256):
                    part = rows[at:at + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(part), pa.int64()), pa.array([r[0] for r in part], pa.int32()),
                         pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part])],
                        ["long_key", "part", "place", "text"])

    def encode_rows(batches):
        encoder = worker_cache(("bpe_tree", path, leaf), lambda: TreeEncoder(path, leaf))
        lists = pa.list_(pa.int32())
        for b in batches:
            found = [encoder.segment(p, t) for p, t in zip(b.column("part").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array([f[i] for f in found], kind) for i, kind in enumerate((lists, lists, pa.binary()))]],
                ["long_key", "part", "place", "text", "ends", "sizes", "ids"])

    def assemble(table: pa.Table) -> pa.Table:
        encoder = worker_cache(("bpe_tree", path, leaf), lambda: TreeEncoder(path, leaf))
        cols = [table.column(c).to_pylist() for c in ("part", "place", "text", "ends", "sizes", "ids")]
        ids = id_lists([encoder.assemble(list(zip(*cols)))])
        return pa.table({"long_key": pa.array([table.column("long_key")[0].as_py()], pa.int64()), "ids": ids})

    cuts = long.select(key, "text").mapInArrow(cut, fields).repartition("long_key", "part", "place")
    encoded = cuts.mapInArrow(encode_rows, fields + ", ends array<int>, sizes array<int>, ids binary")
    whole = encoded.groupBy("long_key").applyInArrow(assemble, "long_key long, ids array<int>")
    joined = long.join(whole, F.col(key) == F.col("long_key")).select(*docs.columns, "ids")
    return short.unionByName(joined).withColumn("n_tokens", F.size("ids").cast("long"))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (ids, ...) with decoded, the text of the ids (null: empty)."""
    encoded = without(encoded, "decoded")

    def decode(batches):
        decoder = worker_cache(("bpe_decoder", path), lambda: Decoder(path))
        for b in sliced(batches):
            ids = b.column("ids")
            texts = decoder.decode_all(ids.flatten().fill_null(-1).to_numpy(), ids.value_lengths().fill_null(0).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(decode, widened(encoded, ("decoded", "string")))
