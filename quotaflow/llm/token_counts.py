"""Exact token counts at every prefix by dynamic programming.

For byte-pair encoding two facts give the counts of all prefixes in one walk:
an encoding is right if and only if each pair of neighbours is what the merges
make of the pair alone, and the encoding of a prefix is that of a shorter
prefix plus one last token. So

    open[i]   = tokens of w[:i] as the start of a longer word
    closed[i] = tokens of w[:i] as a whole word (last token ends in the suffix)

both come from ``open[j]`` and the one vocabulary entry w[j:i] that may follow
the last token of w[:j]. Whether two tokens may be neighbours is found by
merging just those two and is remembered.

A text is split at white space; the counts of a chunk's prefixes are worked out
once and kept by chunk, and the text's table is the running sum of chunk counts
plus the counts inside the chunk. From the table, ``prefix_fit`` answers which
prefix fits a budget with no further encoding.

Positions are code points of the normalized text (the tokenizer's own
normalizer: NFC, white space to one space, lower case), special strings taken
as they are and counted as one token, as the library does by default.

Defined results: null and empty texts have 0 tokens; equal rows count alike; an
empty table gives no rows; any length is counted whole; input columns with the
name of a result column are replaced.
"""

from __future__ import annotations

import json
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotaflow.llm.common import widened, without

# The word pattern of the tokenizer file, its classes cut to ASCII (fixed value).
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+", re.ASCII)
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
CACHE = 250_000  # chunks in each of the two generations that a worker remembers
PREFIXES = 600_000  # word prefixes that it remembers
LONG = 240  # symbols; longer words and chunks are not remembered
SMALL = [bytes([i]) for i in range(LONG + 1)]

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class PrefixCounter:
    """Counts for one tokenizer file with word-end suffix and byte-level words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = set(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.longest = max(map(len, self.vocab))
        tokenizer = Tokenizer.from_file(path)
        self.normalize = tokenizer.normalizer.normalize_str
        self.pieces_of = tokenizer.pre_tokenizer.pre_tokenize_str
        special = [a["content"] for a in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.symbols = byte_symbols()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.last_merge: dict[str, tuple[str, str, int] | None] = {}
        self.opened: dict[str, tuple[str, int]] = {}
        self.closed: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # -- one word -----------------------------------------------------------
    def split(self, token: str) -> list[str]:
        """A token's first symbols: characters, the last with the suffix."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def halves(self, token: str) -> tuple[str, str, int] | None:
        """The last merge that makes ``token`` from its symbols and its rank;
        None for a first symbol."""
        if token in self.last_merge:
            return self.last_merge[token]
        parts, pair = self.split(token), None
        while len(parts) > 1:  # tokens are short
            rank, i = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            pair = (parts[i], parts[i + 1], rank)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        self.last_merge[token] = pair
        return pair

    def neighbours(self, a: str, b: str) -> bool:
        """Whether encoding leaves token ``a`` before token ``b`` as they are.

        Undoes the merges at the seam, latest first. The two symbols that then
        meet would have been merged if their rank comes before the merge that
        took either away; of equal pairs the left one goes first.
        """
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PREFIXES:
                self.pairs.clear()
            known = self.pairs[key] = self.seam_holds(a, b)
        return known

    def seam_holds(self, a: str, b: str) -> bool:
        gone_a = gone_b = 1 << 60
        while True:
            rank = self.rank.get((a, b))
            if rank is not None and rank < gone_a and rank <= gone_b:
                return False
            ha, hb = self.halves(a), self.halves(b)
            if ha is None and hb is None:
                return True
            if hb is None or (ha is not None and ha[2] > hb[2]):
                gone_a, a = ha[2], ha[1]
            else:
                gone_b, b = hb[2], hb[0]

    def alone(self, token: str) -> bool:
        """Whether encoding a token's own symbols yields the token."""
        return len(self.split(token)) == 1 or "".join(self.halves(token)[:2] if self.halves(token) else ()) == token

    def extend(self, word: str) -> int:
        """closed[n] for ``word``; all its shorter prefixes must be in
        ``opened``, where the word's own open state goes."""
        vocab, opened, suffix = self.vocab, self.opened, self.suffix
        open_, closed = None, 0
        for j in range(len(word) - 1, -1, -1):
            token = word[j:]
            whole = token + suffix
            if j:
                before, n = opened[word[:j]]
                if not closed and whole in vocab and self.neighbours(before, whole):
                    closed = n + 1
                if open_ is None and token in vocab and self.neighbours(before, token):
                    open_ = (token, n + 1)
            else:
                if not closed and whole in vocab and self.alone(whole):
                    closed = 1
                if open_ is None and token in vocab and self.alone(token):
                    open_ = (token, 1)
            if closed and open_:
                opened[word] = open_
                return closed
        raise ValueError(f"no encoding of {word!r}")

    def word_prefixes(self, word: str) -> bytes | list[int]:
        """closed[1..n] for one word of byte symbols. Those of up to LONG
        symbols are kept, as many words start alike."""
        if len(word) > LONG:
            return self.long_word(word)
        known = self.closed
        i = len(word)
        while i and word[:i] not in known:
            i -= 1
        if i == len(word):
            return known[word]
        if len(known) > PREFIXES:
            known.clear()
            self.opened.clear()
            i = 0
        table = known[word[:i]] if i else b""
        for n in range(i + 1, len(word) + 1):
            prefix = word[:n]
            table += SMALL[self.extend(prefix)]
            known[prefix] = table
        return table

    def long_word(self, word: str) -> list[int]:
        """closed[1..n] for one word of any length, its open states (last
        token, count) in a list by position; nothing is kept of it."""
        vocab, suffix = self.vocab, self.suffix
        opened: list[tuple[str, int]] = []
        out = []
        for i in range(1, len(word) + 1):
            open_, closed = None, 0
            for j in range(i - 1, max(i - self.longest, 0) - 1, -1):
                token = word[j:i]
                whole = token + suffix
                before, n = opened[j - 1] if j else ("", 0)
                if not closed and whole in vocab and (self.neighbours(before, whole) if j else self.alone(whole)):
                    closed = n + 1
                if open_ is None and token in vocab and (self.neighbours(before, token) if j else self.alone(token)):
                    open_ = (token, n + 1)
                if closed and open_:
                    break
            else:
                raise ValueError(f"no encoding of {word[max(i - self.longest, 0):i]!r}")
            opened.append(open_)
            out.append(closed)
        return out

    # -- one chunk between white space -------------------------------------
    def pieces(self, chunk: str) -> list[tuple[str, int, int]]:
        """(byte symbols, start, end) of the chunk's words."""
        if chunk.isascii() and chunk.isprintable():  # the tokenizer's pattern, for ASCII
            return [(m[0], m.start(), m.end()) for m in ASCII_WORDS.finditer(chunk)]
        if chunk.isalpha() and max(chunk) < "\u0250":
            return [("".join(map(self.symbols.__getitem__, chunk.encode("utf-8"))), 0, len(chunk))]
        return [(p, a, b) for p, (a, b) in self.pieces_of(chunk)]

    def chunk_count(self, chunk: str) -> int:
        return sum(self.word_prefixes(p)[-1] for p, _, _ in self.pieces(chunk))

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """Tokens of chunk[:1], chunk[:2], ... each as a text of its own."""
        out, before = [], 0
        for piece, a, b in self.pieces(chunk):
            closed = self.word_prefixes(piece)
            if piece in CONTRACTIONS:  # cut short, its quote is a word of its own
                quote = self.word_prefixes("'")[-1]
                closed = [quote, *(quote + n for n in self.word_prefixes(piece[1:])[:-1]), closed[-1]]
            if len(piece) == b - a:
                out += closed if not before else [before + n for n in closed]
            else:  # only where a character ends
                at = 0
                for c in chunk[a:b]:
                    at += len(c.encode("utf-8"))
                    out.append(before + closed[at - 1])
            before += closed[-1]
        return out

    def chunk(self, chunk: str) -> bytes:
        """The table of a chunk of up to LONG / 4 characters, a byte a count,
        remembered. Chunks not met for long are forgotten."""
        got = self.older.get(chunk)
        if got is None:
            got = bytes(self.chunk_prefixes(chunk))
        if len(self.chunks) >= CACHE:
            self.older, self.chunks = self.chunks, {}
        self.chunks[chunk] = got
        return got

    # -- one text -----------------------------------------------------------
    def normal(self, text: str) -> str:
        if not text.isascii() or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.normalize(text)
        return " " * text[:1].isspace() + " ".join(text.lower().split()) + " " * (text[-1:].isspace() and not text.isspace())

    def table(self, text: str) -> np.ndarray:
        """Token count of every prefix, by code point of the normalized text."""
        if self.special is None or "<|" not in text:
            return self.plain_table(self.normal(text))
        parts, base = [], 0
        before = ""  # the open chunk that ends where the special string starts
        for k, part in enumerate(self.special.split(text)):
            if k % 2 == 0:
                part = self.normal(part)
                parts.append(base + self.plain_table(part))
                before = part.rsplit(" ", 1)[-1]
            else:
                start = int(parts[-1][-1]) if len(parts[-1]) else base
                head = start - (self.chunk_count(before) if before else 0)
                inner = [head + self.chunk_count((before + part[:i]).lower()) for i in range(1, len(part))]
                parts.append(np.array([*inner, start + 1], np.int32))
                before = ""
            if len(parts[-1]):
                base = int(parts[-1][-1])
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def plain_table(self, text: str) -> np.ndarray:
        if not text.strip(" "):
            return np.zeros(len(text), np.int32)
        chunks = text.split(" ")
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        if lengths.max() * 4 <= LONG:  # a character has 4 tokens at most
            get = self.chunks.get
            found = [get(c) or (self.chunk(c) if c else b"") for c in chunks]
            inside = np.frombuffer(b"".join(found), np.uint8).astype(np.int32)
        else:
            inside = np.array([n for c in chunks if c for n in self.chunk_prefixes(c)], np.int32)
        ends = np.cumsum(lengths)
        counts = np.where(lengths > 0, inside[ends - 1], 0)
        after = np.cumsum(counts, dtype=np.int32)
        # Each chunk is followed by a space, which leaves the count as it is.
        out = np.repeat(after, lengths + 1)[: len(text)]
        at = np.repeat(np.arange(len(chunks)), lengths) + np.arange(len(inside))
        out[at] = np.repeat(after - counts, lengths) + inside
        return out


def prefix_fit(table: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of ``budget`` tokens at most."""
    fits = np.flatnonzero(table <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_tables(docs: DataFrame, path: str, budget: int = 2048, keep_table: bool = False) -> DataFrame:
    """``docs`` (text, ...) with n_bytes, n_tokens, over_limit, fit_chars (the
    longest prefix of ``budget`` tokens, in code points of the normalized text)
    and, if ``keep_table``, prefix_tokens (little-endian int32 by prefix)."""
    docs = without(docs, "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_tokens")
    schema = widened(docs, ("n_tokens", "long"), ("fit_chars", "long"), *([("prefix_tokens", "binary")] if keep_table else []))

    def count(batches):
        counter = shared_counter(path)
        for b in batches:
            tables = (counter.table(t or "") for t in b.column("text").to_pylist())
            rows = [(int(t[-1]) if len(t) else 0, prefix_fit(t, budget), t.astype("<i4").tobytes() if keep_table else None)
                    for t in tables]
            arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())]
            names = ["n_tokens", "fit_chars"]
            if keep_table:
                arrays.append(pa.array([r[2] for r in rows], pa.binary()))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*b.schema.names, *names])

    d = docs.mapInArrow(count, schema)
    return d.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn(
        "over_limit", F.col("n_tokens") > budget)


def shared_counter(path: str) -> PrefixCounter:
    """One counter a worker process, so that later tasks find its chunks."""
    import builtins

    held = builtins.__dict__.setdefault("_prefix_counters", {})
    if path not in held:
        held[path] = PrefixCounter(path)
    return held[path]
