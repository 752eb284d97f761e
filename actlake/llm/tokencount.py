"""Token counts by prefix dynamic programming.

A byte-level BPE encodes each pre-token alone. For a pre-token, the encoding of every prefix ends in one token: the one
whose pair with the last token of what stands before it BPE would leave apart. So the counts of all prefixes follow
from left to right (``PrefixCounter.counts``). They are stored for each pre-token, and a text's count at any place is the sum over the pre-tokens before it
plus one such entry (``PrefixTable``). The counts answer "how many tokens up to here" and "where do n tokens end" without encoding again.

Null text counts as empty: 0 bytes, 0 tokens. Special strings inside texts are one token, as the library's default has
it. Whole texts of any length are counted; repeated rows and ids are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import LATIN_1, encoder, vocabulary_path

LIMIT = 1024
PAIRS = 1_000_000  # pairs of tokens of which a worker remembers whether BPE leaves them apart
CACHED = 600_000  # pre-tokens whose counts a worker remembers
CACHED_CHARS = 48  # longer ones are counted each time; of these no count exceeds a byte
_COUNTERS: dict[str, "PrefixCounter"] = {}


class _Stored(dict):
    """The counts of every prefix of a pre-token, computed when first asked for; short ones take a byte a prefix."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> bytes | list[int]:
        found = self.counter.counts(piece.encode())
        if len(piece) > CACHED_CHARS:
            return found
        if len(self) >= CACHED:
            self.clear()
        self[piece] = bytes(found)
        return self[piece]


class PrefixCounter:
    def __init__(self, path: str):
        import regex

        self.encoder = encoder(path)
        self.ranks = self.encoder.ranks
        # all ends of tokens: what is not among them cannot be the end of a longer token
        self.suffixes = {t[i:]: -1 for t in self.ranks for i in range(1, len(t))} | self.ranks
        self.split_any = regex.compile(self.encoder.pattern).findall
        self.split_latin = re.compile(LATIN_1).findall
        self.special = regex.compile("|".join(map(regex.escape, self.encoder.special))) if self.encoder.special else None
        self.stored = _Stored(self)
        self._pairs: dict[int, bool] = {}

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text; Latin-1 texts by the standard library's faster expressions."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    def apart(self, left: bytes, right: bytes) -> bool:
        """Whether BPE on left + right, two tokens, ends in these two."""
        pair = self.encoder.fast._encode_single_piece(left + right)
        return len(pair) == 2 and pair[0] == self.ranks[left]

    def counts(self, piece: bytes) -> list[int]:
        """Tokens of every prefix of a pre-token, from the empty one to the whole."""
        suffixes, pairs = self.suffixes, self._pairs
        counts = [0]
        last = [(0, -1)]  # where the last token of each prefix begins, and its rank
        for stop in range(1, len(piece) + 1):
            candidates = []
            for start in range(stop - 1, -1, -1):
                rank = suffixes.get(piece[start:stop])
                if rank is None:
                    break
                if rank >= 0:
                    candidates.append((start, rank))
            for start, rank in reversed(candidates):  # the longest first
                if start:
                    begin, before = last[start]
                    key = before << 20 | rank
                    apart = pairs.get(key)
                    if apart is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        apart = pairs[key] = self.apart(piece[begin:start], piece[start:stop])
                    if not apart:
                        continue
                counts.append(counts[start] + 1)
                last.append((start, rank))
                break
        return counts

    def total(self, text: str) -> int:
        """Tokens of a text: the last stored count of each of its pre-tokens."""
        stored = self.stored
        if self.special is None or not any(s in text for s in self.encoder.special):
            return sum([stored[p][-1] for p in self.split(text)])
        parts = self.special.split(text)
        return len(parts) - 1 + sum([stored[q][-1] for p in parts for q in self.split(p)])

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """Token counts of every prefix of a text, as the library would encode the prefix alone.

    ``at[n]`` is the count of the first n characters: the counts of the pre-tokens before, and the stored count of the part of the
    last one. Only where the cut changes how the text is split is the end of the prefix split and counted again: inside a
    special string or a contraction, and after a blank that white space before it would then take in.
    """

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        special = set(counter.encoder.special)
        pieces: list[str] = []
        at = 0
        for found in counter.special.finditer(text) if counter.special else ():
            pieces += [*counter.split(text[at : found.start()]), found[0]]
            at = found.end()
        pieces += counter.split(text[at:])
        self.at = np.zeros(len(text) + 1, dtype=np.int64)
        place, tokens = 0, 0  # where a piece begins, and the tokens of the pieces before it
        before, start, earlier = "", 0, 0  # the same of the piece before
        for piece in pieces:
            size, again = len(piece), range(0)
            if piece in special:
                count, again = 1, range(1, size)
            else:
                counts = counter.stored[piece]
                ends = range(1, size + 1) if piece.isascii() else np.cumsum([len(c.encode()) for c in piece]).tolist()
                self.at[place + 1 : place + size + 1] = [tokens + counts[e] for e in ends]
                count = counts[-1]
                if piece[0] == "'":
                    again = range(1, size)
                elif before and piece[0].isspace() and before[-1].isspace():
                    again = range(1, 2)
            self.at[place + size] = tokens + count
            for n in again:
                self.at[place + n] = earlier + counter.total(text[start : place + n])
            before, start, earlier = piece, place, tokens
            place, tokens = place + size, tokens + count

    @property
    def tokens(self) -> int:
        return int(self.at[-1])

    def count(self, chars: int) -> int:
        """Tokens of the text's first ``chars`` characters."""
        return int(self.at[max(0, min(chars, len(self.text)))])

    def truncate(self, budget: int) -> int:
        """The most characters whose encoding has at most ``budget`` tokens."""
        return int(np.flatnonzero(self.at <= budget)[-1]) if budget >= 0 else 0


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def _map_texts(docs: DataFrame, kind: type, schema: str, make) -> DataFrame:
    """doc_id and n_bytes of every row, with the columns that ``make`` gives for its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            columns = make(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, *columns.values()], ["doc_id", "n_bytes", *columns])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, {schema}")


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row of ``docs`` (doc_id, text)."""
    path = path or vocabulary_path()

    def make(texts: list[str]) -> dict[str, pa.Array]:
        total = counter(path).total
        found = [total(t) for t in texts]
        return {"n_tokens": pa.array(found, pa.int64()), "over_limit": pa.array([n > limit for n in found], pa.bool_())}

    return _map_texts(docs, docs.schema["doc_id"].dataType.simpleString(), "n_tokens long, over_limit boolean", make)


def prefix_tables(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The stored form: doc_id, n_bytes and counts: tokens of the text's first 0, 1, 2, ... characters."""
    path = path or vocabulary_path()
    make = lambda texts: {"counts": pa.array([counter(path).table(t).at.tolist() for t in texts], pa.list_(pa.int64()))}
    return _map_texts(docs, docs.schema["doc_id"].dataType.simpleString(), "counts array<long>", make)


def truncate_documents(docs: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes and ``kept``: the most characters of each text that make at most ``budget`` tokens."""
    path = path or vocabulary_path()
    make = lambda texts: {"kept": pa.array([counter(path).table(t).truncate(budget) for t in texts], pa.int64())}
    return _map_texts(docs, docs.schema["doc_id"].dataType.simpleString(), "kept long", make)
