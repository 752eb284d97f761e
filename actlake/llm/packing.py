"""Lexical retrieval packing of documents into sequences.

Documents are gathered, as their partitions are read, into shards of a bounded number of tokens. Each shard holds a
BM25 inverted index over the token ids of its whole documents. The first document not used up is the seed of a window:
its neighbours, the unused documents that score highest for all terms of the seed, follow until the window of
``window`` tokens is full; where no neighbour is left the next unused document follows. The last document of a window
is cut where the window ends; what remains of it stays in the pool. A shard's last tokens make sequences of powers of
two, so no sequence needs padding.

Every id lies in exactly one piece. Null text is empty: only the closing id. Repeated rows and ids are separate
documents (their pieces carry the same id). An empty table gives an empty result. A task that runs again makes the same
sequences, since a shard depends on nothing but the partition's rows in order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import encoder, vocabulary_path

WINDOW = 2048
END = 1  # the id that closes each document
SHARD_TOKENS = 1 << 21
COMMON = 8  # terms in at least one of so many documents also have a row of weights by document
K1, B = 1.2, 0.75


class Bm25:
    """Inverted index over documents given as arrays of ids."""

    def __init__(self, documents: list[np.ndarray]):
        found = [np.unique(d, return_counts=True) for d in documents]
        lengths = np.array([len(d) for d in documents], dtype=np.float32)
        self.size = len(documents)
        self.starts = np.cumsum([0, *(len(t) for t, _ in found)])
        terms = np.concatenate([t for t, _ in found]) if found else np.array([], np.uint32)
        tf = np.concatenate([c for _, c in found]).astype(np.float32) if found else np.array([], np.float32)
        owner = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(self.starts))
        df = np.bincount(terms, minlength=1)
        idf = np.log1p((self.size - df + 0.5) / (df + 0.5)).astype(np.float32)
        norm = K1 * (1 - B + B * lengths / max(1.0, float(lengths.mean()) if self.size else 1.0))
        self.terms, self.weights = terms, idf[terms] * tf * (K1 + 1) / (tf + norm[owner])
        order = np.argsort(terms, kind="stable")
        self.posting_docs, self.posting_weights = owner[order], self.weights[order]
        self.posting_ends = np.cumsum(df)
        # together at most COMMON times the postings
        common = np.flatnonzero(df * COMMON >= max(self.size, 1))
        self.common_row = np.full(len(df), -1, dtype=np.int32)
        self.common_row[common] = np.arange(len(common))
        self.common = np.zeros((len(common), self.size), dtype=np.float32)
        rows = self.common_row[terms]
        self.common[rows[rows >= 0], owner[rows >= 0]] = self.weights[rows >= 0]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Documents of ``unused`` (flags) that share a term with ``seed``, best first, ties by place."""
        terms = self.terms[self.starts[seed] : self.starts[seed + 1]]
        rows = self.common_row[terms]
        scores = self.common[rows[rows >= 0]].sum(axis=0)
        terms = terms[rows < 0].astype(np.int64)
        ends = self.posting_ends[terms]
        begins = np.where(terms > 0, self.posting_ends[terms - 1], 0)
        spans = [slice(a, b) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        if spans:
            docs = np.concatenate([self.posting_docs[s] for s in spans])
            scores = scores + np.bincount(docs, np.concatenate([self.posting_weights[s] for s in spans]), minlength=self.size)
        scores[~unused] = 0
        scores[seed] = 0
        best = np.flatnonzero(scores)
        return best[np.argsort(-scores[best], kind="stable")]


def pack_shard(documents: list[np.ndarray], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length); all are of ``window`` ids, the last ones of powers of two."""
    lengths = np.array([len(d) for d in documents], dtype=np.int64)
    at = np.zeros(len(documents), dtype=np.int64)
    # documents longer than a window fill windows of their own first
    for d in np.flatnonzero(lengths >= window).tolist():
        while lengths[d] - at[d] >= window:
            yield [(d, int(at[d]), window)]
            at[d] += window
    unused = lengths > at
    index = Bm25(documents)
    next_seed = 0
    while next_seed < len(documents):
        if not unused[next_seed]:
            next_seed += 1
            continue
        sequence, space = [], window

        def take(d: int) -> None:
            nonlocal space
            n = min(space, int(lengths[d] - at[d]))
            sequence.append((d, int(at[d]), n))
            at[d] += n
            space -= n
            unused[d] = at[d] < lengths[d]

        take(next_seed)
        if space:
            for d in index.neighbours(next_seed, unused).tolist():
                take(d)
                if not space:
                    break
        follower = next_seed + 1
        while space and follower < len(documents):
            if unused[follower]:
                take(follower)
            else:
                follower += 1
        if not space:
            yield sequence
            continue
        # the last window of the shard
        held = window - space
        while held:
            want = 1 << (held.bit_length() - 1)
            held -= want
            part = []
            while want:
                d, start, n = sequence.pop(0)
                if n > want:
                    sequence.insert(0, (d, start + want, n - want))
                    n = want
                part.append((d, start, n))
                want -= n
            yield part


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pack ``docs`` (doc_id, text); one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or vocabulary_path()
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).id_bytes
        end = np.array([END], dtype="<u4").tobytes()
        sequence_id = TaskContext.get().partitionId() << 40
        names: list = []
        held: list[np.ndarray] = []
        tokens = 0

        def close(schema: pa.DataType) -> pa.RecordBatch:
            nonlocal sequence_id, tokens
            rows: list[tuple] = []
            for sequence in pack_shard(held, window):
                offset = 0
                for d, start, n in sequence:
                    rows.append((names[d], start, n, zlib.crc32(held[d][start : start + n].tobytes()), len(held[d]), sequence_id, offset))
                    offset += n
                sequence_id += 1
            names.clear()
            held.clear()
            tokens = 0
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], schema), *(pa.array(c, pa.int64()) for c in columns[1:])]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("doc_id").type
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                names.append(name)
                held.append(np.frombuffer(encode(text or "") + end, dtype="<u4"))
                tokens += len(held[-1])
                if tokens >= shard_tokens:
                    yield close(kind)
        if held:
            yield close(kind)

    schema = f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
