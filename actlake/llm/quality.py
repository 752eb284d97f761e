"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded and convolved with learned filters of ``WIDTH`` bytes. The text is read in chunks that overlap by
``WIDTH`` - 1 bytes, so every place of the whole document is covered once; each filter's largest response in a chunk,
and then over all chunks, is what it says about the document. A linear layer over the rectified maxima gives one
probability. Texts shorter than a filter are padded with zero bytes; null texts count as empty.

The network is fitted to a bounded sample of labelled texts: ``SAMPLE`` rows, the first by a hash of the id, of texts up
to ``SAMPLE_CHARS`` characters (longer ones are left out of the fit). Scores use nothing but the text. Without labelled
rows every score is 0.5. Repeated rows and ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 6
FILTERS = 16
EMBEDDED = 8
CHUNK = 2048
SAMPLE = 3000
SAMPLE_CHARS = 20_000
EPOCHS = 10
THRESHOLD = 0.3


@dataclass
class Network:
    """embedding (256, e), filters (WIDTH, e, f), bias (f,), out (f,), out_bias."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def pair_tables(self) -> list[np.ndarray]:
        """For each pair of places in a filter: the filters' responses to each pair of bytes there."""
        single = np.einsum("be,wef->wbf", self.embedding, self.filters).astype(np.float32)
        return [(single[w][:, None, :] + single[w + 1][None, :, :]).reshape(65536, -1) for w in range(0, WIDTH, 2)]


class Scorer:
    def __init__(self, network: Network):
        self.network = network
        self.tables = network.pair_tables()

    def maxima(self, data: bytes, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's largest response over all chunks, and where it is."""
        x = np.frombuffer(data.ljust(WIDTH, b"\0"), dtype=np.uint8).astype(np.int32)
        pairs = x[:-1] * 256 + x[1:]
        count = len(x) - WIDTH + 1
        best = np.full(self.tables[0].shape[1], -np.inf, dtype=np.float32)
        at = np.zeros(len(best), dtype=np.int64)
        for start in range(0, count, CHUNK):
            stop = min(count, start + CHUNK)
            response = self.tables[0].take(pairs[start:stop], axis=0)
            for i, table in enumerate(self.tables[1:], 1):
                response += table.take(pairs[start + 2 * i : stop + 2 * i], axis=0)
            if places:
                where = response.argmax(axis=0)
                top = response[where, np.arange(len(best))]
                at = np.where(top > best, start + where, at)
            else:
                top = response.max(axis=0)
            best = np.maximum(best, top)
        return best, at if places else None

    def score(self, data: bytes) -> float:
        best, _ = self.maxima(data)
        n = self.network
        return float(1 / (1 + np.exp(-(np.maximum(best + n.bias, 0) @ n.out + n.out_bias))))


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit by Adam on the logistic loss; gradients go through the places of the maxima."""
    chance = np.random.default_rng(seed)
    network = Network(chance.normal(0, 0.3, (256, EMBEDDED)), chance.normal(0, 0.3, (WIDTH, EMBEDDED, FILTERS)), np.zeros(FILTERS), chance.normal(0, 0.3, FILTERS), 0.0)
    if not texts:
        network.out[:] = 0
        return network
    y = np.array(labels, dtype=np.float64)
    # both labels weigh alike in the first half of the fit; after that rows weigh as they are
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    parameters = [network.embedding, network.filters, network.bias, network.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters] + [(0.0, 0.0)]
    step = 0
    for epoch in range(epochs):
        order = chance.permutation(len(texts))
        weight = balance if epoch < epochs / 2 else np.ones_like(y)
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            scorer = Scorer(network)
            windows = np.zeros((len(chosen), FILTERS, WIDTH), dtype=np.int64)
            best = np.zeros((len(chosen), FILTERS))
            for i, t in enumerate(chosen):
                best[i], at = scorer.maxima(texts[t], places=True)
                padded = np.frombuffer(texts[t].ljust(WIDTH, b"\0"), dtype=np.uint8)
                windows[i] = padded[at[:, None] + np.arange(WIDTH)]
            hidden = np.maximum(best + network.bias, 0)
            p = 1 / (1 + np.exp(-(hidden @ network.out + network.out_bias)))
            error = (p - y[chosen]) * weight[chosen] / len(chosen)
            back = error[:, None] * network.out * (hidden > 0)
            embedded = network.embedding[windows]  # (documents, f, WIDTH, e)
            to_embedding = np.zeros_like(network.embedding)
            np.add.at(to_embedding, windows, back[:, :, None, None] * network.filters.transpose(2, 0, 1)[None])
            gradients = [to_embedding, np.einsum("df,dfwe->wef", back, embedded), back.sum(axis=0), error @ hidden, error.sum()]
            step += 1
            for i, g in enumerate(gradients):
                m, v = moments[i]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                moments[i] = (m, v)
                change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                if i < 4:
                    parameters[i] -= change
                else:
                    network.out_bias -= float(change)
    return network


def held_out() -> Column:
    """Whether a document's label must not be learned from (null ids count as the text 'null')."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Network:
    """Fit to the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) marks and that are not held out."""
    marks = labels.filter(F.col("quality").isNotNull() & ~held_out()).select("doc_id", "quality")
    marks = marks.withColumn("place", F.md5(F.concat(F.lit("quality"), F.col("doc_id").cast("string"))))
    # three times as many marks as texts are wanted, since some may have no fitting text; a bounded number
    marks = marks.orderBy("place", "quality").limit(3 * sample)
    texts = docs.filter(F.col("text").isNotNull() & (F.char_length("text") <= chars)).select("doc_id", "text")
    # which marks are in the sample is found without the texts, so that no others reach the driver
    first = texts.select("doc_id").join(F.broadcast(marks), "doc_id").orderBy("place", "quality").limit(sample)
    marks = marks.join(F.broadcast(first.select("doc_id", "quality").distinct()), ["doc_id", "quality"], "left_semi")
    found = texts.join(F.broadcast(marks), "doc_id").orderBy("place", "quality", "text").limit(sample).collect()
    return train([r["text"].encode() for r in found], [r["quality"] for r in found])


_SCORERS: dict[int, Scorer] = {}


def _scorer(network: Network) -> Scorer:
    """One scorer in a process for a network: its tables take a few megabytes."""
    key = hash(network.embedding.tobytes())
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(network)
    return _SCORERS[key]


def score_documents(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(network).score
        for batch in batches:
            scores = [score((t or "").encode()) for t in batch.column("text").to_pylist()]
            columns = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(network).score
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            yield batch.filter(pa.array([score((t or "").encode()) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
