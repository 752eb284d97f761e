"""Scores by an interpolated modified Kneser-Ney n-gram model.

A text's tokens are its words (A-Z lower-cased) and one end. The model is counted in Spark from all training documents, those whose
id's checksum is not 0 modulo 10, without pruning, and stored as sorted arrays in the shared folder, which the workers
of the scoring job map into memory:

* words: 64-bit hashes in ascending order, cut into shards by their highest bits, with each word's count and the number of
  different words before it. A word's number is its place in these arrays.
* n-grams of each order from 2 up: the hash of the n-gram's word numbers, ascending within a shard, and its count. That is
  the number of occurrences for the highest order and the number of different words before it for lower ones.
* contexts of each order: hash, total of the counts that follow, and the weight of the next lower order.

The probability of a word after a context is (count - discount) / total + weight * probability after the context without
its first word, down to the words' own probabilities, whose weight is shared evenly by all words and one unknown word.
Discounts for counts of 1, 2 and 3 or more come from the counts of counts of each order; where these do not give
discounts between 0 and the count (small tables) they are 0.5, 1 and 1.5. Texts begin with order - 1 begin marks, which
are context only.

Tasks count words and n-grams of some million tokens at a time before anything is shuffled, so a frequent one is one row of each such part.
N-grams are dealt by their context, except where a context is frequent enough to fill a shard: those are dealt by the
whole n-gram, and the context's parts are added up after. Every table is written before it is used again, so a lost
executor costs what it was working on. Memory-mapped files need a shared folder that is mounted on every worker.

N-grams are told apart by 64-bit hashes. Null texts are empty: one token, the end. Null ids are training documents.
Repeated rows count and are scored as often as they occur. Without training documents all probabilities are 1 (score 0).
Long texts are read whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_path, written
from .jaccard import _LETTER, _SPACE, _mixed, _powers, _texts

ORDER = 2
PART_TOKENS = 1 << 20  # tokens that a task counts before it hands the counts on
SCORED_TOKENS = 1 << 19  # tokens looked up at a time
PIECE_BYTES = 1 << 22  # of text made into tokens at a time
SHARD = 1 << 20  # entries of an array
ROWS = 1 << 16  # of a batch that a task hands on
FALLBACK = (0.5, 1.0, 1.5)
_U = np.uint64
_END = 0x9D5C_F0A1_73B6_2E48  # hash of the end


def held_out() -> Column:
    """Whether a document must not be learned from (null ids count as the text 'null')."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 10 == 0


# ---------------------------------------------------------------- tokens


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts (UTF-8 bytes, one after the other, at ``offsets``) and where each text's begin."""
    up, down = _powers(len(data))
    solid = ~_SPACE[data]
    inner = np.zeros(len(data), dtype=bool)  # a word goes on from the byte before
    inner[1:] = solid[1:] & solid[:-1]
    inner[offsets[:-1][np.diff(offsets) > 0] - offsets[0]] = False
    starts = np.flatnonzero(solid & ~inner)
    after = np.ones(len(data), dtype=bool)
    after[:-1] = ~inner[1:]
    ends = np.flatnonzero(solid & after) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * up, out=sums[1:])
    words = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, offsets - offsets[0])
    return np.insert(words, bounds[1:], _U(_END)), bounds + np.arange(len(bounds))


def _tokens(column: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``token_hashes`` of a column's texts, about ``most`` tokens (or one text) at a time."""
    data, offsets = _texts(column)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, start = 0, 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + PIECE_BYTES, side="right")) - 1)
        stop = min(stop, len(column))
        found = token_hashes(data[offsets[start] : offsets[stop]], offsets[start : stop + 1])
        if held and size + len(found[0]) > most:
            yield _joined(held)
            held, size = [], 0
        held.append(found)
        size += len(found[0])
        start = stop
    if held:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    bounds, at = [np.zeros(1, np.int64)], 0
    for tokens, own in held:
        bounds.append(own[1:] + at)
        at += len(tokens)
    return np.concatenate([t for t, _ in held]), np.concatenate(bounds)


# ---------------------------------------------------------------- stored arrays


def _save(folder: str, shard: int, arrays: dict[str, np.ndarray]) -> None:
    """Write a shard's arrays; a repeated task replaces them by equal ones."""
    os.makedirs(folder, exist_ok=True)
    for name, values in arrays.items():
        draft = f"{folder}/_{uuid.uuid4().hex}.npy"
        np.save(draft, values)
        os.replace(draft, f"{folder}/{shard}-{name}.npy")


def _smallest(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


class Arrays:
    """The stored arrays of a folder, mapped into memory when first read."""

    def __init__(self, folder: str):
        self.folder = folder
        self.mapped: dict[tuple[int, str], np.ndarray] = {}

    def get(self, shard: int, name: str) -> np.ndarray:
        if (shard, name) not in self.mapped:
            path = f"{self.folder}/{shard}-{name}.npy"
            # a shard to which nothing belongs has no file
            self.mapped[shard, name] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros(0, np.uint64)
        return self.mapped[shard, name]

    def find(self, keys: np.ndarray, shards: np.ndarray, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The places of ``keys`` (ascending within a shard) in their shards, -1 for absent ones, and the values there."""
        places = np.full(len(keys), -1, dtype=np.int64)
        values = [np.zeros(len(keys), dtype=np.float64) for _ in names]
        order = np.argsort(shards, kind="stable")
        at = np.flatnonzero(np.diff(shards[order], prepend=-1)) if len(keys) else []
        for begin, end in zip(at, [*at[1:], len(keys)], strict=True):
            rows = order[begin:end]
            shard = int(shards[rows[0]])
            stored = self.get(shard, "key")
            if not len(stored):
                continue
            wanted = keys[rows]
            found = np.minimum(np.searchsorted(stored, wanted), len(stored) - 1)
            hit = stored[found] == wanted
            rows, found = rows[hit], found[hit]
            places[rows] = found
            for value, name in zip(values, names, strict=True):
                value[rows] = self.get(shard, name)[found]
        return places, values


_MAPPED: dict[str, Arrays] = {}


def arrays(folder: str) -> Arrays:
    if folder not in _MAPPED:
        # a worker that goes on with another model lets go of the one before
        if any(os.path.dirname(f) != os.path.dirname(folder) for f in _MAPPED):
            _MAPPED.clear()
        _MAPPED[folder] = Arrays(folder)
    return _MAPPED[folder]


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, ROWS):
        yield batch.slice(start, ROWS)


def _top(keys: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each key: its highest bits."""
    return (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _bits(entries: int) -> int:
    return max(0, (entries // SHARD)).bit_length()


# ---------------------------------------------------------------- model


@dataclass
class Level:
    order: int
    grams: str  # folders
    contexts: str
    shards: int
    context_bits: int
    discounts: tuple[float, float, float]


@dataclass
class Model:
    words: str  # folder
    bits: int  # of the words' shards
    offsets: np.ndarray  # number of the first word of each shard
    vocabulary: int
    tokens: int
    texts: int
    hot: float  # a context whose words all are more frequent is dealt by whole n-grams
    base: tuple[float, float, float, float]  # discounts of words, total of their counts
    weight: float  # of the unknown word and its like
    levels: list[Level]

    @property
    def begin(self) -> int:
        return self.vocabulary

    def numbers(self, hashes: np.ndarray, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Word numbers of ascending hashes, the one after the begin mark's for unknown words, and stored values."""
        shards = _top(hashes, self.bits)
        places, values = arrays(self.words).find(hashes, shards, names)
        return np.where(places < 0, self.vocabulary + 1, places + self.offsets[shards]).astype(np.uint32), values

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """How often words occur, by number; the begin mark once a text."""
        out = np.where(numbers == self.begin, self.texts, 0).astype(np.float64)
        known = np.flatnonzero(numbers < self.vocabulary)
        shards = np.searchsorted(self.offsets, numbers[known], side="right") - 1
        for shard in np.unique(shards):
            rows = known[shards == shard]
            out[rows] = arrays(self.words).get(int(shard), "count")[numbers[rows] - self.offsets[shard]]
        return out

    def keys(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams' contexts and of the n-grams whose word numbers are ``words``."""
        key = _mixed(words[0].astype(np.uint64) + _U(len(words)))
        for column in words[1:-1]:
            key = _mixed(key + column.astype(np.uint64))
        return key, _mixed(key + words[-1].astype(np.uint64) * _U(0x9E3779B97F4A7C15))

    def places(self, words: list[np.ndarray], context: np.ndarray, gram: np.ndarray, shards: int) -> np.ndarray:
        """The shard of each n-gram."""
        rarest = self.counts(words[0])
        for column in words[1:-1]:
            rarest = np.minimum(rarest, self.counts(column))
        dealt = np.where(rarest > self.hot, gram, context)
        return (((dealt >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """Discounts of n-grams counted once, twice and more often, from the numbers of n-grams counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = counts
    if not min(counts):
        return FALLBACK
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return found if all(0 <= d <= i + 1 for i, d in enumerate(found)) else FALLBACK


def _discounted(counts: np.ndarray, by: tuple[float, ...]) -> np.ndarray:
    return counts - np.array([0.0, *by[:3]])[np.minimum(counts, 3).astype(np.int64)]


def _unique_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First places of the different rows of word numbers, in ascending order of rows, and how often each occurs."""
    key = columns[0].astype(np.uint64)
    for column in columns[1:-1]:
        key = np.unique(key << _U(32) | column, return_inverse=True)[1].astype(np.uint64)
    if len(columns) > 1:
        key = key << _U(32) | columns[-1]
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return first, counts


def _counted_tokens(rows: DataFrame) -> DataFrame:
    """h, n: the training tokens' hashes, counted by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["h", "n"])

        for batch in batches:
            for tokens, _ in _tokens(batch.column("text"), PART_TOKENS):
                held.append(tokens)
                size += len(tokens)
                if size >= PART_TOKENS:
                    yield from _cut(counted())
                    held, size = [], 0
        if size:
            yield from _cut(counted())

    return rows.select("text").mapInArrow(run, "h long, n long")


def _shard_writer(folder: str, names: list[str], make: Callable[[list[np.ndarray]], dict[str, np.ndarray]]) -> Callable:
    """A task's work: save each shard of rows (shard, then ``names``; sorted by shard), ``make`` giving its arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, columns in _by_shard(batches, names):
            found = make(columns)
            _save(folder, shard, found)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(columns[0])], pa.int64())], ["shard", "rows"])

    return run


def _by_shard(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    at, held = -1, []
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = np.flatnonzero(np.diff(shards, prepend=-1)) if len(shards) else []
        for begin, end in zip(cuts, [*cuts[1:], len(shards)], strict=True):
            if shards[begin] != at and held:
                yield at, [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            at = int(shards[begin])
            held.append([batch.column(n).to_numpy()[begin:end] for n in names])
    if held:
        yield at, [np.concatenate(c) for c in zip(*held, strict=True)]


def _stored(rows: DataFrame, run: Callable) -> list[tuple[int, int]]:
    """Write the shards of ``rows``; (shard, entries) of each. The list has one entry for each million rows."""
    placed = rows.repartition("shard").sortWithinPartitions("shard")
    done = written(placed.mapInArrow(run, "shard int, rows long"), "llm-lm-shards")
    return sorted((r["shard"], r["rows"]) for r in done.collect())


def _top_column(name: str, bits: int) -> Column:
    return (F.shiftrightunsigned(name, 64 - bits) if bits else F.lit(0)).cast("int").alias("shard")


def _mounted(path: str) -> str:
    path = re.sub("^file:/+", "/", path)
    if "://" in path or not path.startswith("/"):
        raise ValueError(f"{path}: arrays are mapped into memory; name a folder in spark.checkpoint.dir that is mounted on all workers")
    return path


def _fit_words(rows: DataFrame, folder: str, texts: int) -> Model:
    words = written(_counted_tokens(rows).groupBy("h").agg(F.sum("n").alias("n")), "llm-lm-words")
    total = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()
    if total["v"] >= (1 << 32) - 2:
        raise ValueError("words are numbered by 32 bits")
    bits = _bits(total["v"])

    def make(columns: list[np.ndarray]) -> dict[str, np.ndarray]:
        keys = columns[0].view(np.uint64)
        order = np.argsort(keys)
        return {"key": keys[order], "count": _smallest(columns[1][order])}

    sizes = np.zeros(1 << bits, dtype=np.int64)
    for shard, entries in _stored(words.select(_top_column("h", bits), "h", "n"), _shard_writer(f"{folder}/words", ["h", "n"], make)):
        sizes[shard] = entries
    return Model(f"{folder}/words", bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), total["v"], total["n"], texts, np.inf, (*FALLBACK, 0.0), 1.0, [])


def _padded(tokens: np.ndarray, bounds: np.ndarray, begin: int, order: int) -> list[np.ndarray]:
    """The word numbers of the n-gram that ends at each token, as columns."""
    lengths = np.diff(bounds)
    space = np.full(len(tokens) + (order - 1) * len(lengths), begin, dtype=np.uint32)
    at = np.arange(len(tokens)) + (order - 1) * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    space[at] = tokens
    return [space[at - back] for back in range(order - 1, -1, -1)]


def _word_names(order: int) -> list[str]:
    return [f"w{i}" for i in range(1, order + 1)]


def _as_ints(columns: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(c.astype(np.uint32).view(np.int32)) for c in columns]


def _counted_grams(rows: DataFrame, model: Model, order: int, shards: int) -> DataFrame:
    """shard, w1, ..., c: the training texts' n-grams, counted by part."""
    names = ["shard", *_word_names(order), "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            tokens, bounds = _joined(held)
            hashes, inverse = np.unique(tokens, return_inverse=True)
            words = _padded(model.numbers(hashes, [])[0][inverse], bounds, model.begin, order)
            first, counts = _unique_rows(words)
            words = [w[first] for w in words]
            return _placed(model, words, counts, shards, names)

        for batch in batches:
            for found in _tokens(batch.column("text"), PART_TOKENS):
                held.append(found)
                size += len(found[0])
                if size >= PART_TOKENS:
                    yield from _cut(counted())
                    held, size = [], 0
        if size:
            yield from _cut(counted())

    return rows.select("text").mapInArrow(run, ", ".join(f"{n} int" for n in names))


def _placed(model: Model, words: list[np.ndarray], counts: np.ndarray, shards: int, names: list[str]) -> pa.RecordBatch:
    place = model.places(words, *model.keys(words), shards)
    order = np.argsort(place, kind="stable")
    return pa.RecordBatch.from_arrays([pa.array(place[order].astype(np.int32)), *_as_ints([w[order] for w in words]), pa.array(counts[order].astype(np.int32))], names)


def _placed_grams(grams: DataFrame, model: Model, order: int, shards: int) -> DataFrame:
    """shard, w1, ..., c of n-grams (w1, ..., c)."""
    names = _word_names(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = [batch.column(n).to_numpy().view(np.uint32) for n in names]
                place = model.places(words, *model.keys(words), shards)
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), *[batch.column(n) for n in names], batch.column("c")], ["shard", *names, "c"])

    return grams.mapInArrow(run, f"shard int, {', '.join(f'{n} int' for n in names)}, c long")


_NUMBERS = ["a", "b", "c", "d", "e"]


def _fit_level(grams: DataFrame, model: Model, order: int, shards: int, folder: str) -> tuple[Level, DataFrame]:
    """Store the n-grams (shard, w1, ..., c) of an order; also the n-grams of the next lower order with their counts."""
    names, lower = _word_names(order), _word_names(order - 1)
    path = f"{folder}/grams-{order}"
    schema = f"kind int, key long, {', '.join(f'{n} int' for n in lower)}, {', '.join(f'{n} long' for n in _NUMBERS)}"

    def rows(kind: int, size: int, key: np.ndarray | None, words: list[np.ndarray] | None, numbers: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array(np.full(size, kind, np.int32)), pa.nulls(size, pa.int64()) if key is None else pa.array(key.view(np.int64))]
        columns += [pa.nulls(size, pa.int32())] * len(lower) if words is None else _as_ints(words)
        columns += [pa.array(np.asarray(n, dtype=np.int64)) for n in numbers] + [pa.nulls(size, pa.int64())] * (len(_NUMBERS) - len(numbers))
        return pa.RecordBatch.from_arrays(columns, ["kind", "key", *lower, *_NUMBERS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, columns in _by_shard(batches, [*names, "c"]):
            words, counts = [c.view(np.uint32) for c in columns[:-1]], columns[-1].astype(np.int64)
            context, gram = model.keys(words)
            by = np.argsort(gram)
            _save(path, shard, {"key": gram[by], "count": _smallest(counts[by])})
            yield rows(0, 1, None, None, [[shard], *[[int((counts == i).sum())] for i in (1, 2, 3, 4)]])
            found, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, counts, len(found))
            kinds = [np.bincount(inverse[pick], minlength=len(found)) for pick in (counts == 1, counts == 2, counts > 2)]
            yield from _cut(rows(1, len(found), found, None, [total, *kinds]))
            first, before = _unique_rows(words[1:])
            yield from _cut(rows(2, len(first), None, [w[first] for w in words[1:]], [before]))

    placed = grams.sortWithinPartitions("shard")
    parts = written(placed.mapInArrow(run, schema), f"llm-lm-level-{order}")
    summary = parts.filter("kind = 0").agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in _NUMBERS[1:]]).head()
    level = Level(order, path, f"{folder}/contexts-{order}", shards, 0, discounts(list(summary)))
    contexts = parts.filter("kind = 1").groupBy("key").agg(*[F.sum(n).alias(n) for n in _NUMBERS[:4]])
    level.context_bits = _bits(parts.filter("kind = 1").count())
    d1, d2, d3 = level.discounts

    def make(columns: list[np.ndarray]) -> dict[str, np.ndarray]:
        keys = columns[0].view(np.uint64)
        by = np.argsort(keys)
        total, once, twice, more = [c[by].astype(np.float64) for c in columns[1:]]
        return {"key": keys[by], "total": total, "weight": (d1 * once + d2 * twice + d3 * more) / total}

    columns = ["key", *_NUMBERS[:4]]
    _stored(contexts.select(_top_column("key", level.context_bits), *columns), _shard_writer(level.contexts, columns, make))
    suffixes = parts.filter("kind = 2").groupBy(*lower).agg(F.sum("a").alias("c"))
    return level, suffixes


def _fit_base(words: DataFrame, model: Model, folder: str) -> None:
    """Store how many different words stand before each word (w1, c)."""
    words = written(words, "llm-lm-base")
    found = words.agg(F.coalesce(F.sum("c"), F.lit(0)), *[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)], F.count_if(F.col("c") > 2)).head()
    total, counts, more = found[0], list(found[1:5]), found[5]
    d = discounts(counts)
    model.base = (*d, float(total))
    model.weight = (d[0] * counts[0] + d[1] * counts[1] + d[2] * more) / total
    number = F.col("w1").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    offsets = F.array(*[F.lit(int(o)) for o in model.offsets])
    shard = F.size(F.filter(offsets, lambda o: o <= number)) - 1 if len(model.offsets) > 1 else F.lit(0)

    def make(columns: list[np.ndarray]) -> dict[str, np.ndarray]:
        return {"before": _smallest(columns[1][np.argsort(columns[0])])}

    _stored(words.select(shard.cast("int").alias("shard"), number.alias("w"), "c"), _shard_writer(model.words, ["w", "c"], make))


def fit_model(docs: DataFrame, order: int = ORDER) -> Model:
    """Count and store a model of the documents (doc_id, text) that are not held out."""
    if order < 2:
        raise ValueError("an n-gram model takes an order of 2 or more")
    spark = docs.sparkSession
    rows = docs.filter(~held_out()).select("text")
    folder = _mounted(shared_path(spark, "llm-lm"))
    model = _fit_words(rows, folder, rows.count())
    if not model.tokens:
        return model
    shards = model.tokens // SHARD + 1
    model.hot = model.tokens / shards / 4
    grams = _counted_grams(rows, model, order, shards).repartition(shards, "shard").groupBy("shard", *_word_names(order)).agg(F.sum("c").alias("c"))
    for n in range(order, 1, -1):
        level, lower = _fit_level(grams, model, n, shards, folder)
        model.levels.insert(0, level)
        if n > 2:
            grams = _placed_grams(lower, model, n - 1, shards).repartition(shards, "shard")
    _fit_base(lower, model, folder)
    return model


# ---------------------------------------------------------------- scores


def token_probabilities(model: Model, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model's probability of each token after those before it in its text, and how often the token was learned."""
    hashes, inverse = np.unique(tokens, return_inverse=True)
    if not model.tokens:
        return np.ones(len(tokens)), np.zeros(len(tokens))
    numbers, (counts, before) = model.numbers(hashes, ["count", "before"])
    total = model.base[3]
    p = (_discounted(before, model.base) / total + model.weight / (model.vocabulary + 1))[inverse]
    numbers = numbers[inverse]
    longest = _padded(numbers, bounds, model.begin, model.levels[-1].order)
    for level in model.levels:
        words = longest[-level.order :]
        first, back = _first_of(words)
        words = [w[first] for w in words]
        context, gram = model.keys(words)
        keys, at = np.unique(context, return_inverse=True)
        _, (sums, weights) = arrays(level.contexts).find(keys, _top(keys, level.context_bits), ["total", "weight"])
        sums, weights = sums[at], weights[at]
        known = np.flatnonzero(sums)
        known = known[np.argsort(gram[known])]
        _, (found,) = arrays(level.grams).find(gram[known], model.places([w[known] for w in words], context[known], gram[known], level.shards), ["count"])
        share, weight = np.zeros(len(first)), np.ones(len(first))
        share[known] = _discounted(found, level.discounts) / sums[known]
        weight[known] = weights[known]
        p = share[back] + weight[back] * p
    return p, counts[inverse]


def _first_of(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First places of the different rows, and which of them each row equals."""
    key = columns[0].astype(np.uint64)
    for column in columns[1:-1]:
        key = np.unique(key << _U(32) | column, return_inverse=True)[1].astype(np.uint64)
    _, first, inverse = np.unique(key << _U(32) | columns[-1], return_index=True, return_inverse=True)
    return first, inverse


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found: list[list[np.ndarray]] = []
            for tokens, bounds in _tokens(batch.column("text"), SCORED_TOKENS):
                p, counts = token_probabilities(model, tokens, bounds)
                base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
                starts = bounds[:-1]
                found.append([np.diff(bounds), np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)])
            size, known, base, score = [np.concatenate(c) for c in zip(*found, strict=True)]
            columns = [size, known, np.full(len(size), model.tokens, np.int64), base, score, 10 ** (-score / size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *map(pa.array, columns)], names)

    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score_corpus(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Fit to the documents that are not held out and score all (see ``score_documents``)."""
    return score_documents(docs, fit_model(docs, order))
