"""N-gram Jaccard self-join with PartEnum signatures.

A document's set holds its distinct shingles of 3 words, or as many as asked for (as 64-bit hashes). Sets are put into bands of similar size. For a
band, the threshold bounds how many elements two similar sets can differ in: k. PartEnum splits the domain of shingles
at random into n1 parts and each of these into n2; sets that differ in at most k = 2 * n1 - 1 elements differ in at
most one within some part, so they agree on n2 - 1 of its n2 sub-parts. Each set therefore gets, for each part and each
subset of n2 - 1 sub-parts, a signature: the hash of its elements there. Similar sets share at least one. A set near
the lower end of its band also gets the signatures of the band below. Where a set has no element in a subset, that
agreement would say nothing: it gets instead, under that subset's name, the signatures of a fresh partition, so that
no bucket gathers all sets without elements somewhere. Below PERCENT sub-parts hold few elements and many are empty,
so a fresh partition for each would be too many: there are spare parts instead. With ``spare`` parts more than needed,
similar sets agree in ``spare`` + 1 parts at least, so a set with empty subsets in no more than ``spare`` parts leaves
them out; one with more gets one fresh partition for all of them.

Equal sets are one node from the start. Sets that share a signature are candidates and are compared exactly. Large
groups of near copies share their signatures, and all their pairs would be a square: as only components are wanted,
each bucket compares its members with a few pivots first (the smallest id, then 16, then 4096 of them, and so on), and
from then on only pairs that are still in different components and whose odd sketches (each element flips one of 512
bits) do not differ in more bits than linked sets differ in elements, which rules out pairs without their sets. When
every member of each bucket that still has two components has been a pivot, no link between components is left.

Rows with null, empty or wordless text have an empty set, link with nothing and are their own component. Rows that
repeat an id and text are one node; ids are taken to be unique otherwise (of texts under one id some may be linked). Rows with null id take part only through a row with an id and the same set; without one their
component is null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, written
from .components import connected_components, partial_components

SHINGLE_WORDS = 3
PERCENT = 90
BAND = 1.4  # largest size of a band over its smallest
FINE = 12  # bands of smaller differences have three sub-parts in a part, others two
FRESH = 8  # fresh partitions one after the other, where there are spare parts
PIVOTS, MORE = 16, 256  # members of a bucket that are pivots at first; times as many in each round after
BATCH_BYTES = 1 << 20
SKETCH = 8  # 64-bit numbers of a sketch

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = np.random.default_rng(20).integers(1, 2**64, 256, dtype=np.uint64)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < count:
        size = max(count, BATCH_BYTES)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:count], _POWERS["down"][:count]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, length: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``length`` words; a text of fewer words is one shingle.

    Texts are UTF-8 bytes, one after the other, at ``offsets``.
    """
    up, down = _powers(len(data))
    solid = ~_SPACE[data]
    inner = np.zeros(len(data), dtype=bool)  # a word goes on from the byte before
    inner[1:] = solid[1:] & solid[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0] - offsets[0]
    inner[firsts] = False
    starts = np.flatnonzero(solid & ~inner)
    after = np.ones(len(data), dtype=bool)
    after[:-1] = ~inner[1:]
    ends = np.flatnonzero(solid & after) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * up, out=sums[1:])
    words = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, offsets - offsets[0])
    count = max(len(words) - length + 1, 0)
    runs = _mixed(words[:count])
    for i in range(1, length):
        runs = _mixed(runs + words[i : i + count])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= length:
            out.append(np.unique(runs[a : b - length + 1]))
        else:
            short = words[a : min(a + 1, b)]
            for i in range(a + 1, b):
                short = _mixed(short) + words[i : i + 1]
            out.append(_mixed(short + _U(b - a)))
    return out


def bands(percent: int = PERCENT) -> Iterator[tuple[int, int, int]]:
    """(smallest size, largest size, largest difference) of each band.

    Sets of fewer elements than percent / (100 - percent) only link when equal, but for one that just misses it.
    """
    low = percent // (100 - percent)
    while True:
        high = max(low, int(low * BAND))
        partner = high * 100 // percent
        yield low, high, (high + partner) * (100 - percent) // (100 + percent)
        low = high + 1


_BANDS: dict[int, tuple[Iterator, list]] = {}


def _bands_of(size: int, percent: int) -> list[tuple[int, int]]:
    """(band, largest difference) of the bands whose signatures a set of this size gets."""
    source, found = _BANDS.setdefault(percent, (bands(percent), []))
    while not found or found[-1][1] < size:
        found.append(next(source))
    number = next(i for i, b in enumerate(found) if size <= b[1])
    if size < found[0][0]:
        return []
    out = [(number, found[number][2])]
    if number and size * percent <= found[number - 1][1] * 100:
        out.append((number - 1, found[number - 1][2]))
    return out


def part_enum(elements: np.ndarray, difference: int, name: int, sub_parts: int, depth: int = 0) -> np.ndarray:
    """Signatures of a set under the partition called ``name`` for sets that differ in up to ``difference`` elements."""
    parts = difference // 2 + 1
    count = parts * sub_parts
    salted = _mixed(elements ^ _mixed(np.array([name + 1], dtype=np.uint64)))
    where = (((salted >> _U(32)) * _U(count)) >> _U(32)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    held = np.bincount(where, minlength=count)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(salted)[order], dtype=np.uint64)])
    ends = np.cumsum(held)
    of = (sums[ends] - sums[ends - held]).reshape(parts, sub_parts)
    held = held.reshape(parts, sub_parts)
    out = []
    for subset in combinations(range(sub_parts), sub_parts - 1):
        tag = _mixed((np.arange(parts, dtype=np.uint64) * _U(8) + _U(subset[0] * 3 + subset[-1])) + _mixed(np.array([name + 7], dtype=np.uint64)))
        value = tag
        for sub in subset:
            value = _mixed(value + of[:, sub])
        empty = held[:, list(subset)].sum(axis=1) == 0
        if depth < 3 and empty.any():
            out += [part_enum(elements, difference, int(t) >> 2, sub_parts, depth + 1) for t in tag[empty]]
            value = value[~empty]
        out.append(value)
    return np.concatenate(out)


_SPARE: dict[tuple[int, int], int] = {}


def spare_parts(size: int, difference: int, sub_parts: int) -> int:
    """Parts more than needed that best exceed the number in which a set of ``size`` elements has an empty subset."""
    if (size, difference) not in _SPARE:
        needed = difference // 2 + 1
        spare = np.arange(1, needed + 1)
        subsets = (needed + spare) * sub_parts
        empty = subsets * np.exp(-size * (sub_parts - 1) / subsets)
        _SPARE[size, difference] = int(spare[((spare - empty) / np.sqrt(empty)).argmax()])
    return _SPARE[size, difference]


def spared_part_enum(elements: np.ndarray, difference: int, name: int, sub_parts: int, spare: int, depth: int = 0) -> np.ndarray:
    """Signatures as ``part_enum`` gives them, with ``spare`` parts more in place of fresh partitions for single subsets."""
    parts = difference // 2 + 1 + spare
    count = parts * sub_parts
    salted = _mixed(elements ^ _mixed(np.array([name + 1], dtype=np.uint64)))
    where = (((salted >> _U(32)) * _U(count)) >> _U(32)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    held = np.bincount(where, minlength=count)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(salted)[order], dtype=np.uint64)])
    ends = np.cumsum(held)
    of = (sums[ends] - sums[ends - held]).reshape(parts, sub_parts)
    held = held.reshape(parts, sub_parts)
    # subset i of a part is all of its sub-parts but i
    number = np.arange(count, dtype=np.uint64).reshape(parts, sub_parts)
    tag = _mixed(number + _mixed(np.array([name + 7], dtype=np.uint64)))
    value = _mixed(tag + of.sum(axis=1, keepdims=True, dtype=np.uint64) - of)
    empty = held.sum(axis=1, keepdims=True) == held
    if depth == FRESH:
        return value.ravel()
    out = value[~empty]
    if empty.any(axis=1).sum() <= spare:
        return out
    fresh = int(_mixed(np.array([name + 13], dtype=np.uint64))[0]) >> 2
    return np.concatenate([out, spared_part_enum(elements, difference, fresh, sub_parts, spare, depth + 1)])


def signatures(elements: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All signatures of a set, as signed 64-bit numbers."""
    found = []
    for band, k in _bands_of(len(elements), percent):
        if percent < PERCENT and k >= FINE:
            spare = spare_parts(_BANDS[percent][1][band][0], k, 2)
            found.append(spared_part_enum(elements, k, band, 2, spare))
        else:
            found.append(part_enum(elements, k, band, 3 if k < FINE else 2))
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), offsets


def _sets(column: pa.Array, length: int) -> Iterator[np.ndarray]:
    """The sets of a column's texts, about a megabyte of text at a time."""
    data, offsets = _texts(column)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BATCH_BYTES, side="right")) - 1)
        stop = min(stop, len(column))
        yield from shingle_sets(data[offsets[start] : offsets[stop]], offsets[start : stop + 1], length)
        start = stop


def _long_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def odd_sketch(elements: np.ndarray) -> np.ndarray:
    """SKETCH numbers: bit i is set where an odd number of elements falls on i."""
    bits = _mixed(elements + _U(99)) >> _U(64 - 9)
    odd = (np.bincount(bits.astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


SKETCHES = [f"s{i}" for i in range(SKETCH)]


def long_sketch(elements: np.ndarray) -> list[int] | None:
    """An odd sketch with at least as many bits as elements, for sets with more elements than ``odd_sketch`` has bits."""
    if len(elements) <= 64 * SKETCH:
        return None
    size = 1 << (len(elements) - 1).bit_length()
    bits = _mixed(elements + _U(99)) & _U(size - 1)
    return np.packbits((np.bincount(bits.astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _apart(a: Column, b: Column) -> Column:
    """In how many bits two long sketches differ; the longer one is folded to the length of the other."""

    def folded(x: Column, to: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(to), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    differ = F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(differ, F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))


def with_sets(docs: DataFrame, length: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128-bit hash of the set), s0, ... (its odd sketch), bits (the long one) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bits = [], []
            for elements in _sets(batch.column("text"), length):
                bits.append(long_sketch(elements))
                a, b = (int(_mixed(x).sum(dtype=np.uint64).view(np.int64)) for x in (elements, elements + _U(12345)))
                rows.append((len(elements), a, b, *odd_sketch(elements).tolist()))
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * (3 + SKETCH)
            columns.append(pa.array(bits, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "n_shingles", "set_a", "set_b", *SKETCHES, "bits"])

    schema = "doc_id long, n_shingles long, set_a long, set_b long, " + ", ".join(f"{s} long" for s in SKETCHES) + ", bits array<long>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def with_signatures(docs: DataFrame, percent: int = PERCENT, length: int = SHINGLE_WORDS) -> DataFrame:
    """node and sigs of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [signatures(elements, percent) for elements in _sets(batch.column("text"), length)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), _long_lists(sigs)], ["node", "sigs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "node long, sigs array<long>")


def element_sets(docs: DataFrame, length: int = SHINGLE_WORDS) -> DataFrame:
    """node and elements: the sets of ``docs`` (doc_id, text) as arrays of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _long_lists(list(_sets(batch.column("text"), length)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), sets], ["node", "elements"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "node long, elements array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets (node, elements) have a Jaccard similarity of at least ``percent`` in a hundred."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    sizes = F.size("of_a") + F.size("of_b")
    fits = (F.least(F.size("of_a"), F.size("of_b")) * 100 >= F.greatest(F.size("of_a"), F.size("of_b")) * percent) & (common * 100 >= (sizes - common) * percent)
    return pairs.join(left, "a").join(right, "b").filter(fits).select("a", "b")


def _compared(pairs: DataFrame, bits: DataFrame, docs: DataFrame, percent: int, length: int) -> DataFrame:
    """The pairs (a, b) that link, written. Only texts of pairs that long sketches (node, size, bits) don't rule out are read again."""
    left, right = (bits.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("bits").alias(f"bits_{side}")) for side in "ab")
    far = _apart(F.col("bits_a"), F.col("bits_b")) * (100 + percent) > (F.col("size_a") + F.col("size_b")) * (100 - percent)
    pairs = pairs.join(left, "a", "left").join(right, "b", "left").filter(~F.coalesce(far, F.lit(False))).select("a", "b")
    pairs = written(pairs, "llm-pairs")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "llm-wanted")
    sets = written(element_sets(docs.join(wanted, "doc_id", "left_semi"), length), "llm-elements")
    links = written(verified(pairs, sets, percent), "llm-links")
    for table in (pairs, wanted, sets):
        discard(table)
    return links


def _plausible(size: Column, other_size: Column, bits: list[tuple[Column, Column]], percent: int) -> Column:
    """Whether two sets may link, by their sizes and odd sketches."""
    sizes = F.least(size, other_size) * 100 >= F.greatest(size, other_size) * percent
    apart = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in bits), F.lit(0))
    return sizes & (apart * (100 + percent) <= (size + other_size) * (100 - percent))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, length: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = written(with_sets(docs, length), "llm-sets")
    sets = ["set_a", "set_b"]
    kept = base.filter("n_shingles > 0").groupBy(*sets)
    classes = written(kept.agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("size"), *[F.max(s).alias(s) for s in SKETCHES], F.max("bits").alias("bits")), "llm-classes")
    sketched = classes.groupBy("node").agg(F.max("size").alias("size"), *[F.max(s).alias(s) for s in SKETCHES])
    bits = classes.filter("bits IS NOT NULL").groupBy("node").agg(F.max(F.struct("size", "bits")).alias("s")).select("node", "s.*")
    # one text of each set has signatures; written, so that the others' ids are broadcast where they are few
    copies = base.join(classes.select(*sets, "node"), sets).filter("doc_id <> node").select("doc_id").distinct()
    copies = written(copies.join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_anti"), "llm-copies")
    single = docs.filter("doc_id IS NOT NULL").join(copies, "doc_id", "left_anti")
    # dealt by signature once: the counts read the same shuffle as the rows that they are joined to
    signed = with_signatures(single, percent, length).select("node", F.explode("sigs").alias("sig")).repartition("sig")
    shared = signed.groupBy("sig").agg(F.count("*").alias("members"), F.min("node").alias("pivot")).filter("members > 1")
    buckets = written(signed.join(shared, "sig"), "llm-buckets")

    star = buckets.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    left, right = (sketched.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size"), *[F.col(s).alias(f"{side}_{s}") for s in SKETCHES]) for side in "ab")
    likely = _plausible(F.col("a_size"), F.col("b_size"), [(F.col(f"a_{s}"), F.col(f"b_{s}")) for s in SKETCHES], percent)
    links = _compared(star.join(left, "a").join(right, "b").filter(likely).select("a", "b"), bits, docs, percent, length)
    large = written(buckets.filter("members > 2").select("sig", "node", "members").join(sketched, "node"), "llm-large")
    discard(buckets)
    most = large.agg(F.max("members")).head()[0] or 0
    likely = _plausible(F.col("size"), F.col("p_size"), [(F.col(s), F.col(f"p_{s}")) for s in SKETCHES], percent)
    turn = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30) * F.col("members")
    tried, upto = 0, PIVOTS
    while tried < most:
        placed = large.drop("component").join(partial_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        split = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
        before, large = large, written(placed.join(split.select("sig"), "sig", "left_semi"), "llm-open")
        discard(before)
        pivots = large.filter((turn >= tried) & (turn < upto))
        pivots = pivots.select("sig", F.col("node").alias("p"), F.col("component").alias("of_p"), F.col("size").alias("p_size"), *[F.col(s).alias(f"p_{s}") for s in SKETCHES])
        pairs = large.join(pivots, "sig").filter((F.col("component") != F.col("of_p")) & likely).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()
        found = _compared(pairs, bits, docs, percent, length)
        before, links = links, written(links.union(found), "llm-links")
        for table in (before, found):
            discard(table)
        tried, upto = upto, upto * MORE
    discard(large)
    found = connected_components(links)

    placed = classes.join(found, "node", "left").select(*sets, F.coalesce("component", "node").alias("component"))
    out = base.select("doc_id", "n_shingles", *sets).join(placed, sets, "left")
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number of each row's own: its id where ids are distinct, else one that is written with the row."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.filter("doc_id IS NULL").isEmpty() and ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "llm-rows")


def keep_one_row(docs: DataFrame, percent: int = PERCENT, length: int = SHINGLE_WORDS) -> DataFrame:
    """Exactly one row of each component of ``docs``; all columns.

    Rows are told apart by a number of their own, not by doc_id: repeated rows, rows with null id and rows of one id with
    different texts are compared as any others. The row of the smallest doc_id stays, one with a null id only where no
    row has an id. Rows without words are each a component of their own, repeated or not.
    """
    number = free_name(docs, "row")
    rows = _numbered(docs, number)
    found = jaccard_components(rows.select(F.col(number).alias("doc_id"), "text"), percent, length)
    named = found.select(F.col("doc_id").alias(number), "component_id").join(rows.select(number, F.col("doc_id").cast("long").alias("id")), number)
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col(number).alias("number"))).alias("first")
    kept = named.groupBy("component_id").agg(first).select(F.col("first.number").alias(number))
    return rows.join(kept, number, "left_semi").select(*docs.columns)
