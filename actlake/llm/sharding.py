"""Minimax contiguous partition of documents into shards.

Groups of equal texts are the atoms: they are never cut. They are ordered by a hash of the text and, since their number
grows with the data, gathered into ``units``: runs of that order, 65,536 unless asked otherwise, each made of whole
groups. On a table with fewer groups than that nearly every unit is one group; on a larger one a unit is a share of
1/65,536 of all. Only the units' sizes, whose number is bounded, go to the driver. There the smallest capacity is
found by binary search for which a greedy pass (fill a shard until the next unit would exceed it) needs no more
than the wanted number of shards. Where a single unit forces that capacity it gets a shard of its own, and the search
goes on in the runs before and after it with the shards left; where none does, the units are cut where the greedy pass
cuts. Shards left over split the largest shards that have more than one unit, so all are used if there are units enough.

Null and empty texts are one group. Equal texts are in one shard, however many there are: a group larger than the
mean shard is alone in its shard, and the others are balanced without it. Repeated rows and ids are separate rows. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

OVERHEAD = 16  # bytes a row costs besides its text
UNITS = 1 << 16
SPREAD = 64  # parts in which a unit's rows are numbered, so that a group with a third of all rows is not one task


def cuts_within(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Greedy pass: index of the first unit of each shard after the first, no shard above ``capacity``."""
    ends = np.cumsum(sizes)
    cuts, start, base = [], 0, 0
    while start < len(sizes):
        start = int(np.searchsorted(ends, base + capacity, side="right"))
        if start < len(sizes):
            cuts.append(start)
            base = int(ends[start - 1])
    return np.array(cuts, dtype=np.int64)


def _smallest(runs: list[np.ndarray], shards: int, high: int) -> int | None:
    """The smallest capacity up to ``high`` that lets ``runs`` into ``shards`` shards, none of which spans two runs."""

    def fits(capacity: int) -> bool:
        return sum(len(cuts_within(r, capacity)) + 1 for r in runs) <= shards

    low = max(max(int(r.max()) for r in runs), -(-sum(int(r.sum()) for r in runs) // max(shards, 1)))
    if low > high or not fits(high):
        return None
    while low < high:
        middle = (low + high) // 2
        if fits(middle):
            high = middle
        else:
            low = middle + 1
    return low


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, np.ndarray]:
    """The smallest capacity that lets ``sizes`` (in order) into ``shards`` runs, and cuts for which no run is above it.

    What a large unit leaves to the others is balanced in the same way, see above; min(shards, len(sizes)) runs result.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes):
        return 0, np.array([], dtype=np.int64)
    first = capacity = _smallest([sizes], shards, int(sizes.sum()))
    spans, alone = [(0, len(sizes))], []
    while True:
        span, at = next(((s, s[0] + int(sizes[slice(*s)].argmax())) for s in spans if int(sizes[slice(*s)].max()) == capacity), (None, 0))
        if span is None:
            break
        rest = [s for s in spans if s != span] + [s for s in ((span[0], at), (at + 1, span[1])) if s[0] < s[1]]
        left = shards - len(alone) - 1
        found = _smallest([sizes[slice(*s)] for s in rest], left, capacity) if rest else 0
        if found is None:
            break
        spans, capacity = rest, found
        alone.append((at, at + 1))
        if not rest:
            break
    parts = list(alone)
    for begin, end in spans:
        edges = [begin, *(cuts_within(sizes[begin:end], capacity) + begin).tolist(), end]
        parts += zip(edges[:-1], edges[1:], strict=True)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    while len(parts) < min(shards, len(sizes)):
        begin, end = max((p for p in parts if p[1] - p[0] > 1), key=lambda p: ends[p[1]] - ends[p[0]])
        middle = int(np.abs(2 * ends[begin + 1 : end] - ends[begin] - ends[end]).argmin()) + begin + 1
        parts.remove((begin, end))
        parts += [(begin, middle), (middle, end)]
    return first, np.array(sorted(p[0] for p in parts)[1:], dtype=np.int64)


def shard_documents(docs: DataFrame, shards: int = 40, units: int = UNITS) -> DataFrame:
    """Assign every row of ``docs`` (doc_id, text) to a shard; rows doc_id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 16, ``slot`` the row's number in its shard, gapless from 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - (units - 1).bit_length()).cast("int").alias("unit"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int").alias("part"),
    )
    rows = written(rows, "llm-shard-rows")
    parts = rows.groupBy("unit", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    # at most ``units`` rows of two numbers
    found = parts.groupBy("unit").agg(F.sum("bytes").alias("bytes")).orderBy("unit").toPandas()
    _, cuts = minimax_cuts(found["bytes"].to_numpy(), shards)
    first = [int(found["unit"].iloc[i]) for i in cuts]
    # as many comparisons as shards: at most ``shards`` - 1 cuts
    shard = F.size(F.filter(F.array(*[F.lit(u) for u in first]).cast("array<int>"), lambda u: u <= F.col("unit")))
    before = Window.partitionBy("shard").orderBy("unit", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("shard", shard).withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows", "bytes")
    inside = Window.partitionBy("unit", "part").orderBy("doc_id")
    numbered = rows.withColumn("number", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["unit", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("number")).cast("long").alias("slot"))
