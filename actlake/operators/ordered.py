"""Looking at neighbours in a sequence without putting a whole group in one task.

A window over (group, order) hands a whole group to one task. When one group may hold
a large share of all rows that task never ends, so these operators cut each group into
chunks of the order column, work inside the chunks, and pass only one row per chunk on
to the next level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 100_000


def _chunk(order: str, size: int) -> Column:
    return F.floor(F.col(order) / size).cast("long")


def with_neighbour(
    df: DataFrame, *, group: str, order: str, value: str, name: str, ahead: bool = False, chunk: int = CHUNK
) -> DataFrame:
    """Add the previous (or next) row's ``value`` in its group, by an integer ``order``.

    ``order`` should be unique in the group; ties are put in order by ``value``.
    """
    keys = [group, "_chunk"]
    rows = df.withColumn("_chunk", _chunk(order, chunk))
    within = Window.partitionBy(*keys).orderBy(order, value)
    step = F.lead if ahead else F.lag
    pair = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    rows = rows.withColumns({"_near": step(pair).over(within)})
    edge = (F.min if ahead else F.max)(pair).alias("_edge")
    edges = rows.groupBy(*keys).agg(edge)
    across = Window.partitionBy(group).orderBy("_chunk")
    edges = edges.select(*keys, step("_edge").over(across).alias("_far"))
    joined = rows.join(edges, keys, "left")
    return joined.withColumn(name, F.coalesce("_near", "_far")["v"]).drop("_chunk", "_near", "_far")


def with_position(df: DataFrame, *, group: str, order: str, name: str = "position", chunk: int = CHUNK) -> DataFrame:
    """Add the 1-based rank by an integer ``order`` in each group; null orders come first, null is a group of its own."""
    keys = [group, "_chunk"]
    rows = df.withColumn("_chunk", _chunk(order, chunk))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = rows.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & F.col("_chunk").eqNullSafe(F.col("_c")))
    return joined.withColumn(name, F.col("_rn") + F.col("_offset")).drop("_chunk", "_rn", "_offset", "_g", "_c")


def adjacent_pairs(df: DataFrame, *, group: str, order: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """(group, order, value, next_order, next_value) of neighbours in each group.

    Pairs inside a chunk come from a window over the chunk, pairs across chunks from one
    row per chunk; the two sets are disjoint, so nothing is joined back.
    """
    keys = [group, "_chunk"]
    rows = df.select(group, order, value, _chunk(order, chunk).alias("_chunk"))
    pair = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    within = rows.select(
        group, F.col(order).alias("order"), F.col(value).alias("value"),
        F.lead(pair).over(Window.partitionBy(*keys).orderBy(order, value)).alias("next"),
    )
    edges = rows.groupBy(*keys).agg(F.min(pair).alias("first"), F.max(pair).alias("last"))
    across = edges.select(
        group, F.col("last.o").alias("order"), F.col("last.v").alias("value"),
        F.lead("first").over(Window.partitionBy(group).orderBy("_chunk")).alias("next"),
    )
    pairs = within.unionByName(across).where(F.col("next").isNotNull())
    return pairs.select(group, "order", "value", F.col("next.o").alias("next_order"), F.col("next.v").alias("next_value"))


def order_violations(df: DataFrame, *, group: str, order: str, number: str, chunk: int = CHUNK) -> DataFrame:
    """Rows whose number is smaller than the number before them."""
    pairs = adjacent_pairs(df.where(F.col(number).isNotNull()), group=group, order=order, value=number, chunk=chunk)
    return pairs.where(F.col("value") > F.col("next_value")).select(
        group, F.col("next_order").alias(order), F.col("next_value").alias(number), F.col("value").alias("previous")
    )


def number_gaps(df: DataFrame, *, group: str, number: str, chunk: int = CHUNK) -> DataFrame:
    """Missing runs in each group's numbers: (group, gap_start, gap_end, n_missing)."""
    numbers = df.where(F.col(number).isNotNull()).select(group, F.col(number).cast("long").alias(number)).distinct()
    pairs = adjacent_pairs(numbers, group=group, order=number, value=number, chunk=chunk)
    pairs = pairs.where(F.col("next_order") - F.col("order") > 1)
    return pairs.select(
        group,
        (F.col("order") + 1).alias("gap_start"),
        (F.col("next_order") - 1).alias("gap_end"),
        (F.col("next_order") - F.col("order") - 1).alias("n_missing"),
    )


def duplicate_numbers(df: DataFrame, *, group: str, number: str) -> DataFrame:
    """Numbers that occur more than once in a group, with their count."""
    counts = df.where(F.col(number).isNotNull()).groupBy(group, number).agg(F.count("*").alias("n"))
    return counts.where("n > 1")
