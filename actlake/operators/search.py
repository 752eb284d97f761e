"""Filters, search, ordering and paging."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import highlight, relevance
from ..session import stored

ONE_TASK = 10_000  # rows of a page that one task may hold


def filter_equal(df: DataFrame, **values) -> DataFrame:
    """Equality on each given column; None means the filter is off."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def filter_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Closed range, either end optional."""
    if low is not None:
        df = df.where(F.col(column) >= F.lit(low))
    if high is not None:
        df = df.where(F.col(column) <= F.lit(high))
    return df


def filter_in(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def filter_array_contains(df: DataFrame, array: str, value) -> DataFrame:
    return df.where(F.array_contains(array, value))


def only_active(df: DataFrame, active_only: bool = True, *, flag: str = "is_active") -> DataFrame:
    return df.where(F.col(flag)) if active_only else df


def exclude_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose key is not listed. An anti join: NULLs in the list exclude nothing."""
    return df.join(keys.select(column).distinct(), column, "left_anti")


def changed_since(df: DataFrame, column: str, as_of: datetime, days: int = 30) -> DataFrame:
    return df.where(F.col(column) > F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))


def with_children(parents: DataFrame, children: list[DataFrame], key: str) -> DataFrame:
    """Parents that have a row in any of the child sets (EXISTS ... OR EXISTS ...).

    Child keys are reduced to one row each before they meet, so a parent with many
    children sends one key.
    """
    keys = children[0].select(key)
    for child in children[1:]:
        keys = keys.unionByName(child.select(key))
    return parents.join(keys.distinct(), key, "left_semi")


def label_filter(df: DataFrame, has_labels: bool, *, issue: str = "issue", explanation: str = "explanation") -> DataFrame:
    """NULL test on both label columns: either set, or neither."""
    either = F.col(issue).isNotNull() | F.col(explanation).isNotNull()
    return df.where(either if has_labels else ~either)


def search_any(df: DataFrame, query: str, columns: Iterable[str]) -> DataFrame:
    """Case-insensitive match in any column; % and _ in the query are wildcards."""
    match: Column = F.lit(False)
    for name in columns:
        match = match | F.coalesce(F.col(name).cast("string").ilike(f"%{query}%"), F.lit(False))
    return df.where(match)


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """``-key`` sorts descending with NULLs first, ``key`` ascending with NULLs last, ``<key`` ascending NULLs first."""
    return df.orderBy(*sort_columns(*keys))


def sort_columns(*keys: str) -> list[Column]:
    columns = []
    for key in keys:
        if key.startswith("-"):
            columns.append(F.col(key[1:]).desc_nulls_first())
        elif key.startswith("<"):
            columns.append(F.col(key[1:]).asc_nulls_first())
        else:
            columns.append(F.col(key).asc_nulls_last())
    return columns


def page(df: DataFrame, *keys: str, skip: int = 0, limit: int = 50, max_limit: int = 500) -> DataFrame:
    """One page of the ordered rows. Values out of bounds are refused, not bent."""
    if skip < 0 or not 1 <= limit <= max_limit:
        raise ValueError(f"skip must not be negative, limit must be from 1 to {max_limit}")
    return ordered(df, *keys).offset(skip).limit(limit)


def _beyond(key: str, last) -> Column:
    """Rows that ``ordered`` puts after those whose value of ``key`` is ``last``."""
    name = key.lstrip("-<")
    column = F.col(name)
    if key[0] in "-<":  # nulls come first
        if last is None:
            return column.isNotNull()
        return (column < F.lit(last)) if key.startswith("-") else (column > F.lit(last))
    return F.lit(False) if last is None else (column > F.lit(last)) | column.isNull()


def _after(keys: Iterable[str], row: Row) -> Column:
    """Rows that ``ordered`` puts after ``row``, which has the keys."""
    follows, same = F.lit(False), F.lit(True)
    for key in keys:
        last = row[key.lstrip("-<")]
        follows = follows | (same & F.coalesce(_beyond(key, last), F.lit(False)))
        same = same & F.col(key.lstrip("-<")).eqNullSafe(F.lit(last))
    return follows


def page_after(df: DataFrame, *keys: str, after: Row | None = None, last: Row | None = None, limit: int = 50, max_limit: int = 500) -> DataFrame:
    """The page that follows the row ``after`` (the first one without it), by values of the sort keys instead of an offset.

    The keys, as ``ordered`` takes them, must tell all rows apart. Nothing before the page is gathered
    or counted, so the last page costs what the first one does, and rows that come in between shift nothing.
    A page of more than ``ONE_TASK`` rows is what stands up to its last row (``last`` where it is known, as ``rows_at``
    finds it), so that no task holds a whole page; rows equal to the last one are then on its page.
    """
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be from 1 to {max_limit}")
    if after is not None:
        df = df.where(_after(keys, after))
    if last is None:
        if limit <= ONE_TASK:
            return ordered(df, *keys).limit(limit)
        last = rows_at(df, keys, [limit])[0]
    return df if last is None else df.where(~_after(keys, last))


def rows_at(df: DataFrame, keys: Iterable[str], numbers: list[int]) -> list[Row | None]:
    """The keys of the rows that have these numbers (from 1) in order, None beyond the last row; no task holds more than a range of the order."""
    names = [k.lstrip("-<") for k in keys]
    # written, so that both reads see the same ranges
    ranges = stored(ordered(df.select(*names), *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    places, before = {}, 0
    for held in sorted(ranges.groupBy("_range").count().collect()):  # a row a range
        places |= {n: (held["_range"], n - before) for n in numbers if before < n <= before + held["count"]}
        before += held["count"]
    if not places:
        return [None] * len(numbers)
    inside = Window.partitionBy("_range").orderBy(*sort_columns(*keys))
    near = ranges.where(F.col("_range").isin(*{r for r, _ in places.values()})).withColumn("_number", F.row_number().over(inside))
    found = near.where(F.struct("_range", "_number").isin(*[F.struct(F.lit(r), F.lit(n)) for r, n in places.values()])).collect()
    at = {(r["_range"], r["_number"]): r for r in found}
    return [at[places[n]] if n in places else None for n in numbers]


def page_info(df: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    """(total, page, n_pages) of the same selection, as one row."""
    return df.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(skip // limit + 1).cast("long").alias("page"),
        F.ceil(F.col("total") / F.lit(limit)).cast("long").alias("n_pages"),
    )


def take_batch(df: DataFrame, limit: int, *, order: str = "id") -> DataFrame:
    """The next rows of a work queue, lowest id first, so reruns take the same ones."""
    return df.orderBy(order).limit(limit)


def top_sources(links: DataFrame, *, url: str = "url", count: str = "act_count", limit: int = 10) -> DataFrame:
    return links.where(F.col(count) > 0).orderBy(F.col(count).desc(), url).limit(limit).select(url, count)


def search_articles(
    articles: DataFrame,
    query: str,
    *,
    limit: int = 50,
    text: str = "text",
    issue: str = "issue",
    explanation: str = "explanation",
    also: tuple[str, ...] = ("title_name", "chapter_name"),
    tie: tuple[str, ...] = ("act_id", "ordinal"),
    legacy: bool = False,
) -> DataFrame:
    """Articles that match anywhere, scored and ranked.

    The best ``limit`` rows by score are kept per task and merged. ``legacy`` limits in
    document order first and ranks what is left.
    """
    hits = search_any(articles, query, (text, issue, explanation, *also))
    scored = hits.withColumns(
        {"relevance": relevance(text, issue, explanation, query), "highlight": highlight(text)}
    )
    if legacy:
        scored = scored.orderBy(*tie).limit(limit)
    return scored.orderBy(F.col("relevance").desc(), *tie).limit(limit)
