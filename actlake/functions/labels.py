"""Computed properties of stored rows, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, as_column, is_present


def _nonzero(c: ColumnLike) -> Column:
    return F.coalesce(as_column(c), F.lit(0)) != 0


def act_name(act_type: ColumnLike, number: ColumnLike, year: ColumnLike) -> Column:
    """``TYPE nr. N din YYYY`` with the parts that are present."""
    number, year = as_column(number), as_column(year)
    return F.concat_ws(
        " ",
        as_column(act_type),
        F.when(is_present(number), F.concat(F.lit("nr. "), number)),
        F.when(_nonzero(year), F.concat(F.lit("din "), year.cast("string"))),
    )


def article_name(label: ColumnLike, number: ColumnLike, ordinal: ColumnLike, article_id: ColumnLike) -> Column:
    fallback = F.when(_nonzero(ordinal), as_column(ordinal).cast("long")).otherwise(as_column(article_id).cast("long"))
    return (
        F.when(is_present(label), as_column(label))
        .when(is_present(number), F.concat(F.lit("Articolul "), as_column(number)))
        .otherwise(F.concat(F.lit("Articol #"), fallback.cast("string")))
    )


def annex_name(number: ColumnLike, ordinal: ColumnLike) -> Column:
    return F.when(is_present(number), as_column(number)).otherwise(
        F.concat(F.lit("Anexa "), as_column(ordinal).cast("string"))
    )


def change_name(label: ColumnLike, number: ColumnLike, ordinal: ColumnLike, kind: ColumnLike) -> Column:
    suffix = F.concat(F.lit(" ("), as_column(kind), F.lit(")"))
    head = (
        F.when(is_present(label), as_column(label))
        .when(is_present(number), F.concat(F.lit("Art. "), as_column(number)))
        .otherwise(F.concat(F.lit("Ordine "), F.coalesce(as_column(ordinal).cast("string"), F.lit("None"))))
    )
    return F.concat(head, suffix)


def hierarchy_path(title: ColumnLike, chapter: ColumnLike, section: ColumnLike, subsection: ColumnLike) -> Column:
    """``Titlul 1 > Cap. 2 > ...`` of the levels that are set, else ``N/A``."""
    levels = (("Titlul ", title), ("Cap. ", chapter), ("Sect. ", section), ("Subsect. ", subsection))
    parts = [F.when(_nonzero(c), F.concat(F.lit(name), as_column(c).cast("string"))) for name, c in levels]
    return F.coalesce(F.nullif(F.concat_ws(" > ", *parts), F.lit("")), F.lit("N/A"))


def has_labels(issue: ColumnLike, explanation: ColumnLike, blank_counts: bool = False) -> Column:
    """Either label set. By default blank strings are no labels; ``blank_counts`` tests NULL only."""
    if blank_counts:
        return as_column(issue).isNotNull() | as_column(explanation).isNotNull()
    return is_present(issue) | is_present(explanation)


def is_processed(ai_status: ColumnLike) -> Column:
    return F.coalesce(as_column(ai_status) == "completed", F.lit(False))


def is_exported(remote_id: ColumnLike) -> Column:
    return as_column(remote_id).isNotNull()


def is_ai_generated(source: ColumnLike) -> Column:
    return F.coalesce(as_column(source) == "ai", F.lit(False))


def has_text_change(kind: ColumnLike, old: ColumnLike, new: ColumnLike) -> Column:
    changed = is_present(old) & is_present(new) & (as_column(old) != as_column(new))
    return F.when(as_column(kind).isin("added", "deleted"), True).otherwise(F.coalesce(changed, F.lit(False)))
