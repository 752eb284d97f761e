"""Act metadata from designation, header, issuer and gazette texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import ColumnLike, as_column, comma_below, first_int, found, groups, let, month_number, year_of

_I = "(?iuU)"  # case-insensitive, with letters outside ASCII


def act_type(designation: ColumnLike, vocabulary: tuple[str, ...] = vocab.ACT_TYPES) -> Column:
    """First vocabulary entry contained in the text, in vocabulary order."""

    def choose(upper: Column) -> Column:
        return F.coalesce(*[F.when(upper.contains(entry.upper()), entry) for entry in vocabulary])

    return let(F.upper(comma_below(designation)), choose)


def normal_type(matched: Column) -> Column:
    upper = F.upper(matched)
    branches = [F.when(upper.rlike(pattern), form) for pattern, form in vocab.TYPE_FORMS]
    return F.coalesce(*branches, upper)


def _two_digits(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def _day_month_year(day: Column, month: Column, year: Column, pad: bool) -> Column:
    number = F.lpad(month_number(month).cast("string"), 2, "0")
    return F.concat(_two_digits(day) if pad else day, F.lit("/"), number, F.lit("/"), year)


def _real_date(day: Column, month: Column, year: Column) -> Column:
    """A calendar date, NULL for 31 February and unknown months."""
    text = F.concat_ws("-", year, month_number(month).cast("string"), day)
    parsed = F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")
    return F.when(month_number(month).isNotNull(), parsed)


def _part(found: Column, i: int) -> Column:
    return F.get(found, F.lit(i))


def basic_metadata(designation: ColumnLike, header: ColumnLike) -> Column:
    """struct(act_type, act_number, act_year, act_date, title) from one numbered, dated pattern."""
    pattern = _I + r"nr\.?\s*(\d+)\s+din\s+(\d+)\s+(\w+)\s+(\d{4})"

    def fields(text: Column, g: Column) -> Column:
        return F.struct(
            act_type(text).alias("act_type"),
            _part(g, 0).try_cast("int").alias("act_number"),
            _part(g, 3).try_cast("int").alias("act_year"),
            _day_month_year(_part(g, 1), _part(g, 2), _part(g, 3), pad=False).alias("act_date"),
            as_column(header).alias("title"),
        )

    return let(as_column(designation), lambda text: let(groups(text, pattern, 4), lambda g: fields(text, g)))


def full_metadata(
    designation: ColumnLike, header: ColumnLike, issuer: ColumnLike, publication: ColumnLike
) -> Column:
    """Three designation patterns in order; ``nr. N/YYYY`` is dated 1 January and flagged approximate."""
    dated = _I + rf"({vocab.TYPE_PATTERN})\s+nr\.?\s*(\d+)\s+din\s+(\d{{1,2}})\s+(\w+)\s+(\d{{4}})"
    short = _I + rf"({vocab.TYPE_PATTERN})\s+nr\.?\s*(\d+)/(\d{{4}})"
    bare = _I + rf"({vocab.UNNUMBERED_TYPE_PATTERN})\s+din\s+(\d{{1,2}})\s+(\w+)\s+(\d{{4}})"

    def parts(found: Column, kind: Column, number: Column, date: Column, approximate: bool) -> Column:
        return F.when(
            found.isNotNull(),
            F.struct(
                kind.alias("kind"), number.alias("number"), date.alias("date"), F.lit(approximate).alias("approximate")
            ),
        )

    def by_dated(g: Column) -> Column:
        date = _day_month_year(_part(g, 2), _part(g, 3), _part(g, 4), pad=True)
        return parts(g, _part(g, 0), _part(g, 1), date, False)

    def by_short(g: Column) -> Column:
        return parts(g, _part(g, 0), _part(g, 1), F.concat(F.lit("01/01/"), _part(g, 2)), True)

    def by_bare(g: Column) -> Column:
        date = _day_month_year(_part(g, 1), _part(g, 2), _part(g, 3), pad=True)
        return parts(g, _part(g, 0), F.lit(None).cast("string"), date, False)

    def first_match(text: Column) -> Column:
        return F.coalesce(
            let(groups(text, dated, 5), by_dated), let(groups(text, short, 3), by_short), let(groups(text, bare, 4), by_bare)
        )

    published = _I + r"din\s+(\d+)\s+(\w+)\s+(\d{4})"

    def gazette(pub: Column) -> Column:
        date = let(
            groups(pub, published, 3), lambda g: _day_month_year(_part(g, 0), _part(g, 1), _part(g, 2), pad=True)
        )
        return F.struct(found(pub, _I + r"nr\.?\s*(\d+)").try_cast("int").alias("nr"), date.alias("date"))

    def fields(act: Column, gaz: Column) -> Column:
        return F.struct(
            normal_type(act["kind"]).alias("act_type"),
            act["number"].try_cast("int").alias("act_number"),
            act["date"].alias("act_date"),
            year_of(act["date"]).alias("act_year"),
            F.coalesce(act["approximate"], F.lit(False)).alias("date_is_approximate"),
            as_column(header).alias("title"),
            as_column(issuer).alias("issuer"),
            gaz["nr"].alias("gazette_nr"),
            gaz["date"].alias("gazette_date"),
            year_of(gaz["date"]).alias("gazette_year"),
        )

    return let(
        let(comma_below(designation), first_match),
        lambda act: let(let(as_column(publication), gazette), lambda gaz: fields(act, gaz)),
    )


def consolidated_metadata(
    designation: ColumnLike, header: ColumnLike, issuer: ColumnLike, gazette: ColumnLike
) -> Column:
    """Typed metadata: number as text, real dates, fallbacks for title, issuer and type."""
    dated = _I + r"din\s+(\d{1,2})\s+(\w+)\s+(\d{4})"

    def real_date(text: Column, pattern: str, n: int, first: int) -> Column:
        return let(groups(text, pattern, n), lambda g: _real_date(_part(g, first), _part(g, first + 1), _part(g, first + 2)))

    def published(gaz: Column) -> Column:
        def fields(g: Column) -> Column:
            return let(
                _real_date(_part(g, 1), _part(g, 2), _part(g, 3)),
                lambda date: F.struct(_part(g, 0).alias("nr"), date.alias("date"), F.year(date).alias("year")),
            )

        return let(groups(gaz, _I + vocab.GAZETTE_PATTERN, 4), fields)

    def fields(text: Column, act_date: Column) -> Column:
        number = F.coalesce(
            found(text, _I + r"nr\.?\s*(\d+)\s+din"),
            found(text, _I + r"nr\.?\s*(\d+)/\d{4}"),
            found(text, _I + r"nr\.?\s*(\d+)"),
        )
        spelled = _I + rf"({vocab.TYPE_PATTERN})\s+(?:nr\.?\s*\d+(?:\s+din|/\d{{4}})|din\s+\d)"
        parliament = F.when(F.upper(text).contains(vocab.PARLIAMENT[0]), vocab.PARLIAMENT[1])
        return F.struct(
            F.coalesce(act_type(text), F.upper(found(text, spelled))).alias("act_type"),
            number.alias("act_number"),
            act_date.alias("act_date"),
            F.coalesce(F.year(act_date), found(text, r"/(\d{4})").try_cast("int")).alias("act_year"),
            F.coalesce(as_column(header), found(text, _I + r"privind\s+(.+)")).alias("title"),
            F.coalesce(as_column(issuer), parliament).alias("issuer"),
            let(as_column(gazette), published).alias("gazette"),
        )

    return let(
        comma_below(designation), lambda text: let(real_date(text, dated, 3, 0), lambda date: fields(text, date))
    )


def merge_metadata(base: dict[str, ColumnLike], override: dict[str, ColumnLike]) -> list[Column]:
    """Per field: the override unless it is NULL or empty (or zero), else the base."""
    merged = []
    for name, column in base.items():
        if name not in override:
            merged.append(as_column(column).alias(name))
            continue
        value = as_column(override[name])
        usable = ~value.cast("string").isin("", "0")
        merged.append(F.coalesce(F.when(usable, value), as_column(column)).alias(name))
    return merged


__all__ = [
    "act_type",
    "basic_metadata",
    "consolidated_metadata",
    "first_int",
    "full_metadata",
    "merge_metadata",
    "normal_type",
]
