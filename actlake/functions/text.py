"""Text, number and date expressions. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

ColumnLike = Column | str


def as_column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, evaluated once per row.

    Expressions inside array lambdas get no common-subexpression elimination, so long
    ones that are used several times are bound to a lambda variable here.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: ColumnLike) -> Column:
    """Trim every kind of blank, not only U+0020."""
    return F.btrim(as_column(c), F.lit(vocab.WHITESPACE))


def blank_to_null(c: ColumnLike) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_present(c: ColumnLike) -> Column:
    """Not NULL and not the empty string."""
    return F.coalesce(as_column(c), F.lit("")) != ""


def found(c: ColumnLike, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` with NULL instead of '' when nothing matches."""
    return F.nullif(F.regexp_extract(as_column(c), pattern, group), F.lit(""))


_SEPARATOR = "\u0001"


def groups(c: ColumnLike, pattern: str, n: int) -> Column:
    """All ``n`` groups of the first match as an array, NULL where nothing matches.

    The pattern runs over the text once, and once more over the short match.
    """
    template = _SEPARATOR.join(f"${i}" for i in range(1, n + 1))
    return let(
        F.regexp_extract(as_column(c), pattern, 0),
        lambda m: F.when(m != "", F.split(F.regexp_replace(m, pattern, template), _SEPARATOR)),
    )


def comma_below(c: ColumnLike) -> Column:
    """Cedilla forms of s and t to the comma-below forms used in the vocabularies."""
    return F.translate(as_column(c), "ŞşŢţ", "ȘșȚț")


# ---------------------------------------------------------------- numbers


def first_int(c: ColumnLike) -> Column:
    """First whole-word run of digits, else NULL (also when it does not fit an INT)."""
    return found(c, r"(?U)\b(\d+)\b").try_cast("int")


def roman_to_int(c: ColumnLike) -> Column:
    """Value of the first whole-word Roman numeral; no check that it is well formed.

    A digit counts negative when a larger one stands to its right.
    """
    numeral = F.regexp_extract(as_column(c), r"(?U)\b([IVXLCDM]+)\b", 1)
    values = F.array(*[F.lit(v) for v in (1, 5, 10, 50, 100, 500, 1000)])
    digits = F.transform(
        F.regexp_extract_all(F.reverse(numeral), F.lit("[IVXLCDM]"), F.lit(0)),
        lambda ch: F.get(values, F.instr(F.lit("IVXLCDM"), ch) - 1),
    )
    total = F.aggregate(
        digits,
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("top")),
        lambda acc, v: F.struct(
            (acc["total"] + F.when(v < acc["top"], -v).otherwise(v)).alias("total"),
            F.greatest(acc["top"], v).alias("top"),
        ),
        lambda acc: acc["total"],
    )
    return F.when(total > 0, total)


def int_to_roman(c: ColumnLike) -> Column:
    """Roman numeral of a positive integer; '' for NULL, zero and negatives.

    One lookup per decimal place; thousands are repeated.
    """
    n = as_column(c).cast("int")
    places = (
        (100, ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]),
        (10, ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]),
        (1, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]),
    )
    parts = [F.repeat(F.lit("M"), F.floor(n / 1000).cast("int"))]
    for unit, symbols in places:
        digit = (F.floor(n / unit) % 10).cast("int")
        parts.append(F.get(F.array(*[F.lit(s) for s in symbols]), digit))
    return F.when(n > 0, F.concat(*parts)).otherwise("")


def year_of(c: ColumnLike) -> Column:
    """First four-digit word if it is a plausible year."""
    year = found(strip(c), r"(?U)\b(\d{4})\b").try_cast("int")
    return F.when(year.between(vocab.MIN_YEAR, vocab.MAX_YEAR), year)


_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def parse_float(c: ColumnLike) -> Column:
    value = strip(c)
    return F.when(value.rlike(_NUMBER), value.try_cast("double"))


def parse_int(c: ColumnLike) -> Column:
    """Integer part of a decimal string: '3.7' is 3, text is NULL."""
    value = parse_float(c)
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
    return F.when(F.abs(value) < 2147483648.0, whole.try_cast("int"))


def parse_date(c: ColumnLike) -> Column:
    """``dd/MM/yyyy``, then ``yyyy-MM-dd``, else NULL."""
    value = strip(c)
    european = F.when(value.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(value, F.lit("d/M/yyyy")))
    iso = F.when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(value, F.lit("yyyy-M-d")))
    return F.coalesce(european, iso).cast("date")


def month_number(c: ColumnLike, months: dict[str, int] = vocab.MONTHS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])
    return F.element_at(table, F.lower(as_column(c)))


# ---------------------------------------------------------------- labels of articles


def clean_label(c: ColumnLike) -> Column:
    """``Articolul N...`` is cut after the number, anything else is kept."""
    return F.coalesce(found(c, r"^(Articolul\s+\d+)"), as_column(c))


def strip_label_prefix(text: ColumnLike, label: ColumnLike) -> Column:
    text, label = as_column(text), as_column(label)
    rest = F.when(text.startswith(label), text.substr(F.length(label) + 1, F.length(text))).otherwise(text)
    return strip(rest)


def normalize_references(c: ColumnLike) -> Column:
    """Put back blanks lost where text nodes were glued: ``laalin. (1)se`` -> ``la alin. (1) se``.

    One pass for all abbreviations is the same as one pass each: no abbreviation is
    the ending of another, so matches cannot compete.
    """
    abbreviations = "|".join(vocab.ABBREVIATIONS)
    words = "|".join(vocab.JOINING_WORDS)
    # the literal lookahead comes first: it fails fast almost everywhere
    spaced = F.regexp_replace(as_column(c), rf"(?U)(?=(?:{abbreviations})\.)(?<=\w)", " ")
    spaced = F.regexp_replace(spaced, r"\)([a-zăâîșțA-ZĂÂÎȘȚ])", ") $1")
    return F.regexp_replace(spaced, rf"({words})([a-z]\))", "$1 $2")


# ---------------------------------------------------------------- lists inside article text

_LETTER = "[a-zăâîșț]"
_CAPITAL = "[A-ZĂÎÂȘȚ]"


def _intro_and_first(head: Column) -> Column:
    """First part of a list: text up to the first letter, then that letter on its own line."""
    pattern = rf"(?siu)^(.*?)({_LETTER}\))(.+)$"
    letter = F.regexp_extract(head, pattern, 2)
    intro = F.when(letter != "", F.regexp_extract(head, pattern, 1)).otherwise(head)
    intro = strip(F.regexp_replace(intro, r":+\z", ""))
    first = F.concat(F.lit("\n  **"), letter, F.lit("** "), strip(F.regexp_extract(head, pattern, 3)))
    return F.concat(
        F.when(intro != "", F.concat(intro, F.lit(":"))).otherwise(""), F.when(letter != "", first).otherwise("")
    )


def _further_item(part: Column) -> Column:
    pattern = rf"(?siu)^({_LETTER}\))\s*(.+)$"
    letter = F.regexp_extract(part, pattern, 1)
    line = F.concat(F.lit("\n  **"), letter, F.lit("** "), strip(F.regexp_extract(part, pattern, 2)))
    return (
        F.when(letter != "", line)
        .when(part.isin("", ":", ";", ".", "..."), "")
        .otherwise(F.concat(F.lit("\n\n"), part))
    )


def _is_letter_list(text: Column) -> Column:
    lowered = F.lower(text)
    first_a = F.instr(lowered, F.lit("a)"))
    before = F.substring(lowered, F.greatest(F.lit(1), first_a - 10), F.least(F.lit(10), first_a - 1))
    return (first_a > 0) & ~before.rlike(r"lit\.?\s*$")


def format_letters(c: ColumnLike) -> Column:
    """Lettered points separated by ``;...`` become indented Markdown lines.

    The text is a list only if ``a)`` occurs and is not a reference (``lit. a)``).
    """

    def listed(text: Column) -> Column:
        parts = F.transform(F.split(text, r";\.\.\."), strip)
        lines = F.transform(parts, lambda p, i: F.when(i == 0, _intro_and_first(p)).otherwise(_further_item(p)))
        return F.nullif(F.array_join(lines, ""), F.lit(""))

    text = as_column(c)
    return F.when(
        text.contains(";..."),
        let(text, lambda t: F.coalesce(F.when(_is_letter_list(t), listed(t)), strip(t))),
    ).otherwise(strip(text))


def format_paragraphs(c: ColumnLike) -> Column:
    """Numbered paragraphs ``(1) Text`` become ``**(1)**`` lines followed by their text."""
    text = as_column(c)
    opening = rf"\(\d+\)\s+(?={_CAPITAL})"
    pieces = F.split(text, rf"(?=\(\d+\)\s+{_CAPITAL})")
    blocks = F.transform(
        F.filter(pieces, lambda p: p != ""),
        lambda p: F.concat(
            F.lit("**"),
            F.regexp_extract(p, r"^(\(\d+\))", 1),
            F.lit("**\n"),
            let(strip(F.regexp_replace(p, "^" + opening, "")), format_letters),
            F.lit("\n"),
        ),
    )
    numbered = strip(F.array_join(blocks, "\n"))
    return F.when(text.rlike("^" + opening), numbered).otherwise(format_letters(text))


# ---------------------------------------------------------------- search


def highlight(c: ColumnLike, length: int = 200) -> Column:
    return F.coalesce(F.substring(as_column(c), 1, length), F.lit(""))


def occurrences(c: ColumnLike, needle: str) -> Column:
    """Number of non-overlapping, case-insensitive occurrences of a non-empty string."""
    lowered, low = F.lower(as_column(c)), needle.lower()
    shorter = F.replace(lowered, F.lit(low), F.lit(""))
    return ((F.length(lowered) - F.length(shorter)) / F.lit(len(low))).cast("int")


def relevance(text: ColumnLike, issue: ColumnLike, explanation: ColumnLike, query: str) -> Column:
    """Occurrences in the text, +5 if in the issue, +3 if in the explanation, at most 100."""
    low = query.lower()
    score = (
        F.coalesce(occurrences(text, query), F.lit(0))
        + F.when(F.lower(as_column(issue)).contains(low), 5).otherwise(0)
        + F.when(F.lower(as_column(explanation)).contains(low), 3).otherwise(0)
    )
    return F.least(score, F.lit(100)).cast("double")


# ---------------------------------------------------------------- file names

_RESULT_FILE = r"^(.+?)_(\d{8}_\d{6})\.(csv|md)"


def parse_result_filename(name: ColumnLike) -> Column:
    """``<act>_<yyyyMMdd_HHmmss>.(csv|md)`` -> struct(act, ts, kind), NULLs when it does not parse."""

    def fields(found: Column) -> Column:
        part = lambda i: F.get(found, F.lit(i))
        ts = F.try_to_timestamp(part(1), F.lit("yyyyMMdd_HHmmss"))
        return let(
            ts,
            lambda t: F.struct(
                F.when(t.isNotNull(), part(0)).alias("act"), t.alias("ts"), F.when(t.isNotNull(), part(2)).alias("kind")
            ),
        )

    return let(groups(name, _RESULT_FILE, 3), fields)


def result_file_key(act_type: ColumnLike, number: ColumnLike, year: ColumnLike) -> Column:
    """``TYPE_NR_YEAR`` with blanks and most diacritics replaced; a fixed name without a type."""
    plain = F.translate(F.replace(as_column(act_type), F.lit(" "), F.lit("_")), "ĂÂȚȘ", "AATS")
    number, year = as_column(number).cast("string"), as_column(year).cast("string")
    key = F.concat_ws("_", plain, F.when(~number.isin("", "0"), number), F.when(~year.isin("", "0"), year))
    return F.when(is_present(act_type), key).otherwise("act_legislativ")
