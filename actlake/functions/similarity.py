"""Text similarity for change detection.

The Ratcliff-Obershelp ratio has no Spark built-in, so it is the one Arrow UDF here.
Whether it is below a threshold is decided in Catalyst by bounds (``decision``); only
pairs that the bounds leave open reach the UDF, others reach it as NULL. With
``measure="edits"`` the open pairs are decided by their edit distance and no Python runs.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, as_column, let


def _ratio_udf(autojunk: bool):
    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if a is None or b is None else SequenceMatcher(None, a, b, autojunk).ratio()
                for a, b in zip(left, right)
            ],
            dtype="float64",
        )

    return ratio


def similarity(a: ColumnLike, b: ColumnLike, autojunk: bool = False, needed: Column | None = None) -> Column:
    """Ratio in 0..1; 0 if either text is empty, 1 if equal. Only ``needed`` rows are compared.

    ``autojunk`` turns on the matcher's popularity heuristic, which distorts texts of
    200 characters and more.
    """
    a, b = as_column(a), as_column(b)
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    compare = ~empty & (a != b)
    if needed is not None:
        compare = compare & needed
    measured = _ratio_udf(autojunk)(F.when(compare, a), F.when(compare, b))
    return F.when(empty, F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(measured)


def levenshtein_similarity(a: ColumnLike, b: ColumnLike) -> Column:
    """``1 - edits / longer length``, a JVM-side alternative measure."""
    a, b = as_column(a), as_column(b)
    longer = F.greatest(F.length(a), F.length(b))
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def length_bound(a: ColumnLike, b: ColumnLike) -> Column:
    """Upper bound of the ratio from the lengths alone."""
    la, lb = F.length(as_column(a)), F.length(as_column(b))
    return F.when(la + lb > 0, 2.0 * F.least(la, lb) / (la + lb)).otherwise(1.0)


def character_bound(a: ColumnLike, b: ColumnLike) -> Column:
    """Upper bound of the ratio: characters match at most as often as both texts have them."""
    a, b = as_column(a), as_column(b)

    def times(text: Column, char: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, char, F.lit("")))

    chars = F.filter(F.array_distinct(F.split(a, "")), lambda c: c != "")
    shared = F.aggregate(chars, F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 2.0 * shared / total).otherwise(1.0)


def common_prefix(a: ColumnLike, b: ColumnLike) -> Column:
    """Length of the common prefix, by halving steps."""

    def longest(t: Column) -> Column:
        x, y, most = t["a"], t["b"], t["most"]
        # from the greatest power of two that both texts can hold
        powers = F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

        def longer(at: Column, power: Column) -> Column:
            step = F.call_function("shiftleft", F.lit(1), power)
            fits = (at + step <= most) & (x.substr(at + 1, step) == y.substr(at + 1, step))
            return F.when(fits, at + step).otherwise(at)

        return F.aggregate(powers, F.lit(0), longer)

    a, b = as_column(a), as_column(b)
    # bound once, since texts and lengths are made anew wherever they stand in a lambda
    texts = F.struct(a.alias("a"), b.alias("b"), F.least(F.length(a), F.length(b)).alias("most"))
    return F.when(a.isNotNull() & b.isNotNull(), let(texts, longest))


def edge_bound(a: ColumnLike, b: ColumnLike) -> Column:
    """Lower bound of the ratio: the longest common block is at least the common prefix or suffix."""
    a, b = as_column(a), as_column(b)
    total = F.length(a) + F.length(b)
    longest = F.greatest(common_prefix(a, b), common_prefix(F.reverse(a), F.reverse(b)))
    return F.when(total > 0, 2.0 * longest / total).otherwise(1.0)


def _edge_reaches(a: Column, b: Column, total: Column, shorter: Column, threshold: float) -> Column:
    """``edge_bound`` of at least ``threshold``, without the bound: the least prefix or suffix that gives it is common."""

    def gives(n: Column) -> Column:
        return 2.0 * n / F.greatest(total, F.lit(1)) >= threshold

    # the product is rounded, so the least number that gives it is one of three
    near = F.floor(threshold * total / 2).cast("int")
    least = F.when(gives(near - 1), near - 1).when(gives(near), near).otherwise(near + 1)
    return let(least, lambda n: (n <= shorter) & ((F.left(a, n) == F.left(b, n)) | (F.right(a, n) == F.right(b, n))))


def _middles(a: Column, b: Column) -> Column:
    """struct(a, b): two texts without their common prefix and suffix, which no edit distance depends on."""

    def rest(cut: Column) -> Column:
        x, y = a.substr(cut + 1, F.length(a)), b.substr(cut + 1, F.length(b))
        return F.struct(x.alias("a"), y.alias("b"))

    def front(t: Column) -> Column:
        def kept(cut: Column) -> Column:
            x, y = F.left(t["a"], F.length(t["a"]) - cut), F.left(t["b"], F.length(t["b"]) - cut)
            return F.struct(x.alias("a"), y.alias("b"))

        return let(common_prefix(F.reverse(t["a"]), F.reverse(t["b"])), kept)

    return let(let(common_prefix(a, b), rest), front)


def _band(middles: Column, most: Column) -> Column:
    """Edit distance of what ``_middles`` gives, -1 beyond ``most``."""
    return F.call_function("levenshtein", middles["a"], middles["b"], most)


def _narrow(middles: Column, most: Column) -> Column:
    """A band that small distances end in; no distance is less than the lengths differ."""
    return F.least(most, F.greatest(F.floor(most / 8).cast("int"), F.abs(F.length(middles["a"]) - F.length(middles["b"]))))


def _stepwise(middles: Column, most: Column) -> Column:
    """An upper bound of the edit distance, -1 beyond ``most``: an edit wherever the rests differ, the one after which they agree for longest.

    It is the distance itself where edits stand apart, and takes as many passes of a text as there are edits; where no single
    edit makes the rests agree, it gives up.
    """

    def after(t: Column, skip_a: int, skip_b: int) -> Column:
        x, y = t["a"].substr(F.lit(1 + skip_a), F.length(t["a"])), t["b"].substr(F.lit(1 + skip_b), F.length(t["b"]))
        return let(F.struct(x.alias("a"), y.alias("b")), lambda r: let(common_prefix(r["a"], r["b"]), lambda cut: F.struct(
            r["a"].substr(cut + 1, F.length(r["a"])).alias("a"), r["b"].substr(cut + 1, F.length(r["b"])).alias("b"), (t["n"] + 1).alias("n"))))

    def agree(t: Column, skip_a: int, skip_b: int, chars: int) -> Column:
        return t["a"].substr(1 + skip_a, chars) == t["b"].substr(1 + skip_b, chars)

    def edited(t: Column, _: Column) -> Column:
        edits = ((1, 0), (0, 1), (1, 1))
        ended = (t["a"] == "") | (t["b"] == "")
        found = F.when(ended, t)
        for chars in (8, 2, 1):
            for edit in edits:
                found = found.when(agree(t, *edit, chars), after(t, *edit))
        return found.otherwise(F.struct(F.lit("").alias("a"), F.lit("").alias("b"), (most + 1).alias("n")))

    start = F.struct(middles["a"].alias("a"), middles["b"].alias("b"), F.lit(0).alias("n"))
    last = F.aggregate(F.sequence(F.lit(0), most), start, edited)

    def told(t: Column) -> Column:
        edits = t["n"] + F.length(t["a"]) + F.length(t["b"])
        return F.when(((t["a"] == "") | (t["b"] == "")) & (edits <= most), edits).otherwise(-1)

    return let(last, told)


LONG = 10_000  # characters from which bounds that take a while are tried before the whole edit distance


def _missing_blocks(a: Column, b: Column, size: int, most: Column) -> Column:
    """Blocks of ``a``, end to end, that ``b`` has nowhere near: a lower bound of the edit distance where that is at most ``most``.

    An edit changes one block at most and shifts the others by one place at most, so a block left as it is
    stands in the same stretch of ``most`` places or in one beside it. Equal blocks of a stretch count once.
    """

    def blocks(text: Column, step: int, beside: tuple[int, ...]) -> Column:
        def cut(chars: Column) -> Column:
            places = F.sequence(F.lit(0), F.size(chars) - size, F.lit(step))

            def marked(i: Column) -> Column:
                stretch = F.floor(i / most).cast("int")
                block = F.concat(*[F.get(chars, i + k) for k in range(size)])
                return let(block, lambda x: F.array(*[F.concat(x, (stretch + n).cast("string")) for n in beside]))

            return F.flatten(F.transform(places, marked))

        return let(F.split(text, ""), cut)

    return F.size(F.array_except(blocks(a, size, (0,)), blocks(b, 1, (-1, 0, 1))))


def _bounded(left: Column, right: Column, a: Column, b: Column, threshold: float, autojunk: bool) -> Column:
    """What the lengths ``a`` and ``b`` of the texts and common ends decide; NULL for the rest."""
    found = F.when(left == right, "similar").when((a == 0) | (b == 0), "significant")
    found = found.when(2.0 * F.least(a, b) / (a + b) < threshold, "significant")
    return found if autojunk else found.when(_edge_reaches(left, right, a + b, F.least(a, b), threshold), "similar")


def decided(a: ColumnLike, b: ColumnLike, threshold: float = 0.95, autojunk: bool = False) -> Column:
    """struct(decision, edits): what ``decision`` says, and of open pairs their edit distance.

    Where the distance is small, ``edits`` may be an upper bound of it that leaves ``1 - edits / longer length`` at ``threshold`` or more.
    """
    # blocks so short that a text can miss more of them than edits are allowed
    size = min(max(2, int(0.3 / max(1 - threshold, 1e-3))), LONG)

    def told(found: Column | str, edits: Column | None = None) -> Column:
        word = F.lit(found) if isinstance(found, str) else found
        return F.struct(word.alias("decision"), (F.lit(None).cast("int") if edits is None else edits).alias("edits"))

    def of(p: Column) -> Column:
        left, right, longer, total = p["a"], p["b"], F.greatest(p["la"], p["lb"]), p["la"] + p["lb"]

        def few(edits: Column) -> Column:
            # characters that no edit touches are shared, so few edits tell that the characters' bound is high
            return 2.0 * (longer - edits) / F.greatest(total, F.lit(1)) >= threshold

        def by_characters(edits: Column) -> Column:
            return F.when(~few(edits) & (character_bound(left, right) < threshold), told("significant")).otherwise(told("open", edits))

        def measured(t: Column, most: Column) -> Column:
            long = F.least(F.length(t["a"]), F.length(t["b"])) >= LONG
            far = (character_bound(left, right) < threshold) | (_missing_blocks(t["a"], t["b"], size, F.greatest(most, F.lit(1))) > most)

            def in_band(found: Column) -> Column:
                whole = let(_band(t, most), lambda edits: F.when(edits < 0, told("significant")).otherwise(by_characters(edits)))
                return F.when(found >= 0, by_characters(found)).when(long & far, told("significant")).otherwise(whole)

            def by_steps(found: Column) -> Column:
                enough = (found >= 0) & few(found) & (1 - found / longer >= threshold)
                return F.when(enough, told("open", found)).otherwise(let(_band(t, _narrow(t, most)), in_band))

            return let(_stepwise(t, F.least(_narrow(t, most), F.floor(most / 2).cast("int"))), by_steps)

        # bound to variables, since lengths are counted anew wherever they stand
        rest = let(F.floor((1 - threshold) * total + 1e-9).cast("int"), lambda most: let(_middles(left, right), lambda t: measured(t, most)))
        found = _bounded(left, right, p["la"], p["lb"], threshold, autojunk)
        return let(found, lambda x: F.when(x.isNotNull(), told(x)).otherwise(rest))

    left, right = F.coalesce(as_column(a), F.lit("")), F.coalesce(as_column(b), F.lit(""))
    return let(F.struct(left.alias("a"), right.alias("b"), F.length(left).alias("la"), F.length(right).alias("lb")), of)


def decision(a: ColumnLike, b: ColumnLike, threshold: float = 0.95, autojunk: bool = False, plain: bool = False) -> Column:
    """'similar' (ratio of at least ``threshold``), 'significant' (less) or 'open', all without the ratio itself.

    The ratio counts characters of a common subsequence, so it is at most 1 - distance / total
    length, and more edits than that allows end the distance early. The popularity
    heuristic may miss the common prefix, so with it nothing is decided by that. ``plain`` measures whole texts in one
    band; without it the expression cannot stand inside an argument of a Python UDF.
    """
    if not plain:
        return decided(a, b, threshold, autojunk)["decision"]
    left, right = F.coalesce(as_column(a), F.lit("")), F.coalesce(as_column(b), F.lit(""))
    allowed = F.floor((1 - threshold) * (F.length(left) + F.length(right)) + 1e-9).cast("int")
    found = _bounded(left, right, F.length(left), F.length(right), threshold, autojunk).when(character_bound(left, right) < threshold, "significant")
    return found.when(F.call_function("levenshtein", left, right, allowed) < 0, "significant").otherwise("open")


def significant_change(found: Column, a: ColumnLike, b: ColumnLike, threshold: float = 0.95) -> Column:
    """What ``decided`` found, where it is open by the edit distance."""
    longer = F.greatest(F.length(as_column(a)), F.length(as_column(b)))
    return F.when(found["decision"] == "open", 1 - found["edits"] / longer < threshold).otherwise(found["decision"] == "significant")


def is_significant(
    a: ColumnLike, b: ColumnLike, threshold: float = 0.95, autojunk: bool = False, measure: str = "ratio"
) -> Column:
    """Texts differ and their similarity is under ``threshold``.

    A threshold of 1 or more makes every difference significant and needs no UDF; nor does
    the measure ``edits``, which takes ``levenshtein_similarity`` for what the bounds leave open.
    """
    left, right = F.coalesce(as_column(a), F.lit("")), F.coalesce(as_column(b), F.lit(""))
    if threshold >= 1:
        return left != right
    if measure not in ("ratio", "edits"):
        raise ValueError(f"no measure {measure}")

    if measure == "edits":
        return let(decided(left, right, threshold, autojunk), lambda f: significant_change(f, left, right, threshold))
    found = decision(left, right, threshold, autojunk, plain=True)
    still = found == "open"
    return F.when(still, similarity(left, right, autojunk, still) < threshold).otherwise(found == "significant")
