"""Document fingerprints: a Merkle tree with leaves of two words, over paragraphs and sections.

The tree of a text, all in SQL functions:

* sections end before a blank line, paragraphs after a line break, leaves after a word or two (a longer word is cut);
  the first 48 characters are cut into leaves of three, so that short texts have several. No character belongs to none;
* a leaf's hash is the SHA-256 of its text, a paragraph's that of its leaves' hashes, a section's that of its
  paragraphs' hashes, the root that of the sections' hashes. Roots are equal if and only if the texts are (up to
  SHA-256 collisions). Of the leaves' hashes the tree keeps 64 bits.

Two trees are compared from the root down: below equal sections, and below equal paragraphs of differing sections,
nothing is looked at. ``first_difference`` says where they first differ, ``likeness`` compares the leaves of the
branches that differ.

Null and empty texts have the same tree (one empty paragraph, no leaves). Repeated rows and repeated ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

SECTION_BREAK = r"(?<=\n)(?=\n)"
PARAGRAPH_BREAK = r"(?<=\n)"
BLANK = r" \t\n\x0B\f\r"
LEAF = rf"(?:[^{BLANK}]{{1,16}}+[{BLANK}]*+){{1,2}}+|[{BLANK}]+"
FINE_LEAF = r"[\s\S]{1,3}"
FINE_CHARS = 48


def _leaves(paragraph: Column, first: Column) -> Column:
    """The leaves' texts of a paragraph."""
    of = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    fine = of(F.substr(paragraph, F.lit(1), F.lit(FINE_CHARS)), FINE_LEAF)
    return F.when(first, F.concat(fine, of(F.substr(paragraph, F.lit(FINE_CHARS + 1)), LEAF))).otherwise(of(paragraph, LEAF))


def with_tree(df: DataFrame, text: str = "text", tree: str = "tree") -> DataFrame:
    """Add column ``tree``: struct(root, sections, paragraphs, leaves, n_leaves).

    ``sections`` is an array of hashes, ``paragraphs`` an array (per section) of arrays of hashes, ``leaves`` one of
    arrays (per paragraph) of 64-bit hashes.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    hashed = F.transform(
        F.split(whole, SECTION_BREAK, -1),
        lambda s, i: F.transform(
            F.split(s, PARAGRAPH_BREAK, -1), lambda p, j: F.transform(_leaves(p, (i == 0) & (j == 0)), lambda x: F.sha2(x, 256))
        ),
    )
    step = df.withColumn("_leaves", hashed)
    step = step.withColumn("_paragraphs", F.transform("_leaves", lambda ps: F.transform(ps, lambda ls: F.sha2(F.concat_ws("", F.lit("paragraph"), ls), 256))))
    step = step.withColumn("_sections", F.transform("_paragraphs", lambda ps: F.sha2(F.concat_ws("", F.lit("section"), ps), 256)))
    root = F.sha2(F.concat_ws("", F.lit("document"), F.col("_sections")), 256)
    short = F.transform("_leaves", lambda ps: F.transform(ps, lambda ls: F.transform(ls, lambda x: F.xxhash64(x))))
    n_leaves = F.aggregate("_leaves", F.lit(0), lambda n, ps: n + F.aggregate(ps, F.lit(0), lambda m, ls: m + F.size(ls)))
    return step.withColumn(
        tree,
        F.struct(
            root.alias("root"), F.col("_sections").alias("sections"), F.col("_paragraphs").alias("paragraphs"), short.alias("leaves"), n_leaves.alias("n_leaves")
        ),
    ).drop("_paragraphs", "_leaves", "_sections")


def _open_leaves(a: Column, b: Column) -> Column:
    """Leaves of ``a`` below paragraphs that differ from those at the same place in ``b``; only differing sections are opened."""
    none, no_hashes = F.array().cast("array<bigint>"), F.array().cast("array<string>")

    def opened(i: Column) -> Column:
        other = F.coalesce(F.get(b["paragraphs"], i), no_hashes)
        own = F.get(a["paragraphs"], i)
        return F.flatten(F.transform(F.get(a["leaves"], i), lambda ls, j: F.when(F.get(own, j).eqNullSafe(F.get(other, j)), none).otherwise(ls)))

    return F.flatten(F.transform(a["sections"], lambda h, i: F.when(h.eqNullSafe(F.get(b["sections"], i)), none).otherwise(opened(i))))


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add how alike the trees ``a`` and ``b`` are, from 0 to 1; exactly 1 if and only if the roots are equal.

    A Dice coefficient: leaves below equal branches count as they are, those below differing branches as sets.
    """
    x, y = F.col(a), F.col(b)
    opened = df.withColumns({"_a": _open_leaves(x, y), "_b": _open_leaves(y, x)})
    equal = x["n_leaves"] - F.size("_a")
    both = equal + F.size(F.array_intersect("_a", "_b"))
    total = 2 * equal + F.size(F.array_distinct("_a")) + F.size(F.array_distinct("_b"))
    dice = 2.0 * both / F.greatest(total, F.lit(1))
    value = F.when(x["root"] == y["root"], F.lit(1.0)).otherwise(F.least(dice, 1.0 - 1.0 / (total + 1.0)))
    return opened.withColumn(name, value).drop("_a", "_b")


def _first_unequal(a: Column, b: Column) -> Column:
    """Index of the first position where two arrays differ; null if nowhere."""
    return F.element_at(F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b))), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i))), 1)


def first_difference(a: Column, b: Column) -> tuple[Column, Column]:
    """(section, paragraph in it) where two trees first differ, from 0; null for equal roots.

    Only the first section whose hashes differ is opened.
    """
    section = F.when(a["root"] != b["root"], _first_unequal(a["sections"], b["sections"]))
    empty = F.array().cast("array<string>")
    of = lambda x: F.coalesce(F.get(x["paragraphs"], section), empty)
    return section, F.when(section.isNotNull(), _first_unequal(of(a), of(b)))


def with_next(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Each row with the text and tree of the row after it in descending ``key``; the last is followed by the first.

    Nulls of ``key`` come last, ties are ordered by text. The keys are cut into ranges at real keys (approximate
    quantiles, a few per shuffle partition; only these cuts go to the driver). The highest row of a range is also
    sent to the range above, whose last row it follows, so that texts are shuffled once and no window spans the table.
    """
    spark = df.sparkSession
    ranges = 4 * shuffle_partitions(spark)
    order = F.coalesce(F.col(key), F.lit(-(2**63)))
    found = df.select(F.percentile_approx(order, [i / ranges for i in range(1, ranges + 1)], 8 * ranges)).head()
    cuts = sorted(set(found[0] or [])) if found else []
    if not cuts:
        cuts = [0]
    # number of cuts below a key, by binary search
    steps = len(cuts).bit_length() + 1
    array = F.array(*[F.lit(c).cast("long") for c in cuts])
    search = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")),
        lambda acc, _: F.when(acc["lo"] >= acc["hi"], acc).otherwise(
            F.when(
                F.get(array, F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")) < F.col("_key"),
                F.struct((F.floor((acc["lo"] + acc["hi"]) / 2).cast("int") + 1).alias("lo"), acc["hi"].alias("hi")),
            ).otherwise(F.struct(acc["lo"].alias("lo"), F.floor((acc["lo"] + acc["hi"]) / 2).cast("int").alias("hi")))
        ),
        lambda acc: acc["lo"],
    )
    keyed = df.withColumn("_key", order).withColumn("_range", search)
    above = F.when(F.col("_range") == len(cuts) - 1, F.lit(0)).otherwise(F.col("_range") + 1)
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("copy"))
    # 1: follows the range above; 2: the first of all, follows the last of all
    copy = F.struct(above.alias("range"), F.when(F.col("_range") == len(cuts) - 1, F.lit(2)).otherwise(F.lit(1)).alias("copy"))
    sent = F.explode(F.when(F.get(array, F.col("_range")) == F.col("_key"), F.array(own, copy)).otherwise(F.array(own)))
    dealt = keyed.withColumn("_sent", sent).select("*", "_sent.range", "_sent.copy").drop("_sent", "_range")
    dealt = with_tree(dealt.repartition(shuffle_partitions(spark), "range"), text)
    window = Window.partitionBy("range").orderBy("copy", F.desc("_key"), text)
    follower = F.lead(F.struct(F.col(text).alias("text"), F.col("tree").alias("tree"))).over(window)
    return dealt.withColumn("next", follower).filter(F.col("copy") == 0).drop("range", "copy", "_key")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text: the last third replaced by the start of the next document's.

    Reads doc_id and text. One row per row; see the module for nulls and ties.
    """
    rows = with_next(docs.select("doc_id", "text"), "doc_id")
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.withColumn("n_chars", F.char_length(whole).cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring(whole, F.lit(1), F.col("n_chars").cast("int") - cut)
    edited = F.concat(kept, F.substring(F.coalesce(F.col("next.text"), F.lit("")), F.lit(1), cut))
    rows = rows.withColumn("edited", edited)
    rows = with_tree(rows, "edited", "edited_tree")
    rows = likeness(likeness(rows, "tree", "edited_tree", "near_edited"), "tree", "next.tree", "near_next")
    tree, edited_tree = F.col("tree"), F.col("edited_tree")
    section, paragraph = first_difference(tree, edited_tree)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        tree["root"].alias("fingerprint"),
        edited_tree["root"].alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        section.cast("int").alias("edited_section"),
        paragraph.cast("int").alias("edited_paragraph"),
    )
