"""Cleaning, scoring and validating article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import blank_to_null, clean_label, is_present, strip, strip_label_prefix, year_of
from .ordered import CHUNK, duplicate_numbers, number_gaps

# --- fixed values: older column names -> current names, and the column order of results ---
RENAMES = {
    "Tip_Act": "act_type",
    "Nr": "act_number",
    "Data_An": "act_date",
    "Denumire": "title",
    "Mof_nr": "gazette_nr",
    "Mof_Data": "gazette_date",
    "Mof_An": "gazette_year",
    "Emitent": "issuer",
    "Titlu_Nr": "title_nr",
    "Titlu_Denumire": "title_name",
    "Capitol_Nr": "chapter_nr",
    "Capitol_Denumire": "chapter_name",
    "Sectiune_Nr": "section_nr",
    "Sectiune_Denumire": "section_name",
    "Subsectiune_Nr": "subsection_nr",
    "Subsectiune_Denumire": "subsection_name",
    "Art.1": "article_number",
    "Articol_Label": "article_label",
    "Text_Articol": "text",
}
COLUMN_ORDER = (
    "act_type",
    "act_number",
    "act_date",
    "act_year",
    "title",
    "issuer",
    "gazette_nr",
    "gazette_date",
    "gazette_year",
    "title_nr",
    "title_name",
    "chapter_nr",
    "chapter_name",
    "section_nr",
    "section_name",
    "subsection_nr",
    "subsection_name",
    "article_number",
    "article_label",
    "text",
    "issue",
    "explanation",
)


def unify_columns(df: DataFrame, renames: dict[str, str] = RENAMES, order: tuple[str, ...] = COLUMN_ORDER) -> DataFrame:
    """Old column names to current ones; where both exist the current one wins. Fixed column order."""
    present = set(df.columns)
    quoted = lambda n: F.col(f"`{n}`")
    chosen: dict[str, Column] = {}
    for name in df.columns:
        target = renames.get(name, name)
        if name == "Art.2" or name == "art_idx":
            continue
        if target != name and target in present:
            continue
        chosen.setdefault(target, quoted(name).alias(target))
    first = [c for c in order if c in chosen]
    rest = [c for c in chosen if c not in order]
    return df.select(*[chosen[c] for c in first + rest])


def with_defaults(df: DataFrame, names: tuple[str, ...] = ("issue", "explanation")) -> DataFrame:
    """Add '' columns that are missing."""
    return df.withColumns({n: F.lit("") for n in names if n not in df.columns})


def blanks_to_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: blank_to_null(c) for c in columns})


def drop_blank_articles(df: DataFrame, *, text: str = "text") -> DataFrame:
    return df.where(F.length(strip(text)) > 0)


def drop_short_articles(df: DataFrame, *, text: str = "text", longer_than: int = 5) -> DataFrame:
    return df.where(F.length(strip(text)) > longer_than)


def first_row_metadata(df: DataFrame, columns: list[str], *, group: str = "file", order: str = "ordinal") -> DataFrame:
    """The ``columns`` of each group's first row; one partial aggregate per group, no sort."""
    first = F.min_by(F.struct(*columns), order).alias("first")
    return df.groupBy(group).agg(first).select(group, "first.*")


def dedupe_longest(
    df: DataFrame, *, group: str = "act_id", number: str = "article_number", text: str = "text", order: str = "ordinal"
) -> DataFrame:
    """Per article number the row with the longest text, the earliest on ties.

    A maximum of structs combines map-side, so a number repeated a billion times is no
    hot task. Rows without a number are all kept.
    """
    others = [c for c in df.columns if c not in (group, number)]
    rank = F.struct(F.length(text).alias("l"), (-F.col(order)).alias("o"))
    numbered = df.where(F.col(number).isNotNull())
    kept = numbered.groupBy(group, number).agg(F.max_by(F.struct(*others), rank).alias("best"))
    kept = kept.select(group, number, "best.*").select(*df.columns)
    return kept.unionByName(df.where(F.col(number).isNull()))


def post_process(articles: DataFrame, *, group: str = "act_id", order: str = "ordinal") -> DataFrame:
    """Labels cut to ``Articolul N``, short rows dropped, longest per number kept, label prefix removed."""
    rows = articles.withColumn("article_label", clean_label("article_label"))
    for date, year in (("act_date", "act_year"), ("gazette_date", "gazette_year")):
        if date in rows.columns:
            rows = rows.withColumn(year, year_of(F.col(date).cast("string")))
    rows = drop_short_articles(rows)
    rows = dedupe_longest(rows, group=group, order=order)
    rows = rows.withColumn("text", strip_label_prefix("text", F.coalesce("article_label", F.lit(""))))
    return with_defaults(rows)


def confidence_score(
    articles: DataFrame,
    *,
    group: str,
    label: str = "article_label",
    text: str = "text",
    structure: tuple[str, ...] = ("chapter_nr", "section_nr"),
    metadata: tuple[str, ...] = ("act_type", "act_number"),
    weights: dict[str, float] = vocab.CONFIDENCE_WEIGHTS,
) -> DataFrame:
    """Weighted score per document, on all article rows before short ones are dropped."""

    def any_set(columns: tuple[str, ...]) -> Column:
        test = F.lit(False)
        for c in columns:
            test = test | ~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0")
        return F.max(test)

    scored = articles.groupBy(group).agg(
        F.count("*").alias("n_articles"),
        F.max(is_present(label)).alias("has_articles"),
        any_set(structure).alias("has_structure"),
        (F.avg(F.coalesce(F.length(text), F.lit(0))) > 50).alias("has_content"),
        any_set(metadata).alias("has_metadata"),
    )
    score = sum((F.when(F.col(name), F.lit(w)).otherwise(0.0) for name, w in weights.items()), F.lit(0.0))
    return scored.withColumn("confidence", F.round(score, 2))


def document_statistics(
    articles: DataFrame,
    *,
    group: str,
    text: str = "text",
    chapter: str = "chapter_nr",
    section: str = "section_nr",
) -> DataFrame:
    """Counts, characters and distinct chapters/sections per document.

    Distinct levels are counted in two steps (level, then document), so one document
    with very many rows is spread over the cluster.
    """
    levels = articles.groupBy(group, F.col(chapter).alias("c"), F.col(section).alias("s")).agg(
        F.count("*").alias("n"),
        F.count_if(F.length(text) > 10).alias("n_content"),
        F.sum(F.length(text)).alias("chars"),
        F.count(text).alias("n_text"),
    )
    return levels.groupBy(group).agg(
        F.sum("n").alias("n_articles"),
        F.sum("n_content").alias("n_with_content"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("n_chars"),
        F.round(F.sum("chars") / F.sum("n_text"), 4).alias("mean_chars"),
        F.count_distinct("c").alias("n_chapters"),
        F.count_distinct("s").alias("n_sections"),
    )


def validate_extraction(
    articles: DataFrame,
    *,
    group: str = "act_id",
    number: str = "article_number",
    text: str = "text",
    min_text: int = vocab.MIN_TEXT_LENGTH,
) -> DataFrame:
    """Per document: duplicated numbers, missing numbers, short texts, and a score.

    0.15 is taken off per kind of problem. Missing numbers are counted from the span and
    the distinct count; the lists themselves are `number_gaps` and `duplicate_numbers`.
    """
    per_number = articles.groupBy(group, F.col(number).alias("number")).agg(
        F.count("*").alias("n"), F.count_if(F.length(text) < min_text).alias("n_short")
    )
    numbered = F.col("number").isNotNull()
    per_doc = per_number.groupBy(group).agg(
        F.sum("n").alias("n_articles"),
        F.count_if(numbered & (F.col("n") > 1)).alias("n_duplicated"),
        F.coalesce(F.max("number") - F.min("number") + 1 - F.count("number"), F.lit(0)).cast("long").alias("n_missing"),
        F.sum("n_short").alias("n_short"),
    )
    kinds = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in ("n_duplicated", "n_missing", "n_short")), F.lit(0))
    return per_doc.withColumn("n_issues", kinds).withColumns(
        {
            "is_valid": F.col("n_issues") == 0,
            "quality_score": F.round(F.greatest(F.lit(0.0), 1.0 - F.col("n_issues") * 0.15), 2),
        }
    )


def validation_details(
    articles: DataFrame, *, group: str = "act_id", number: str = "article_number", chunk: int = CHUNK
) -> DataFrame:
    """Long form of what validation found: one row per duplicated number or missing run."""
    duplicates = duplicate_numbers(articles, group=group, number=number).select(
        group, F.lit("duplicate").alias("problem"), F.col(number).cast("long").alias("first"), F.col(number).cast("long").alias("last")
    )
    gaps = number_gaps(articles, group=group, number=number, chunk=chunk).select(
        group, F.lit("missing").alias("problem"), F.col("gap_start").alias("first"), F.col("gap_end").alias("last")
    )
    return duplicates.unionByName(gaps)
