"""Quality rules over Markdown documents and article tables.

A rule is an id, a severity and a function from columns to struct(passed, detail).
Adding one means adding a row to a rule list. Document rules run in one map-only pass
over the documents; the long result has one row per document and enabled rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_column, let, strip
from .ordered import CHUNK, order_violations

Check = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str  # error | warning | info
    check: Check
    enabled: bool = True


def outcome(passed: Column, detail: Column | str) -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.coalesce(passed, F.lit(False)).alias("passed"), detail.alias("detail"))


def _found(n: Column, examples: Column | None = None) -> Column:
    text = F.concat(F.lit("found "), n.cast("string"))
    if examples is None:
        return text
    return F.concat(text, F.lit(": "), F.array_join(examples, " | "))


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def _examples(lines: Column, n: int = 3, width: int = 80) -> Column:
    return F.transform(F.slice(lines, 1, n), lambda x: F.substring(strip(x), 1, width))


# --- fixed values: markers a rendered document has ---
FENCE = "---\n"
INDEX = "## INDEX"
ARTICLES = "## ARTICOLE"
REQUIRED_FIELDS = ("tip_act", "data_act", "total_articole")
CONTEXT = r"\*\*Context ierarhic:\*\*"
HEADING = r"### Articolul \d+"
PARAGRAPH = r"\*\*\(\d+\)\*\*"
LETTER = r"\*\*[a-z]\)\*\*"
FLAT_LETTER = r"^\*\*[a-z]\)\*\*"
UNFORMATTED = r"(?<!\*\*)\(\d+\)(?!\*\*)"
REFERENCE = r"(?U)\b(alin\.|art\.|punct|pct\.)\s*\(\d+\)"
BOLD_REFERENCES = (
    r"\*\*lit\.\s*[a-z]\)\*\*",
    r"\*\*alin\.\s*\(\d+\)\*\*",
    r"\*\*art\.\s*\d+\*\*",
    r"\*\*pct\.\s*\d+\*\*",
)
_LINK = r"\[([^\]]+)\]\(#([^\)]+)\)"


def _count_text(c: Column, literal: str) -> Column:
    shorter = F.replace(c, F.lit(literal), F.lit(""))
    return ((F.length(c) - F.length(shorter)) / len(literal)).cast("int")


def metadata_header(c: Column) -> Column:
    starts, closed = c.startswith(FENCE), _count_text(c, FENCE) >= 2
    detail = F.when(~starts, "no metadata block at the start").when(~closed, "metadata block is not closed").otherwise("present")
    return outcome(starts & closed, detail)


def has_index(c: Column) -> Column:
    return outcome(c.contains(INDEX), F.when(c.contains(INDEX), "present").otherwise("missing"))


def has_articles(c: Column) -> Column:
    return outcome(c.contains(ARTICLES), F.when(c.contains(ARTICLES), "present").otherwise("missing"))


def paragraphs_formatted(c: Column) -> Column:
    return outcome(F.lit(True), _found(F.regexp_count(c, F.lit(PARAGRAPH))))


def no_unformatted_paragraphs(c: Column) -> Column:
    bad = F.filter(_lines(c), lambda x: x.rlike(UNFORMATTED) & ~x.rlike(REFERENCE))
    return let(bad, lambda b: outcome(F.size(b) == 0, _found(F.size(b), _examples(b))))


def letters_formatted(c: Column) -> Column:
    return outcome(F.lit(True), _found(F.regexp_count(c, F.lit(LETTER))))


def letters_indented(c: Column) -> Column:
    bad = F.filter(_lines(c), lambda x: x.rlike(FLAT_LETTER))
    return let(bad, lambda b: outcome(F.size(b) == 0, _found(F.size(b), _examples(b, width=60))))


def references_not_bold(c: Column) -> Column:
    hits = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in BOLD_REFERENCES])
    return let(hits, lambda h: outcome(F.size(h) == 0, _found(F.size(h), _examples(h, n=5))))


def index_section(c: Column) -> Column:
    """Text after the index heading up to the next heading of exactly level 2."""
    after = F.substring_index(c, INDEX, 2)
    after = after.substr(F.instr(after, F.lit(INDEX)) + len(INDEX), F.length(after))
    return F.get(F.split(after, r"(?m)^##(?!#)"), F.lit(0))


def index_links(c: Column) -> Column:
    """Array of struct(text, anchor) of the index section."""
    section = index_section(c)
    return F.arrays_zip(
        F.regexp_extract_all(section, F.lit(_LINK), F.lit(1)).alias("text"),
        F.regexp_extract_all(section, F.lit(_LINK), F.lit(2)).alias("anchor"),
    )


def index_links_valid(c: Column) -> Column:
    def judge(s: Column) -> Column:
        anchors = F.regexp_extract_all(s, F.lit(_LINK), F.lit(2))
        bad = F.filter(anchors, lambda a: ~a.rlike(r"^[a-z0-9-]+$"))
        detail = F.when(F.size(anchors) == 0, "the index holds no links").otherwise(_found(F.size(bad), _examples(bad)))
        return outcome((F.size(anchors) > 0) & (F.size(bad) == 0), detail)

    return F.when(c.contains(INDEX), let(index_section(c), judge)).otherwise(outcome(F.lit(True), "no index"))


def index_links_working(c: Column) -> Column:
    """Every linked text or anchor must be a level-3 heading of the document."""

    def judge(s: Column) -> Column:
        headings = F.regexp_extract_all(c, F.lit(r"(?m)^### (.+)$"), F.lit(1))
        texts = F.regexp_extract_all(s, F.lit(_LINK), F.lit(1))
        broken = F.array_except(texts, headings)  # hash based: linear in links and headings
        return let(broken, lambda b: outcome(F.size(b) == 0, _found(F.size(b), _examples(b))))

    return F.when(c.contains(INDEX), let(index_section(c), judge)).otherwise(outcome(F.lit(True), "no index"))


def metadata_complete(c: Column) -> Column:
    section = F.get(F.split(c, FENCE), F.lit(1))
    missing = F.concat_ws(", ", *[F.when(~F.coalesce(section.contains(f"{f}:"), F.lit(False)), f) for f in REQUIRED_FIELDS])
    detail = F.when(~c.startswith(FENCE), "no metadata block").otherwise(F.concat(F.lit("missing: "), missing))
    return outcome(c.startswith(FENCE) & (missing == ""), detail)


def articles_have_context(c: Column) -> Column:
    n_articles, n_contexts = F.regexp_count(c, F.lit(HEADING)), F.regexp_count(c, F.lit(CONTEXT))
    detail = F.concat(n_contexts.cast("string"), F.lit("/"), n_articles.cast("string"))
    return outcome((n_articles > 0) & (n_contexts >= n_articles), detail)


def no_extra_spaces(c: Column) -> Column:
    n = F.regexp_count(c, F.lit(" {3,}"))
    return outcome(n == 0, _found(n))


def no_extra_newlines(c: Column) -> Column:
    n = F.regexp_count(c, F.lit("\n{3,}"))
    return outcome(n == 0, _found(n))


DOCUMENT_RULES = (
    Rule("has_metadata_header", "error", metadata_header),
    Rule("has_index", "error", has_index),
    Rule("has_articles", "error", has_articles),
    Rule("paragraphs_formatted", "warning", paragraphs_formatted),
    Rule("no_unformatted_paragraphs", "warning", no_unformatted_paragraphs),
    Rule("letters_formatted", "warning", letters_formatted),
    Rule("letters_indented", "warning", letters_indented),
    Rule("references_not_bold", "warning", references_not_bold),
    Rule("index_links_valid", "warning", index_links_valid),
    Rule("index_links_working", "error", index_links_working),
    Rule("metadata_complete", "warning", metadata_complete),
    Rule("articles_have_context", "info", articles_have_context),
    Rule("no_extra_spaces", "warning", no_extra_spaces),
    Rule("no_extra_newlines", "info", no_extra_newlines),
)


def check_documents(
    documents: DataFrame, *, file: str = "file", content: str = "content", rules: tuple[Rule, ...] = DOCUMENT_RULES
) -> DataFrame:
    """(file, rule, severity, passed, detail) for every document and enabled rule."""
    results = [
        F.struct(
            F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), r.check(as_column(content)).alias("result")
        )
        for r in rules
        if r.enabled
    ]
    long = documents.select(file, F.explode(F.array(*results)).alias("r"))
    return long.select(file, "r.rule", "r.severity", "r.result.passed", "r.result.detail")


def broken_index_links(documents: DataFrame, *, file: str = "file", content: str = "content") -> DataFrame:
    """(file, text, anchor) of index links whose text is no heading of the document, one row each."""
    links = documents.select(file, F.explode(index_links(F.col(content))).alias("l")).select(file, "l.*")
    pattern = F.lit(r"(?m)^### (.+)$")
    headings = documents.select(file, F.explode(F.regexp_extract_all(content, pattern, F.lit(1))).alias("text"))
    return links.join(headings.distinct(), [file, "text"], "left_anti").select(file, "text", "anchor")


# ---------------------------------------------------------------- article tables

ARTICLE_RULES = (
    ("has_required_columns", "error"),
    ("no_empty_articles", "error"),
    ("articles_have_numbers", "warning"),
    ("issue_column_exists", "warning"),
    ("explanation_column_exists", "warning"),
    ("metadata_consistent", "warning"),
    ("has_hierarchy", "info"),
    ("article_numbers_sequential", "info"),
)


def check_articles(
    articles: DataFrame,
    *,
    file: str = "file",
    order: str = "ordinal",
    text: str = "text",
    number: str = "article_number",
    kind: str = "element_kind",
    issue: str = "issue",
    explanation: str = "explanation",
    hierarchy: tuple[str, ...] = ("chapter_name", "section_name"),
    metadata: tuple[str, ...] = ("act_type", "act_number", "act_year"),
    enabled: tuple[str, ...] = tuple(r for r, _ in ARTICLE_RULES),
    chunk: int = CHUNK,
    header: str | None = None,
) -> DataFrame:
    """Rule results per file over article rows.

    Which columns a file has is read from the schema, or from ``header``, an array of names with each row where
    files differ.

    All row rules share one aggregate with map-side combine. Only the order rule needs
    neighbours, and takes them from chunks of a file.
    """
    columns = set(articles.columns)

    def has(name: str) -> Column:
        """Whether the file of a row, or of a group, has a column."""
        if name not in columns or header is None:
            return F.lit(name in columns)
        return F.coalesce(F.array_contains(header, name), F.lit(False))

    is_article = F.when(has(kind), F.col(kind) == "articol").otherwise(True) if kind in columns else F.lit(True)
    required = (kind, text, issue, explanation)

    aggregates = [F.count_if(is_article).alias("n")]
    aggregates.append((F.count_if(is_article & (F.coalesce(F.col(text), F.lit("")) == "")) if text in columns else F.lit(0)).alias("n_empty"))
    aggregates.append((F.count_if(is_article & F.col(number).isNull()) if number in columns else F.lit(0)).alias("n_unnumbered"))
    for c in metadata:
        if c in columns:
            aggregates.append((F.min(c) != F.max(c)).alias(f"_mixed_{c}"))
    for c in hierarchy:
        if c in columns:
            aggregates.append(F.count(c).alias(f"_level_{c}"))
    if header is not None:
        aggregates.append(F.max(header).alias(header))
    per_file = articles.groupBy(file).agg(*aggregates)

    if number in columns and kind in columns:
        checked = articles.where(is_article & has(number) & has(kind))
        breaks = order_violations(checked, group=file, order=order, number=number, chunk=chunk)
        breaks = breaks.groupBy(file).agg(F.count("*").alias("n_breaks"))
        per_file = per_file.join(breaks, file, "left").na.fill({"n_breaks": 0})
        unchecked = ~(has(number) & has(kind))
        sequential = outcome(unchecked | (F.col("n_breaks") == 0), F.when(unchecked, "columns missing, not checked").otherwise(_found(F.col("n_breaks"))))
    else:
        sequential = outcome(F.lit(True), "columns missing, not checked")

    missing = F.concat_ws(", ", *[F.when(~has(c), c) for c in required])
    mixed = [c for c in metadata if c in columns]
    names = F.concat_ws(", ", *[F.when(F.col(f"_mixed_{c}"), c) for c in mixed]) if mixed else F.lit("")
    levels = [c for c in hierarchy if c in columns]
    filled = F.concat_ws(", ", *[F.when(F.col(f"_level_{c}") > 0, c) for c in levels]) if levels else F.lit("")
    results = {
        "has_required_columns": outcome(missing == "", F.concat(F.lit("missing: "), missing)),
        "no_empty_articles": outcome(has(text) & (F.col("n_empty") == 0), _found(F.col("n_empty"))),
        "articles_have_numbers": outcome(has(number) & (F.col("n_unnumbered") == 0), _found(F.col("n_unnumbered"))),
        "issue_column_exists": outcome(has(issue), "column " + issue),
        "explanation_column_exists": outcome(has(explanation), "column " + explanation),
        "metadata_consistent": outcome(names == "", names),
        "has_hierarchy": outcome(filled != "", filled),
        "article_numbers_sequential": sequential,
    }
    rows = [
        F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), results[rule].alias("result"))
        for rule, severity in ARTICLE_RULES
        if rule in enabled
    ]
    long = per_file.select(file, F.explode(F.array(*rows)).alias("r"))
    return long.select(file, "r.rule", "r.severity", "r.result.passed", "r.result.detail")


def check_pairs(articles: DataFrame, documents: DataFrame, *, stem: str = "stem", content: str = "content", **options) -> DataFrame:
    """Both rule sets per stem. A CSV without a Markdown file gets one error row instead."""
    stems = articles.select(stem).distinct()
    missing = stems.join(documents.select(stem).distinct(), stem, "left_anti").select(
        stem,
        F.lit("pair").alias("file_type"),
        F.lit("markdown_missing").alias("rule"),
        F.lit("error").alias("severity"),
        F.lit(False).alias("passed"),
        F.concat(F.lit("missing file: "), F.col(stem), F.lit(".md")).alias("detail"),
    )
    paired_articles = articles.join(documents.select(stem).distinct(), stem, "left_semi")
    paired_documents = documents.join(stems, stem, "left_semi")
    csv = check_articles(paired_articles, file=stem, **options).withColumn("file_type", F.lit("csv"))
    md = check_documents(paired_documents, file=stem, content=content).withColumn("file_type", F.lit("markdown"))
    return missing.unionByName(csv).unionByName(md)


def quality_report(results: DataFrame, *, file: str = "file") -> DataFrame:
    """Counters and success percentage per file.

    Rule results per file are as many as there are rules, so a group stays small.
    """
    failed = ~F.col("passed")
    report = results.groupBy(file).agg(
        F.count("*").alias("n_checks"),
        F.count_if(F.col("passed")).alias("n_passed"),
        F.count_if(failed & (F.col("severity") == "error")).alias("n_errors"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("n_warnings"),
        F.count_if(failed & (F.col("severity") == "info")).alias("n_info"),
    )
    return report.withColumn("success_percent", F.round(F.col("n_passed") * 100.0 / F.col("n_checks"), 1))


def quality_messages(results: DataFrame, *, file: str = "file") -> DataFrame:
    """One row per failed rule: ``[rule] detail``."""
    return results.where(~F.col("passed")).select(
        file, "severity", F.concat(F.lit("["), F.col("rule"), F.lit("] "), F.col("detail")).alias("message")
    )


def quality_summary(results: DataFrame, *, file: str = "file") -> DataFrame:
    """One row over all files: files, checks, percentage, files with errors."""
    report = quality_report(results, file=file)
    total = report.agg(
        F.count("*").alias("n_files"),
        F.coalesce(F.sum("n_checks"), F.lit(0)).alias("n_checks"),
        F.coalesce(F.sum("n_passed"), F.lit(0)).alias("n_passed"),
        F.count_if(F.col("n_errors") > 0).alias("n_files_with_errors"),
    )
    return total.withColumn("success_percent", F.round(F.col("n_passed") * 100.0 / F.nullif(F.col("n_checks"), F.lit(0)), 1))


# ---------------------------------------------------------------- integrity audits


def key_audit(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphan_audit(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child keys without a parent, with the number of child rows.

    Children are counted per key first, so the join meets one row per key.
    """
    per_key = child.where(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.count("*").alias("n_rows"))
    parents = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return per_key.join(parents, child_key, "left_anti")


def check_constraint_audit(table: DataFrame, key: str, constraints: dict[str, Column]) -> DataFrame:
    """(key, constraint) for every row and predicate that does not hold; NULL counts as holding."""
    broken = [F.when(~predicate, F.lit(name)) for name, predicate in constraints.items()]
    long = table.select(key, F.explode(F.array_compact(F.array(*broken))).alias("constraint"))
    return long


def one_of(column: str, values: tuple[str, ...]) -> Column:
    return F.col(column).isin(*values)


def not_blank(column: str) -> Column:
    return F.length(F.trim(column)) > 0


def in_unit_range(column: str) -> Column:
    return F.col(column).between(0, 1)


def at_most(column: str, length: int) -> Column:
    return F.length(column) <= length
