"""Quality rules over documents and article tables, reports, and integrity audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as q
from ..operators.quality_parts import check_parts, cut_parts
from ..operators.render import assemble, render_rows
from ..session import work_path
from ..sources.readers import read_markdown_parts
from ..sources.sinks import write_markdown
from . import Registry
from .bind import DOC_LINES_SQL, ISSUES_SQL, LINKS_SQL, doc_lines, documents, issues, links, strip_sql, table, with_ctes

REGISTRY = Registry()

# whole texts inside a rendered frame; by document some part of the frame is missing or wrong
_FRAME = (
    (4, {0: ""}, "---\ntip_act: x\n"),
    (4, {0: "", 1: ""}, "data_act: 1\n"),
    (4, {0: ""}, "total_articole: 2\n---\n\n"),
    (5, {0: ""}, "## INDEX\n\n- [Articolul 1](#articolul-1)\n"),
    (5, {0: "", 1: "- [Articolul 2](#Art_2)\n", 2: "- [Articolul 9](#articolul-9)\n"}, "- [Articolul 2](#articolul-2)\n"),
    (6, {0: "\n"}, "\n## ARTICOLE\n\n"),
    (1, {}, "### Articolul 1\n\n**Context ierarhic:**\n\n**(1)**\n\n"),
    (1, None, None),
    (1, {}, "\n\n### Articolul 2\n\n"),
    (3, {0: ""}, "**Context ierarhic:**\n"),
    (7, {0: "(2) loose\nsee alin. (3)\n", 1: "see alin. (3) only\n"}, "  **a)** fine\n"),
    (8, {0: "**b)** bad\n**lit. c)** and **alin. (5)**\n"}, ""),
    (9, {0: "wide   gap\n", 1: "far\n\n\napart"}, "end"),
)


def _sql_text(text: str) -> str:
    return "E'" + text.replace("\n", "\\n") + "'"


def _frame_sql() -> str:
    parts = []
    for modulus, cases, default in _FRAME:
        if cases is None:
            parts.append("text")
        elif not cases:
            parts.append(_sql_text(default))
        else:
            whens = " ".join(f"WHEN {k} THEN {_sql_text(v)}" for k, v in cases.items())
            parts.append(f"CASE doc_id % {modulus} {whens} ELSE {_sql_text(default)} END")
    return " || ".join(parts)


DOCS_SQL = f"docs AS (SELECT doc_id, {_frame_sql()} AS c FROM documents)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for modulus, cases, default in _FRAME:
        if cases is None:
            parts.append(F.col("text"))
            continue
        part = F.lit(default)
        for k, v in (cases or {}).items():
            part = F.when(F.col("doc_id") % modulus == k, F.lit(v)).otherwise(part)
        parts.append(part)
    return documents(spark, sf_dir).select("doc_id", F.concat(*parts).alias("content"))


_LINES = "string_split(c, chr(10))"
_SECTION = "regexp_split_to_array(substr(c, strpos(c, '## INDEX') + 8), '(?m)^##[^#]')[1]"
_LINKS = rf"regexp_extract_all({_SECTION}, '\[([^\]]+)\]\(#([^\)]+)\)'"
_UNFORMATTED = r"(^|[^*]|(^|[^*])\*)\([0-9]+\)($|[^*]|\*($|[^*]))"
_REFERENCE = r"(^|[^\p{L}\p{N}_])(alin\.|art\.|punct|pct\.)\s*\([0-9]+\)"
_RULE_SQL = {
    "has_metadata_header": r"starts_with(c, E'---\n') AND len(string_split(c, E'---\n')) > 2",
    "has_index": "contains(c, '## INDEX')",
    "has_articles": "contains(c, '## ARTICOLE')",
    "paragraphs_formatted": "true",
    "no_unformatted_paragraphs": f"len([x FOR x IN {_LINES} IF regexp_matches(x, '{_UNFORMATTED}') AND NOT regexp_matches(x, '{_REFERENCE}')]) = 0",
    "letters_formatted": "true",
    "letters_indented": rf"len([x FOR x IN {_LINES} IF regexp_matches(x, '^\*\*[a-z]\)\*\*')]) = 0",
    "references_not_bold": r"NOT regexp_matches(c, '\*\*lit\.\s*[a-z]\)\*\*|\*\*alin\.\s*\([0-9]+\)\*\*|\*\*art\.\s*[0-9]+\*\*|\*\*pct\.\s*[0-9]+\*\*')",
    "index_links_valid": f"NOT contains(c, '## INDEX') OR (len({_LINKS}, 2)) > 0 AND len([a FOR a IN {_LINKS}, 2) IF NOT regexp_matches(a, '^[a-z0-9-]+$')]) = 0)",
    "index_links_working": f"NOT contains(c, '## INDEX') OR len([t FOR t IN {_LINKS}, 1) IF NOT list_contains(regexp_extract_all(c, '(?m)^### (.+)$', 1), t)]) = 0",
    "metadata_complete": r"starts_with(c, E'---\n') AND contains(string_split(c, E'---\n')[2], 'tip_act:') AND contains(string_split(c, E'---\n')[2], 'data_act:') AND contains(string_split(c, E'---\n')[2], 'total_articole:')",
    "articles_have_context": r"len(regexp_extract_all(c, '### Articolul [0-9]+')) > 0 AND len(regexp_extract_all(c, '\*\*Context ierarhic:\*\*')) >= len(regexp_extract_all(c, '### Articolul [0-9]+'))",
    "no_extra_spaces": "NOT regexp_matches(c, ' {3,}')",
    "no_extra_newlines": r"NOT regexp_matches(c, '\n\n\n')",
}
_SEVERITY = {r.id: r.severity for r in q.DOCUMENT_RULES}
_STRUCTS = ",\n".join(
    f"{{'rule': '{rule}', 'severity': '{_SEVERITY[rule]}', 'passed': ({sql})}}" for rule, sql in _RULE_SQL.items()
)
RESULTS_SQL = f"""results AS (SELECT doc_id, r.rule AS rule, r.severity AS severity, r.passed AS passed FROM (SELECT doc_id, unnest([{_STRUCTS}]) AS r FROM docs))"""




def _shown_sql(found: str, n: int = 3, width: int = 80) -> str:
    return f"array_to_string([substr({strip_sql('x')}, 1, {width}) FOR x IN ({found})[1:{n}]], ' | ')"


def _found_sql(found: str, n: int = 3, width: int = 80) -> str:
    return f"'found ' || CAST(len({found}) AS VARCHAR) || ': ' || {_shown_sql(found, n, width)}"


_BOLD = "list_concat(" * 3 + ", ".join(
    rf"regexp_extract_all(c, '{p}')" + (")" if i else "")
    for i, p in enumerate((r"\*\*lit\.\s*[a-z]\)\*\*", r"\*\*alin\.\s*\([0-9]+\)\*\*", r"\*\*art\.\s*[0-9]+\*\*", r"\*\*pct\.\s*[0-9]+\*\*"))
)
_TEXTS, _HEADINGS = f"{_LINKS}, 1)", "regexp_extract_all(c, '(?m)^### (.+)$', 1)"
_FIELDS = "concat_ws(', ', " + ", ".join(f"CASE WHEN NOT coalesce(contains(string_split(c, E'---\\n')[2], '{f}:'), false) THEN '{f}' END" for f in q.REQUIRED_FIELDS) + ")"
_DETAIL_SQL = {
    "has_metadata_header": r"CASE WHEN NOT starts_with(c, E'---\n') THEN 'no metadata block at the start' WHEN len(string_split(c, E'---\n')) < 3 THEN 'metadata block is not closed' ELSE 'present' END",
    "has_index": "CASE WHEN contains(c, '## INDEX') THEN 'present' ELSE 'missing' END",
    "has_articles": "CASE WHEN contains(c, '## ARTICOLE') THEN 'present' ELSE 'missing' END",
    "paragraphs_formatted": r"'found ' || CAST(len(regexp_extract_all(c, '\*\*\([0-9]+\)\*\*')) AS VARCHAR)",
    "no_unformatted_paragraphs": _found_sql(f"[x FOR x IN {_LINES} IF regexp_matches(x, '{_UNFORMATTED}') AND NOT regexp_matches(x, '{_REFERENCE}')]"),
    "letters_formatted": r"'found ' || CAST(len(regexp_extract_all(c, '\*\*[a-z]\)\*\*')) AS VARCHAR)",
    "letters_indented": _found_sql(rf"[x FOR x IN {_LINES} IF regexp_matches(x, '^\*\*[a-z]\)\*\*')]", width=60),
    "references_not_bold": _found_sql(_BOLD, n=5),
    "index_links_valid": f"CASE WHEN NOT contains(c, '## INDEX') THEN 'no index' WHEN len({_LINKS}, 2)) = 0 THEN 'the index holds no links' ELSE {_found_sql(f'[a FOR a IN {_LINKS}, 2) IF NOT regexp_matches(a, {chr(39)}^[a-z0-9-]+${chr(39)})]')} END",
    "index_links_working": f"CASE WHEN NOT contains(c, '## INDEX') THEN 'no index' ELSE {_found_sql(f'list_filter({_TEXTS}, lambda t, i: list_position({_TEXTS}, t) = i AND NOT list_contains({_HEADINGS}, t))')} END",
    "metadata_complete": rf"CASE WHEN NOT starts_with(c, E'---\n') THEN 'no metadata block' ELSE 'missing: ' || {_FIELDS} END",
    "articles_have_context": r"CAST(len(regexp_extract_all(c, '\*\*Context ierarhic:\*\*')) AS VARCHAR) || '/' || CAST(len(regexp_extract_all(c, '### Articolul [0-9]+')) AS VARCHAR)",
    "no_extra_spaces": "'found ' || CAST(len(regexp_extract_all(c, ' {3,}')) AS VARCHAR)",
    "no_extra_newlines": r"'found ' || CAST(len(regexp_extract_all(c, '\n\n\n+')) AS VARCHAR)",
}
_DETAILS = ",\n".join(
    f"{{'rule': '{rule}', 'severity': '{_SEVERITY[rule]}', 'passed': ({_RULE_SQL[rule]}), 'detail': {sql}}}" for rule, sql in _DETAIL_SQL.items()
)
DETAILS_SQL = f"""details AS (SELECT doc_id, r.rule AS rule, r.severity AS severity, r.passed AS passed, r.detail AS detail FROM (SELECT doc_id, unnest([{_DETAILS}]) AS r FROM docs))"""


def _results(spark, sf_dir):
    return q.check_documents(_docs(spark, sf_dir), file="doc_id")


@REGISTRY.query("quality_rules_md", with_ctes(DOCS_SQL, RESULTS_SQL, body="SELECT doc_id, rule, severity, passed FROM results"))
def quality_rules_md(spark, sf_dir):
    return _results(spark, sf_dir).select("doc_id", "rule", "severity", "passed")


@REGISTRY.query("quality_rule_details", with_ctes(DOCS_SQL, DETAILS_SQL, body="SELECT doc_id, rule, detail FROM details"))
def quality_rule_details(spark, sf_dir):
    """What every rule says about every document: counts and the first examples."""
    return _results(spark, sf_dir).select("doc_id", "rule", "detail")


PART_CHARS = 16_384


@REGISTRY.query("rendered_roundtrip", with_ctes(DOCS_SQL, DETAILS_SQL, body="SELECT doc_id, rule, severity, coalesce(passed, false) AS passed, detail FROM details"))
def rendered_roundtrip(spark, sf_dir):
    """Documents written as Markdown in parts of whole lines, read again part by part and judged without being gathered."""
    path = work_path(spark, "roundtrip")
    parts = cut_parts(_docs(spark, sf_dir), file="doc_id", part_chars=PART_CHARS)
    # a written block ends with a line break of its own; the frame's last line gets its end here
    blocks = parts.select(F.col("doc_id").alias("file_key"), "part", F.regexp_replace("content", r"\n\z", "").alias("block"))
    write_markdown(blocks, path, part="part", packed=True)
    results = check_parts(read_markdown_parts(spark, path), file="stem")
    return results.select(F.col("stem").cast("long").alias("doc_id"), "rule", "severity", "passed", "detail")


_REPORT_SQL = """report AS (SELECT doc_id, count(*) AS n_checks, count(*) FILTER (WHERE passed) AS n_passed, count(*) FILTER (WHERE NOT passed AND severity = 'error') AS n_errors,
  count(*) FILTER (WHERE NOT passed AND severity = 'warning') AS n_warnings, count(*) FILTER (WHERE NOT passed AND severity = 'info') AS n_info,
  round(count(*) FILTER (WHERE passed) * 100.0::DOUBLE / count(*), 1) AS success_percent FROM results GROUP BY doc_id)"""


@REGISTRY.query("quality_report", with_ctes(DOCS_SQL, RESULTS_SQL, _REPORT_SQL, body="SELECT * FROM report"))
def quality_report(spark, sf_dir):
    return q.quality_report(_results(spark, sf_dir), file="doc_id")


@REGISTRY.query(
    "quality_summary",
    with_ctes(
        DOCS_SQL,
        RESULTS_SQL,
        _REPORT_SQL,
        body="""SELECT count(*) AS n_files, CAST(sum(n_checks) AS BIGINT) AS n_checks, CAST(sum(n_passed) AS BIGINT) AS n_passed, count(*) FILTER (WHERE n_errors > 0) AS n_files_with_errors,
  round(sum(n_passed) * 100.0::DOUBLE / sum(n_checks), 1) AS success_percent FROM report""",
    ),
)
def quality_summary(spark, sf_dir):
    return q.quality_summary(_results(spark, sf_dir), file="doc_id")


@REGISTRY.query(
    "quality_messages",
    with_ctes(DOCS_SQL, DETAILS_SQL, body="SELECT doc_id, severity, '[' || rule || '] ' || detail AS message FROM details WHERE NOT coalesce(passed, false)"),
)
def quality_messages(spark, sf_dir):
    return q.quality_messages(_results(spark, sf_dir), file="doc_id")


@REGISTRY.query(
    "broken_index_links",
    with_ctes(DOCS_SQL, body="SELECT doc_id, 'Articolul 9' AS text, 'articolul-9' AS anchor FROM docs WHERE doc_id % 5 = 2"),
)
def broken_index_links(spark, sf_dir):
    return q.broken_index_links(_docs(spark, sf_dir), file="doc_id")


# ---------------------------------------------------------------- article tables

_TABLE_SQL = """rows AS (SELECT act_id, ordinal, CASE WHEN ordinal % 5 = 0 THEN 'titlu' ELSE 'articol' END AS element_kind, CASE WHEN ordinal % 11 = 7 THEN '' ELSE text END AS text,
   CASE WHEN act_id % 4 = 1 AND ordinal = 2 THEN NULL WHEN act_id % 6 = 0 AND ordinal = 3 THEN 1 ELSE ordinal END AS article_number,
   CASE WHEN act_id % 8 = 0 AND ordinal = 2 THEN 'B' ELSE 'A' END AS act_type, CASE WHEN act_id % 9 > 0 THEN ai_status END AS chapter_name,
   list_filter(['element_kind', 'text', 'article_number', 'issue', 'explanation'], lambda c: c <> CASE act_id % 13 WHEN 1 THEN 'text' WHEN 2 THEN 'article_number' WHEN 3 THEN 'issue' WHEN 4 THEN 'explanation' WHEN 5 THEN 'element_kind' ELSE '' END) AS header FROM articles)"""


def _article_table(spark, sf_dir):
    act, line = F.col("act_id"), F.col("ordinal")
    return doc_lines(spark, sf_dir).select(
        "act_id",
        "ordinal",
        F.when(line % 5 == 0, "titlu").otherwise("articol").alias("element_kind"),
        F.when(line % 11 == 7, "").otherwise(F.col("text")).alias("text"),
        F.when((act % 4 == 1) & (line == 2), None).when((act % 6 == 0) & (line == 3), 1).otherwise(line).alias("article_number"),
        F.when((act % 8 == 0) & (line == 2), "B").otherwise("A").alias("act_type"),
        F.when(act % 9 > 0, F.col("ai_status")).alias("chapter_name"),
        "issue",
        "explanation",
        _header(act % 13).alias("header"),
    )


def _header(turn):
    """The columns of an act's file; of some files one is missing."""
    lacks = {1: "text", 2: "article_number", 3: "issue", 4: "explanation", 5: "element_kind"}
    missing = F.coalesce(*[F.when(turn == k, name) for k, name in lacks.items()], F.lit(""))
    return F.filter(F.array(*[F.lit(c) for c in ("element_kind", "text", "article_number", "issue", "explanation")]), lambda c: c != missing)


_TABLE_RULES_SQL = """marked AS (SELECT *, NOT list_contains(header, 'element_kind') OR element_kind = 'articol' AS is_article FROM rows),
breaks AS (SELECT act_id, count(*) AS n FROM (SELECT act_id, article_number, lag(article_number) OVER (PARTITION BY act_id ORDER BY ordinal) AS before
     FROM marked WHERE is_article AND article_number IS NOT NULL AND list_contains(header, 'article_number') AND list_contains(header, 'element_kind')) WHERE before > article_number GROUP BY act_id),
per_file AS (SELECT act_id, max(header) AS header, count(*) FILTER (WHERE is_article AND text = '') AS n_empty, count(*) FILTER (WHERE is_article AND article_number IS NULL) AS n_unnumbered,
     count(DISTINCT act_type) AS n_types, count(chapter_name) AS n_chapters FROM marked GROUP BY act_id),
table_results AS (SELECT act_id, r.rule AS rule, r.severity AS severity, r.passed AS passed FROM (SELECT p.act_id, unnest([
  {'rule': 'has_required_columns', 'severity': 'error', 'passed': list_contains(header, 'element_kind') AND list_contains(header, 'text') AND list_contains(header, 'issue') AND list_contains(header, 'explanation')},
  {'rule': 'no_empty_articles', 'severity': 'error', 'passed': list_contains(header, 'text') AND n_empty = 0},
  {'rule': 'articles_have_numbers', 'severity': 'warning', 'passed': list_contains(header, 'article_number') AND n_unnumbered = 0}, {'rule': 'issue_column_exists', 'severity': 'warning', 'passed': list_contains(header, 'issue')},
  {'rule': 'explanation_column_exists', 'severity': 'warning', 'passed': list_contains(header, 'explanation')}, {'rule': 'metadata_consistent', 'severity': 'warning', 'passed': n_types <= 1},
  {'rule': 'has_hierarchy', 'severity': 'info', 'passed': n_chapters > 0}, {'rule': 'article_numbers_sequential', 'severity': 'info', 'passed': b.n IS NULL}]) AS r
  FROM per_file p LEFT JOIN breaks b ON p.act_id = b.act_id))"""


@REGISTRY.query(
    "quality_rules_table",
    with_ctes(DOC_LINES_SQL, _TABLE_SQL, _TABLE_RULES_SQL, body="SELECT act_id, rule, severity, passed FROM table_results"),
)
def quality_rules_table(spark, sf_dir):
    return q.check_articles(_article_table(spark, sf_dir), file="act_id", header="header").select("act_id", "rule", "severity", "passed")


@REGISTRY.query(
    "quality_pairs",
    with_ctes(
        DOC_LINES_SQL,
        _TABLE_SQL,
        _TABLE_RULES_SQL,
        DOCS_SQL,
        RESULTS_SQL,
        body="""SELECT act_id AS stem, 'pair' AS file_type, 'markdown_missing' AS rule, false AS passed FROM per_file WHERE act_id % 10 = 0
UNION ALL SELECT act_id, 'csv', rule, passed FROM table_results WHERE act_id % 10 > 0
UNION ALL SELECT doc_id, 'markdown', rule, passed FROM results WHERE doc_id % 10 > 0""",
    ),
)
def quality_pairs(spark, sf_dir):
    """Tables and documents by stem; every tenth table has no document."""
    tables = _article_table(spark, sf_dir).withColumnRenamed("act_id", "stem")
    docs = _docs(spark, sf_dir).where("doc_id % 10 > 0").withColumnRenamed("doc_id", "stem")
    return q.check_pairs(tables, docs, header="header").select("stem", "file_type", "rule", "passed")


# ---------------------------------------------------------------- audits


@REGISTRY.query("key_audit", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_audit(spark, sf_dir):
    return q.key_audit(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@REGISTRY.query(
    "orphan_audit",
    """SELECT l_suppkey % 7 + l_partkey AS part_ref, count(*) AS n_rows FROM lineitem WHERE l_suppkey % 7 + l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 > 0) GROUP BY 1""",
)
def orphan_audit(spark, sf_dir):
    child = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7 + F.col("l_partkey")).alias("part_ref"))
    return q.orphan_audit(child, table(spark, sf_dir, "part").where("p_partkey % 3 > 0"), "part_ref", "p_partkey")


@REGISTRY.query(
    "check_constraint_audit",
    with_ctes(
        LINKS_SQL,
        ISSUES_SQL,
        body="""SELECT link_id AS id, 'status' AS "constraint" FROM links WHERE status NOT IN ('pending_scraping', 'processing', 'completed')
UNION ALL SELECT link_id, 'act_count' FROM links WHERE act_count > 10
UNION ALL SELECT issue_id, 'confidence' FROM issues WHERE confidence * 4 > 1 UNION ALL SELECT issue_id, 'name_length' FROM issues WHERE length(name) > 42
UNION ALL SELECT issue_id, 'description' FROM issues WHERE length(trim(description)) = 0""",
    ),
)
def check_constraint_audit(spark, sf_dir):
    of_links = q.check_constraint_audit(
        links(spark, sf_dir),
        "link_id",
        {"status": q.one_of("status", ("pending_scraping", "processing", "completed")), "act_count": F.col("act_count") <= 10},
    )
    quadrupled = issues(spark, sf_dir).withColumn("confidence", F.col("confidence") * 4)
    of_issues = q.check_constraint_audit(
        quadrupled,
        "issue_id",
        {
            "confidence": q.in_unit_range("confidence"),
            "name_length": q.at_most("name", 42),
            "description": q.not_blank("description"),
        },
    )
    return of_links.withColumnRenamed("link_id", "id").unionByName(of_issues.withColumnRenamed("issue_id", "id"))


# ---------------------------------------------------------------- rendering


@REGISTRY.query(
    "rendered_documents",
    with_ctes(
        DOC_LINES_SQL,
        body=r"""SELECT act_id, count(*) AS n_articles, count(*) AS n_anchors, act_id % 3 > 0 AS has_title FROM articles GROUP BY act_id""",
    ),
)
def rendered_documents(spark, sf_dir):
    """Documents of all acts rendered from their article rows; as many anchors as articles."""
    rows = doc_lines(spark, sf_dir).withColumns(
        {"act_type": F.lit("LEGE"), "act_number": F.col("act_id").cast("string"), "act_year": F.lit(2024), "title": F.lit("t"), "title_name": F.when(F.col("act_id") % 3 > 0, "General"), "title_nr": F.when(F.col("act_id") % 3 > 0, 1)}
    )
    content = assemble(render_rows(rows), key="act_id")
    return content.select(
        "act_id",
        F.regexp_extract("content", r"(?m)^total_articole: (\d+)$", 1).cast("long").alias("n_articles"),
        F.regexp_count("content", F.lit('(?m)^<a id="art-[^"]*"></a>$')).cast("long").alias("n_anchors"),
        F.col("content").contains("## TITLUL I - General").alias("has_title"),
    )


@REGISTRY.query(
    "rendered_blocks",
    with_ctes(
        DOC_LINES_SQL,
        body=r"""SELECT act_id, CAST(ordinal AS BIGINT) AS seq, '## Art. ' || article_number AS heading FROM articles""",
    ),
)
def rendered_blocks(spark, sf_dir):
    """The same documents as blocks, one row per article, never assembled."""
    rows = doc_lines(spark, sf_dir).withColumns(
        {"act_type": F.lit("LEGE"), "act_number": F.col("act_id").cast("string"), "act_year": F.lit(2024), "title": F.lit("t")}
    )
    blocks = render_rows(rows).where("section = 3")
    return blocks.select("act_id", "seq", F.get(F.split("block", "\n"), F.lit(1)).alias("heading"))
