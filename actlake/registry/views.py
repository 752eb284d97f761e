"""Views with nested children, export packages, work lists and the hand-off to labelling.

Nested results are flattened or joined to strings in a fixed order, so they can be compared.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables
from ..plans import handoff, views
from . import Registry
from .bind import (
    ACT_CATEGORIES_SQL,
    ACT_ISSUES_SQL,
    ANNEX_ISSUES_SQL,
    ANNEXES_SQL,
    ARTICLE_ISSUES_SQL,
    CATEGORIES_SQL,
    DOC_ACTS_SQL,
    DOC_LINES_SQL,
    ISSUES_SQL,
    ORDER_ACTS_SQL,
    act_categories,
    act_issues,
    annex_issues,
    annexes,
    article_issues,
    categories,
    doc_acts,
    doc_lines,
    issues,
    order_acts,
    table,
    with_ctes,
)

REGISTRY = Registry()

TS = datetime(2025, 1, 1)
TS_SQL = "TIMESTAMP '2025-01-01 00:00:00'"


@REGISTRY.query(
    "pending_union_view",
    with_ctes(
        DOC_ACTS_SQL,
        DOC_LINES_SQL,
        ANNEXES_SQL,
        body="""SELECT 'act' AS kind, act_id AS id, act_type || ' ' || act_number || '/' || CAST(act_year AS VARCHAR) AS label, ai_status, ai_processed_at, ai_error
FROM acts WHERE ai_status IN ('pending', 'processing', 'error')
UNION ALL SELECT 'article', r.article_id, 'Art. ' || r.article_number || ' din ' || a.act_type || ' ' || a.act_number, r.ai_status, r.ai_processed_at, r.ai_error
FROM articles r JOIN acts a ON r.act_id = a.act_id WHERE r.ai_status IN ('pending', 'processing', 'error')
UNION ALL SELECT 'annex', x.annex_id, 'Anexa ' || coalesce(x.annex_nr, CAST(x.ordinal AS VARCHAR)) || ' din ' || a.act_type || ' ' || a.act_number, x.ai_status, x.ai_processed_at, x.ai_error
FROM annexes x JOIN acts a ON x.act_id = a.act_id WHERE x.ai_status IN ('pending', 'processing', 'error')""",
    ),
)
def pending_union_view(spark, sf_dir):
    return views.oldest_first(
        views.pending_ai_processing(doc_acts(spark, sf_dir), doc_lines(spark, sf_dir), annexes(spark, sf_dir))
    )


@REGISTRY.query(
    "pending_export_view",
    with_ctes(
        DOC_ACTS_SQL,
        DOC_LINES_SQL,
        ANNEXES_SQL,
        ACT_ISSUES_SQL,
        body="""SELECT a.act_id, a.act_type, a.title, a.summary, count(DISTINCT r.article_id) AS n_articles, count(DISTINCT x.annex_id) AS n_annexes, count(DISTINCT i.issue_id) AS n_issues
FROM acts a LEFT JOIN articles r ON a.act_id = r.act_id LEFT JOIN annexes x ON a.act_id = x.act_id LEFT JOIN act_issues i ON a.act_id = i.act_id
WHERE a.ai_status = 'completed' AND a.export_status IN ('pending', 'error') GROUP BY ALL""",
    ),
)
def pending_export_view(spark, sf_dir):
    rows = views.pending_export(
        doc_acts(spark, sf_dir), doc_lines(spark, sf_dir), annexes(spark, sf_dir), act_issues(spark, sf_dir)
    )
    return rows.select("act_id", "act_type", "title", "summary", "n_articles", "n_annexes", "n_issues")


def _names(column: str):
    return F.array_join(F.transform(column, lambda i: i["name"]), "; ")


@REGISTRY.query(
    "articles_with_issues",
    with_ctes(
        DOC_LINES_SQL,
        ISSUES_SQL,
        ARTICLE_ISSUES_SQL,
        body="""SELECT r.article_id, r.text, coalesce(string_agg(i.name, '; ' ORDER BY i.name, i.issue_id), '') AS issues, count(i.issue_id) AS n
FROM articles r LEFT JOIN article_issues a ON r.article_id = a.article_id LEFT JOIN issues i ON a.issue_id = i.issue_id GROUP BY r.article_id, r.text""",
    ),
)
def articles_with_issues(spark, sf_dir):
    rows = views.articles_with_issues(doc_lines(spark, sf_dir), article_issues(spark, sf_dir), issues(spark, sf_dir))
    return rows.select("article_id", "text", _names("issues").alias("issues"), F.size("issues").cast("long").alias("n"))


@REGISTRY.query(
    "acts_with_categories",
    with_ctes(
        ORDER_ACTS_SQL,
        ACT_CATEGORIES_SQL,
        CATEGORIES_SQL,
        body="""SELECT a.act_id, a.act_type, a.title, coalesce(string_agg(c.name, '; ' ORDER BY c.sort_order, c.name), '') AS categories
FROM acts a LEFT JOIN act_categories ac ON a.act_id = ac.act_id LEFT JOIN categories c ON ac.category_id = c.category_id AND c.is_active GROUP BY ALL""",
    ),
)
def acts_with_categories(spark, sf_dir):
    rows = views.acts_with_categories(order_acts(spark, sf_dir), act_categories(spark, sf_dir), categories(spark, sf_dir))
    return rows.select("act_id", "act_type", "title", _names("categories").alias("categories"))


@REGISTRY.query(
    "category_names",
    with_ctes(
        ORDER_ACTS_SQL,
        ACT_CATEGORIES_SQL,
        CATEGORIES_SQL,
        body="""SELECT a.act_id, a.act_type || ' ' || a.act_number || '/' || CAST(a.act_year AS VARCHAR) AS label, coalesce(string_agg(c.name, '; ' ORDER BY c.sort_order, c.name), '') AS categories
FROM acts a LEFT JOIN act_categories ac ON a.act_id = ac.act_id LEFT JOIN categories c ON ac.category_id = c.category_id AND c.is_active GROUP BY ALL""",
    ),
)
def category_names(spark, sf_dir):
    rows = views.category_names(order_acts(spark, sf_dir), act_categories(spark, sf_dir), categories(spark, sf_dir))
    return rows.select("act_id", "label", F.array_join("categories", "; ").alias("categories"))


PART_BYTES = 3_000  # small, so that the tables' acts have several parts

# children of acts in parts: c has act_id, rank, ordinal, id, size and what is shown of each child
_PARTS_SQL = f"""parted AS (SELECT *, CAST(floor(coalesce(sum(size) OVER (PARTITION BY act_id ORDER BY rank, ordinal NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {PART_BYTES}) AS BIGINT) AS part FROM c),
parts AS (SELECT act_id, part, coalesce(string_agg(shown, '|' ORDER BY ordinal NULLS FIRST, id) FILTER (WHERE rank = 0), '') AS first, coalesce(string_agg(shown, '|' ORDER BY ordinal NULLS FIRST, id) FILTER (WHERE rank = 1), '') AS second FROM parted GROUP BY act_id, part)"""


def _bytes_sql(text: str) -> str:
    return f"coalesce(strlen({text}), 0) + 64"


_PACKAGE_CTES = (DOC_ACTS_SQL, DOC_LINES_SQL, ANNEXES_SQL, ISSUES_SQL, ACT_ISSUES_SQL, ARTICLE_ISSUES_SQL, ANNEX_ISSUES_SQL)


def _package_tables(spark, sf_dir):
    return (
        doc_acts(spark, sf_dir),
        doc_lines(spark, sf_dir),
        annexes(spark, sf_dir),
        issues(spark, sf_dir),
        act_issues(spark, sf_dir),
        article_issues(spark, sf_dir),
        annex_issues(spark, sf_dir),
    )


@REGISTRY.query(
    "export_package",
    with_ctes(
        *_PACKAGE_CTES,
        f"""c AS (SELECT r.act_id, 0 AS rank, r.ordinal, r.article_id AS id, {_bytes_sql('r.text')} AS size, CAST(r.article_id AS VARCHAR) || ':' || r.text || ':' || CAST((SELECT count(*) FROM article_issues ai JOIN issues i ON ai.issue_id = i.issue_id WHERE ai.article_id = r.article_id) AS VARCHAR) AS shown
  FROM articles r JOIN acts a ON r.act_id = a.act_id WHERE a.ai_status = 'completed'
  UNION ALL SELECT x.act_id, 1, x.ordinal, x.annex_id, {_bytes_sql('x.content')}, CAST(x.annex_id AS VARCHAR) || ':' || x.content || ':' || CAST((SELECT count(*) FROM annex_issues ai JOIN issues i ON ai.issue_id = i.issue_id WHERE ai.annex_id = x.annex_id) AS VARCHAR)
  FROM annexes x JOIN acts a ON x.act_id = a.act_id WHERE a.ai_status = 'completed')""",
        _PARTS_SQL,
        body="""SELECT a.act_id, coalesce(p.part, 0) AS part, a.title, a.remote_id, coalesce(p.first, '') AS articles, coalesce(p.second, '') AS annexes,
  CASE WHEN coalesce(p.part, 0) > 0 THEN '' ELSE coalesce((SELECT string_agg(i.name, '|' ORDER BY i.name, i.issue_id) FROM act_issues ai JOIN issues i ON ai.issue_id = i.issue_id WHERE ai.act_id = a.act_id), '') END AS act_issues
FROM acts a LEFT JOIN parts p ON a.act_id = p.act_id WHERE a.ai_status = 'completed'""",
    ),
)
def export_package(spark, sf_dir):
    packed = views.export_package(*_package_tables(spark, sf_dir), part_bytes=PART_BYTES)

    def flat(column, key, text):
        return F.array_join(
            F.transform(
                column,
                lambda c: F.concat_ws(":", c[key].cast("string"), c[text], F.size(c["issues"]).cast("string")),
            ),
            "|",
        )

    return packed.select(
        "act_id",
        "part",
        "title",
        "remote_id",
        flat("articles", "article_id", "text").alias("articles"),
        flat("annexes", "annex_id", "content").alias("annexes"),
        F.array_join(F.transform("act_issues", lambda i: i["name"]), "|").alias("act_issues"),
    )


@REGISTRY.query(
    "export_rows",
    with_ctes(
        *_PACKAGE_CTES,
        body="""SELECT r.act_id, 'article' AS kind, CAST(r.ordinal AS BIGINT) AS ordinal, r.article_id AS id, r.text AS text, r.summary AS summary FROM articles r JOIN acts a ON r.act_id = a.act_id WHERE a.ai_status = 'completed'
UNION ALL SELECT x.act_id, 'annex', CAST(x.ordinal AS BIGINT), x.annex_id, x.content, x.summary FROM annexes x JOIN acts a ON x.act_id = a.act_id WHERE a.ai_status = 'completed'""",
    ),
)
def export_rows(spark, sf_dir):
    acts, articles, annex, all_issues, _, article_links, annex_links = _package_tables(spark, sf_dir)
    rows = views.export_rows(acts, articles, annex, all_issues, article_links, annex_links)
    payload = lambda p: F.get_json_object("payload", p)
    return rows.select(
        "act_id",
        "kind",
        "ordinal",
        "id",
        F.when(F.col("kind") == "article", payload("$.text")).otherwise(payload("$.content")).alias("text"),
        payload("$.summary").alias("summary"),
    )


@REGISTRY.query(
    "package_parts",
    with_ctes(
        *_PACKAGE_CTES,
        body=f"""SELECT act_id, part, count(*) FILTER (WHERE rank = 0) AS n_articles, count(*) FILTER (WHERE rank = 1) AS n_annexes, string_agg(CAST(id AS VARCHAR), '|' ORDER BY rank, ordinal, id) AS ids FROM (
  SELECT *, CAST(floor(coalesce(sum(size) OVER (PARTITION BY act_id ORDER BY rank, ordinal, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {PART_BYTES}) AS BIGINT) AS part FROM (
    SELECT r.act_id, 0 AS rank, CAST(r.ordinal AS BIGINT) AS ordinal, r.article_id AS id, strlen(r.text) AS size FROM articles r JOIN acts a ON r.act_id = a.act_id WHERE a.ai_status = 'completed'
    UNION ALL SELECT x.act_id, 1, CAST(x.ordinal AS BIGINT), x.annex_id, strlen(x.content) FROM annexes x JOIN acts a ON x.act_id = a.act_id WHERE a.ai_status = 'completed')) GROUP BY act_id, part""",
    ),
)
def package_parts(spark, sf_dir):
    """Children in documents of bounded bytes; here their texts alone are the payload."""
    acts, articles, annex, all_issues, _, article_links, annex_links = _package_tables(spark, sf_dir)
    rows = views.export_rows(acts, articles, annex, all_issues, article_links, annex_links)
    text = F.when(F.col("kind") == "article", F.get_json_object("payload", "$.text")).otherwise(F.get_json_object("payload", "$.content"))
    rows = rows.withColumn("text", text).withColumn("payload", F.coalesce("text", F.lit("")))
    packed = views.package_parts(rows, part_bytes=PART_BYTES)
    return packed.select(
        "act_id",
        "part",
        F.size(F.filter("kinds", lambda k: k == "article")).cast("long").alias("n_articles"),
        F.size(F.filter("kinds", lambda k: k == "annex")).cast("long").alias("n_annexes"),
        F.array_join(F.transform("ids", lambda i: i.cast("string")), "|").alias("ids"),
    )


_ALL_ISSUES_SQL = """all_issues AS (
  SELECT act_id, issue_id FROM act_issues UNION SELECT r.act_id, i.issue_id FROM article_issues i JOIN articles r ON i.article_id = r.article_id
  UNION SELECT x.act_id, i.issue_id FROM annex_issues i JOIN annexes x ON i.annex_id = x.annex_id)"""


ACT_PACKAGE_SQL = ",\n".join(
    (
        *_PACKAGE_CTES,
        _ALL_ISSUES_SQL,
        f"""ready AS (SELECT * FROM acts WHERE ai_status = 'completed' AND export_status IN ('pending', 'error')),
c AS (SELECT r.act_id, 0 AS rank, r.ordinal, r.article_id AS id, {_bytes_sql('r.text')} AS size, r.text AS shown FROM articles r JOIN ready a ON r.act_id = a.act_id WHERE r.ai_status = 'completed'
  UNION ALL SELECT x.act_id, 1, x.ordinal, x.annex_id, {_bytes_sql('x.content')}, x.content FROM annexes x JOIN ready a ON x.act_id = a.act_id WHERE x.ai_status = 'completed')""",
        _PARTS_SQL,
        """packages AS (SELECT a.act_id, coalesce(p.part, 0) AS part, a.act_type, (SELECT count(*) FROM articles r WHERE r.act_id = a.act_id) AS total_articles,
  (SELECT count(*) FROM articles r WHERE r.act_id = a.act_id AND r.ai_status = 'completed') AS processed_articles,
  (SELECT count(*) FROM annexes x WHERE x.act_id = a.act_id) AS total_annexes,
  (SELECT count(*) FROM annexes x WHERE x.act_id = a.act_id AND x.ai_status = 'completed') AS processed_annexes,
  (SELECT count(*) FROM all_issues i WHERE i.act_id = a.act_id) AS total_issues,
  coalesce(p.first, '') AS articles, coalesce(p.second, '') AS annexes,
  CASE WHEN coalesce(p.part, 0) > 0 THEN '' ELSE coalesce((SELECT string_agg(CAST(i.issue_id AS VARCHAR), '|' ORDER BY i.issue_id) FROM all_issues i JOIN issues s ON i.issue_id = s.issue_id WHERE i.act_id = a.act_id), '') END AS issues
FROM ready a LEFT JOIN parts p ON a.act_id = p.act_id)""",
    )
)


def act_packages(spark: SparkSession, sf_dir: str, keys: DataFrame | None = None) -> DataFrame:
    """Packages of all acts that are ready, or of those of them whose keys are given."""
    source = list(_package_tables(spark, sf_dir))
    missing = {"act_date": "date", "url": "string", "created_at": "timestamp"}
    source[0] = source[0].withColumns({n: F.lit(None).cast(t) for n, t in missing.items()})
    source[1] = source[1].withColumn("article_label", F.lit(None).cast("string"))
    if keys is not None:
        source[0] = source[0].join(keys, "act_id", "left_semi")
    return views.act_package(*source, exported_at=TS, part_bytes=PART_BYTES)


def flat_package(rows: DataFrame, *also: str) -> DataFrame:
    totals = [F.col(f"metadata.{c}") for c in ("total_articles", "processed_articles", "total_annexes", "processed_annexes", "total_issues")]
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), "|")
    return rows.select(
        "act_id",
        *also,
        "part",
        "act.act_type",
        *totals,
        joined("articles", "text").alias("articles"),
        joined("annexes", "content").alias("annexes"),
        joined("issues", "issue_id").alias("issues"),
    )


@REGISTRY.query("act_package", with_ctes(ACT_PACKAGE_SQL, body="SELECT * FROM packages"))
def act_package(spark, sf_dir):
    return flat_package(act_packages(spark, sf_dir).select("act_id", "part", "package.*"))


@REGISTRY.query("entity_issues", with_ctes(*_PACKAGE_CTES, _ALL_ISSUES_SQL, body="SELECT act_id, issue_id FROM all_issues"))
def entity_issues(spark, sf_dir):
    _, articles, annex, _, act_links, article_links, annex_links = _package_tables(spark, sf_dir)
    return views.entity_issues(act_links, articles, article_links, annex, annex_links)


UPDATE_PACKAGE_SQL = ",\n".join(
    (
        DOC_ACTS_SQL,
        DOC_LINES_SQL,
        ANNEXES_SQL,
        f"""sent AS (SELECT * FROM acts WHERE export_status = 'exported' AND remote_id IS NOT NULL),
c AS (SELECT r.act_id, 0 AS rank, r.ordinal, r.article_id AS id, {_bytes_sql('r.text')} AS size, CAST(r.article_id AS VARCHAR) AS shown FROM articles r JOIN sent a ON r.act_id = a.act_id WHERE r.ai_status = 'completed' AND r.remote_id IS NULL
  UNION ALL SELECT x.act_id, 1, x.ordinal, x.annex_id, {_bytes_sql('x.content')}, CAST(x.annex_id AS VARCHAR) || x.content FROM annexes x JOIN sent a ON x.act_id = a.act_id WHERE x.ai_status = 'completed' AND x.remote_id IS NULL)""",
        _PARTS_SQL,
        "packages AS (SELECT p.act_id, p.part, a.remote_id, p.first AS new_articles, p.second AS new_annexes FROM parts p JOIN sent a ON p.act_id = a.act_id)",
    )
)


def flat_update(rows: DataFrame, *also: str) -> DataFrame:
    return rows.select(
        "act_id",
        *also,
        "part",
        "remote_id",
        F.array_join(F.transform("new_articles", lambda x: x["article_id"].cast("string")), "|").alias("new_articles"),
        F.array_join(F.transform("new_annexes", lambda x: F.concat(x["annex_id"].cast("string"), x["content"])), "|").alias("new_annexes"),
    )


@REGISTRY.query("update_package", with_ctes(UPDATE_PACKAGE_SQL, body="SELECT * FROM packages"))
def update_package(spark, sf_dir):
    return flat_update(views.update_package(doc_acts(spark, sf_dir), doc_lines(spark, sf_dir), annexes(spark, sf_dir), part_bytes=PART_BYTES))


@REGISTRY.query(
    "export_for_analysis",
    with_ctes(
        DOC_ACTS_SQL,
        DOC_LINES_SQL,
        f"c AS (SELECT act_id, 0 AS rank, ordinal, article_id AS id, {_bytes_sql('text')} AS size, text AS shown FROM articles)",
        _PARTS_SQL,
        body="""SELECT a.act_id, coalesce(p.part, 0) AS part, a.title, (SELECT count(*) FROM articles r WHERE r.act_id = a.act_id) AS total,
  (SELECT count(*) FROM articles r WHERE r.act_id = a.act_id AND (coalesce(r.issue, '') <> '' OR coalesce(r.explanation, '') <> '')) AS analyzed,
  coalesce(p.first, '') AS articles FROM acts a LEFT JOIN parts p ON a.act_id = p.act_id""",
    ),
)
def export_for_analysis(spark, sf_dir):
    rows = views.export_for_analysis(doc_acts(spark, sf_dir), doc_lines(spark, sf_dir), part_bytes=PART_BYTES)
    return rows.select(
        "act_id", "part", "act.title", "stats.total", "stats.analyzed", F.array_join(F.transform("articles", lambda r: r["text"]), "|").alias("articles")
    )


@REGISTRY.query(
    "export_worklist",
    with_ctes(
        DOC_ACTS_SQL,
        DOC_LINES_SQL,
        ACT_ISSUES_SQL,
        """page AS (SELECT * FROM acts WHERE ai_status = 'completed' AND export_status IN ('pending', 'error') ORDER BY act_id DESC LIMIT 50)""",
        body="""SELECT p.act_id, p.export_status, (SELECT count(DISTINCT article_id) FROM articles r WHERE r.act_id = p.act_id) AS n_articles,
  (SELECT count(DISTINCT issue_id) FROM act_issues i WHERE i.act_id = p.act_id) AS n_issues FROM page p""",
    ),
)
def export_worklist(spark, sf_dir):
    rows = views.export_worklist(doc_acts(spark, sf_dir), doc_lines(spark, sf_dir), act_issues(spark, sf_dir), "pending")
    return rows.select("act_id", "export_status", "n_articles", "n_issues")


@REGISTRY.query(
    "ai_worklist",
    with_ctes(
        DOC_LINES_SQL,
        ARTICLE_ISSUES_SQL,
        """page AS (SELECT * FROM articles WHERE ai_status = 'error' ORDER BY ai_processed_at DESC NULLS FIRST, article_id DESC LIMIT 50)""",
        body="""SELECT p.article_id, p.ai_error, (SELECT count(DISTINCT issue_id) FROM article_issues i WHERE i.article_id = p.article_id) AS n_issues,
  coalesce(p.summary, '') <> '' AS has_summary FROM page p""",
    ),
)
def ai_worklist(spark, sf_dir):
    rows = views.ai_worklist(doc_lines(spark, sf_dir), article_issues(spark, sf_dir), "error")
    return rows.select("article_id", "ai_error", "n_issues", "has_summary")


def _worklist_sql(where: str, order: str) -> str:
    return with_ctes(
        DOC_ACTS_SQL,
        DOC_LINES_SQL,
        ACT_ISSUES_SQL,
        f"page AS (SELECT * FROM acts WHERE {where} ORDER BY {order} LIMIT 50)",
        body="""SELECT p.act_id, p.export_status, (SELECT count(DISTINCT article_id) FROM articles r WHERE r.act_id = p.act_id) AS n_articles,
  (SELECT count(DISTINCT issue_id) FROM act_issues i WHERE i.act_id = p.act_id) AS n_issues FROM page p""",
    )


def _dated_acts(spark, sf_dir):
    """Acts with the time of their export, which some of the exported ones lack."""
    at = F.lit("2024-05-01 00:00:00").cast("timestamp") + F.make_interval(hours=(F.col("act_id") % 40).cast("int"))
    return doc_acts(spark, sf_dir).withColumn("export_at", F.when(F.col("act_id") % 6 > 0, at))


@REGISTRY.query(
    "export_worklist_completed",
    _worklist_sql("export_status IN ('exported', 'completed')", "CASE WHEN act_id % 6 > 0 THEN act_id % 40 END DESC NULLS FIRST, act_id DESC"),
)
def export_worklist_completed(spark, sf_dir):
    rows = views.export_worklist(_dated_acts(spark, sf_dir), doc_lines(spark, sf_dir), act_issues(spark, sf_dir), "completed")
    return rows.select("act_id", "export_status", "n_articles", "n_issues")


@REGISTRY.query("export_worklist_errors", _worklist_sql("export_status = 'error'", "act_id DESC"))
def export_worklist_errors(spark, sf_dir):
    rows = views.export_worklist(doc_acts(spark, sf_dir), doc_lines(spark, sf_dir), act_issues(spark, sf_dir), "error")
    return rows.select("act_id", "export_status", "n_articles", "n_issues")


@REGISTRY.query(
    "ai_worklist_pending",
    with_ctes(
        DOC_LINES_SQL,
        ARTICLE_ISSUES_SQL,
        """page AS (SELECT * FROM articles WHERE ai_status = 'pending' ORDER BY article_id DESC LIMIT 50)""",
        body="""SELECT p.article_id, p.ai_error, (SELECT count(DISTINCT issue_id) FROM article_issues i WHERE i.article_id = p.article_id) AS n_issues,
  coalesce(p.summary, '') <> '' AS has_summary FROM page p""",
    ),
)
def ai_worklist_pending(spark, sf_dir):
    rows = views.ai_worklist(doc_lines(spark, sf_dir), article_issues(spark, sf_dir), "pending")
    return rows.select("article_id", "ai_error", "n_issues", "has_summary")


# ---------------------------------------------------------------- hand-off


@REGISTRY.query(
    "build_prompts",
    with_ctes(
        DOC_ACTS_SQL,
        DOC_LINES_SQL,
        body="""SELECT r.article_id, CAST(k AS INTEGER) AS piece, 'Context: ' || a.act_type || ' ' || a.act_number || '/' || CAST(a.act_year AS VARCHAR) AS context,
  substr(r.text, k * 50 + 1, 50) AS text, substr(r.text, k * 50 + 1, 50) AS summary_text
FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(length(text) / 50.0) AS BIGINT)))) AS k FROM articles) r JOIN acts a ON r.act_id = a.act_id""",
    ),
)
def build_prompts(spark, sf_dir):
    """Pieces of 50 characters, so that the tables' lines make several."""
    prompts = handoff.build_prompts(doc_lines(spark, sf_dir), doc_acts(spark, sf_dir), piece_chars=50)
    context = F.get(F.split("issue_prompt", "\n\n"), F.lit(1))
    shown = lambda prompt, end: F.substring_index(F.substring_index(prompt, handoff.TEXT_MARK, -1), "\n\n" + end[:10], 1)
    text, summary = shown("issue_prompt", handoff.ISSUE_INSTRUCTIONS), shown("summary_prompt", handoff.SUMMARY_INSTRUCTIONS)
    return prompts.select("article_id", "piece", context.alias("context"), text.alias("text"), summary.alias("summary_text"))


@REGISTRY.query(
    "parse_issue_json",
    """SELECT event_id, k, upper(left(event_type, 2)) AS name, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS description,
  CASE WHEN event_id % 4 = 0 THEN 0.8::DOUBLE ELSE (event_id % 10) / 10.0::DOUBLE END AS confidence
FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_id % 5 > 0""",
)
def parse_issue_json(spark, sf_dir):
    """Answers made of events: some lack fields, a fifth are no JSON."""
    key = F.col("event_id")
    confidence = F.when(key % 4 == 0, "").otherwise(F.concat(F.lit(', "confidence": '), ((key % 10) / 10).cast("string")))
    description = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit(', "description": "'), "event_type", F.lit('"')))
    good = F.concat(F.lit('{"issues": [{"title": "'), F.upper(F.substring("event_type", 1, 2)), F.lit('"'), description, confidence, F.lit("}]}"))
    body = F.when(key % 5 == 0, F.concat(F.lit("sorry, "), "event_type")).otherwise(good)
    events = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), body.alias("body"))
    rows = handoff.parse_issue_responses(events, key="event_id", keep=("k",))
    return rows.select("event_id", "k", "name", "description", "confidence")


_EXTRACTED_SQL = """extracted AS (
  SELECT conv_id * 1000 + turn AS article_id, 0 AS pos, CASE WHEN turn % 2 = 0 THEN 'issue ' || CAST(conv_id % 50 AS VARCHAR) ELSE (SELECT min(name) FROM issues) END AS name,
         role AS description, 0.5::DOUBLE AS confidence FROM conversations)"""


def _extracted(spark, sf_dir):
    known = issues(spark, sf_dir).agg(F.min("name")).scalar()
    number = F.concat(F.lit("issue "), (F.col("conv_id") % 50).cast("string"))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("article_id"),
        F.lit(0).alias("pos"),
        F.when(F.col("turn") % 2 == 0, number).otherwise(known).alias("name"),
        F.col("role").alias("description"),
        F.lit(0.5).alias("confidence"),
    )


@REGISTRY.query(
    "register_issues",
    with_ctes(
        ISSUES_SQL,
        _EXTRACTED_SQL,
        body="""SELECT name, description, source, confidence FROM issues
UNION ALL SELECT name, description, 'ai', confidence FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY article_id, pos) AS rn FROM extracted WHERE name NOT IN (SELECT name FROM issues)) WHERE rn = 1""",
    ),
)
def register_issues(spark, sf_dir):
    links = article_issues(spark, sf_dir)
    every, _ = handoff.register_issues(issues(spark, sf_dir), _extracted(spark, sf_dir), links)
    return every.select("name", "description", "source", "confidence")


@REGISTRY.query(
    "register_issue_links",
    with_ctes(
        ISSUES_SQL,
        ARTICLE_ISSUES_SQL,
        _EXTRACTED_SQL,
        body="""SELECT article_id, name FROM article_issues a JOIN issues i ON a.issue_id = i.issue_id UNION SELECT article_id, name FROM extracted""",
    ),
)
def register_issue_links(spark, sf_dir):
    every, links = handoff.register_issues(issues(spark, sf_dir), _extracted(spark, sf_dir), article_issues(spark, sf_dir))
    return links.join(every.select("issue_id", "name"), "issue_id").select("article_id", "name")


@REGISTRY.query(
    "apply_ai_results",
    with_ctes(
        DOC_LINES_SQL,
        body=f"""SELECT article_id, CASE WHEN act_id % 2 > 0 THEN ai_status WHEN ordinal % 3 = 0 THEN 'error' ELSE 'completed' END AS ai_status,
  CASE WHEN act_id % 2 > 0 THEN ai_processed_at WHEN ordinal % 3 = 0 THEN ai_processed_at ELSE {TS_SQL} END AS ai_processed_at,
  CASE WHEN act_id % 2 > 0 THEN ai_error WHEN ordinal % 3 = 0 THEN substr(text, 1, 500) END AS ai_error,
  CASE WHEN act_id % 2 > 0 OR ordinal % 3 = 0 THEN summary ELSE 'done' END AS summary FROM articles""",
    ),
)
def apply_ai_results(spark, sf_dir):
    articles = doc_lines(spark, sf_dir)
    failed = F.col("ordinal") % 3 == 0
    results = articles.where("act_id % 2 = 0").select(
        "article_id", F.when(failed, F.col("text")).alias("error"), F.when(~failed, "done").alias("summary")
    )
    return handoff.apply_ai_results(articles, results, ts=TS).select("article_id", "ai_status", "ai_processed_at", "ai_error", "summary")


@REGISTRY.query(
    "reset_status",
    with_ctes(
        DOC_LINES_SQL,
        body="SELECT article_id, CASE WHEN ai_status = 'error' THEN 'pending' ELSE ai_status END AS ai_status, CASE WHEN ai_status <> 'error' THEN ai_error END AS ai_error, CASE WHEN ai_status <> 'error' THEN ai_processed_at END AS ai_processed_at FROM articles",
    ),
)
def reset_status(spark, sf_dir):
    articles = doc_lines(spark, sf_dir)
    failed = articles.where("ai_status = 'error'").select("article_id")
    return handoff.reset_status(articles, failed).select("article_id", "ai_status", "ai_error", "ai_processed_at")


@REGISTRY.query(
    "links_lifecycle",
    """SELECT user_id, event_type AS status, CAST(value AS INTEGER) AS act_count, lo AS created_at, hi AS updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, min(ts) OVER (PARTITION BY user_id) AS lo, max(ts) OVER (PARTITION BY user_id) AS hi FROM
   (SELECT user_id, event_type, trunc(value) AS value, ts, event_id FROM events)) WHERE rn = 1""",
)
def links_lifecycle(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", F.col("event_type").alias("status"), F.col("value").cast("int").alias("act_count"), F.lit(None).cast("string").alias("error")
    )
    return handoff.links_lifecycle(events, key="user_id").drop("error")


# ---------------------------------------------------------------- answers of the platform


@REGISTRY.query(
    "apply_export_responses",
    with_ctes(
        DOC_ACTS_SQL,
        body=f"""SELECT act_id, CASE WHEN act_id % 6 IN (0, 1, 2) THEN 'exported' WHEN act_id % 6 IN (3, 4) THEN 'error' ELSE export_status END AS export_status,
  CASE WHEN act_id % 6 IN (0, 1, 2) THEN {TS_SQL} END AS export_at,
  CASE act_id % 6 WHEN 3 THEN 'Server error 503: busy' WHEN 4 THEN 'API error 400: ' || substr(title, 1, 200) END AS export_error,
  CASE WHEN act_id % 6 IN (0, 1, 2) THEN CAST(act_id + 9 AS INTEGER) ELSE remote_id END AS remote_id FROM acts""",
    ),
)
def apply_export_responses(spark, sf_dir):
    acts = doc_acts(spark, sf_dir).withColumns(
        {"export_at": F.lit(None).cast("timestamp"), "export_error": F.lit(None).cast("string")}
    )
    key = F.col("act_id")
    number = (key + 9).cast("string")
    answers = acts.where(key % 6 < 5).select(
        "act_id",
        F.when(key % 6 == 0, 200).when(key % 6 == 1, 201).when(key % 6 == 2, 409).when(key % 6 == 3, 503).otherwise(400).alias("status_code"),
        F.when(key % 6 == 0, F.concat(F.lit('{"id": '), number, F.lit("}")))
        .when(key % 6 == 1, F.concat(F.lit('{"legislation_id": "'), number, F.lit('"}')))
        .when(key % 6 == 2, F.concat(F.lit('{"existing_id": '), number, F.lit("}")))
        .when(key % 6 == 3, "busy")
        .otherwise(F.col("title"))
        .alias("body"),
        F.lit(None).cast("string").alias("error"),
    )
    done = tables.apply_export_responses(acts, answers, ts=TS)
    return done.select("act_id", "export_status", "export_at", "export_error", "remote_id")


@REGISTRY.query(
    "apply_update_responses",
    with_ctes(
        DOC_ACTS_SQL,
        DOC_LINES_SQL,
        body="""SELECT r.article_id, CASE WHEN r.ai_status = 'completed' AND r.remote_id IS NULL AND a.remote_id IS NOT NULL AND a.act_id % 5 < 2 THEN a.remote_id ELSE r.remote_id END AS remote_id
FROM articles r JOIN acts a ON r.act_id = a.act_id""",
    ),
)
def apply_update_responses(spark, sf_dir):
    acts = doc_acts(spark, sf_dir)
    answers = acts.select("act_id", F.when(F.col("act_id") % 5 == 0, 200).when(F.col("act_id") % 5 == 1, 204).otherwise(500).alias("status_code"))
    return tables.apply_update_responses(doc_lines(spark, sf_dir), acts, answers).select("article_id", "remote_id")


@REGISTRY.query(
    "mark_children_exported",
    with_ctes(
        DOC_ACTS_SQL,
        DOC_LINES_SQL,
        body="""SELECT r.article_id, CASE WHEN r.ai_status = 'completed' AND a.remote_id IS NOT NULL THEN a.remote_id ELSE r.remote_id END AS remote_id
FROM articles r JOIN acts a ON r.act_id = a.act_id""",
    ),
)
def mark_children_exported(spark, sf_dir):
    return tables.mark_children_exported(doc_lines(spark, sf_dir), doc_acts(spark, sf_dir)).select("article_id", "remote_id")
