"""Filters, search, paging, statistics and sequence checks."""

from __future__ import annotations

import functools
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import (
    act_name,
    annex_name,
    article_name,
    change_name,
    has_labels,
    has_text_change,
    hierarchy_path,
    is_ai_generated,
    is_exported,
    is_processed,
)
from ..operators import articles as art
from ..operators import ordered, search, stats, tables
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
    LINE_ARTICLES_SQL,
    LINKS_SQL,
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
    line_articles,
    links,
    order_acts,
    spread,
    table,
    with_ctes,
)

REGISTRY = Registry()

AS_OF = datetime(1999, 6, 15)
AS_OF_SQL = "TIMESTAMP '1999-06-15 00:00:00'"

# ---------------------------------------------------------------- filters and search


@REGISTRY.query(
    "filters_range_type",
    with_ctes(
        ORDER_ACTS_SQL,
        body="""SELECT act_id, act_type, act_year FROM acts
WHERE act_type = '1-URGENT' AND act_year >= 1996 AND act_year <= 1999 AND export_status IN ('pending', 'error')""",
    ),
)
def filters_range_type(spark, sf_dir):
    rows = search.filter_equal(order_acts(spark, sf_dir), act_type="1-URGENT", issuer=None)
    rows = search.filter_range(rows, "act_year", 1996, 1999)
    rows = search.filter_in(rows, "export_status", ["pending", "error"])
    return rows.select("act_id", "act_type", "act_year")


@REGISTRY.query(
    "search_any",
    with_ctes(
        DOC_ACTS_SQL,
        body="""SELECT act_id, act_type, act_year FROM acts
WHERE title ILIKE '%the_e%' OR issuer ILIKE '%the_e%' OR CAST(act_year AS VARCHAR) ILIKE '%the_e%' OR summary ILIKE '%the_e%'""",
    ),
)
def search_any(spark, sf_dir):
    hits = search.search_any(doc_acts(spark, sf_dir), "the_e", ["title", "issuer", "act_year", "summary"])
    return hits.select("act_id", "act_type", "act_year")


@REGISTRY.query(
    "search_relevance_topk",
    with_ctes(
        DOC_LINES_SQL,
        """scored AS (SELECT act_id, ordinal, CAST(least(100,
    CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS INTEGER)
    + CASE WHEN contains(lower(issue), 'the') THEN 5 ELSE 0 END + CASE WHEN contains(lower(explanation), 'the') THEN 3 ELSE 0 END) AS DOUBLE) AS relevance,
    substr(text, 1, 200) AS highlight
  FROM articles WHERE text ILIKE '%the%' OR issue ILIKE '%the%' OR explanation ILIKE '%the%')""",
        body="SELECT * FROM scored ORDER BY relevance DESC, act_id, ordinal LIMIT 50",
    ),
)
def search_relevance_topk(spark, sf_dir):
    hits = search.search_articles(doc_lines(spark, sf_dir), "the", limit=50, also=())
    return hits.select("act_id", "ordinal", "relevance", "highlight")


@REGISTRY.query(
    "search_legacy_order",
    with_ctes(
        DOC_LINES_SQL,
        body="""SELECT act_id, ordinal, CAST((length(lower(text)) - length(replace(lower(text), 'der', ''))) / 3 AS INTEGER) AS n
FROM articles WHERE text ILIKE '%der%' OR issue ILIKE '%der%' OR explanation ILIKE '%der%' ORDER BY act_id, ordinal LIMIT 50""",
    ),
)
def search_legacy_order(spark, sf_dir):
    """Limit in document order first, as the older search does."""
    from ..functions.text import occurrences

    hits = search.search_articles(doc_lines(spark, sf_dir), "der", limit=50, also=(), legacy=True)
    return hits.select("act_id", "ordinal", occurrences("text", "der").alias("n"))


@REGISTRY.query(
    "search_score_all",
    with_ctes(
        DOC_LINES_SQL,
        body="""SELECT article_id, CAST(least(100, CAST((length(lower(text)) - length(replace(lower(text), 'topic', ''))) / 5 AS INTEGER)
    + CASE WHEN contains(lower(issue), 'topic') THEN 5 ELSE 0 END + CASE WHEN contains(lower(explanation), 'topic') THEN 3 ELSE 0 END) AS DOUBLE) AS relevance FROM articles""",
    ),
)
def search_score_all(spark, sf_dir):
    from ..functions.text import relevance

    return doc_lines(spark, sf_dir).select("article_id", relevance("text", "issue", "explanation", "topic").alias("relevance"))


@REGISTRY.query(
    "list_page",
    with_ctes(
        ORDER_ACTS_SQL,
        body="SELECT act_id, act_year, issuer FROM acts ORDER BY issuer DESC NULLS FIRST, act_year DESC NULLS FIRST, act_id LIMIT 50 OFFSET 100",
    ),
)
def list_page(spark, sf_dir):
    page = search.page(order_acts(spark, sf_dir), "-issuer", "-act_year", "act_id", skip=100, limit=50)
    return page.select("act_id", "act_year", "issuer")


@REGISTRY.query(
    "page_info",
    "SELECT count(*) AS total, CAST(3 AS BIGINT) AS page, CAST(ceil(count(*) / 50.0) AS BIGINT) AS n_pages FROM orders",
)
def page_info(spark, sf_dir):
    return search.page_info(order_acts(spark, sf_dir), skip=100, limit=50)


@REGISTRY.query(
    "work_batch",
    with_ctes(ORDER_ACTS_SQL, body="SELECT act_id, ai_status FROM acts WHERE ai_status IN ('pending', 'processing') ORDER BY act_id LIMIT 10"),
)
def work_batch(spark, sf_dir):
    waiting = search.filter_in(order_acts(spark, sf_dir), "ai_status", ["pending", "processing"])
    return search.take_batch(waiting, 10, order="act_id").select("act_id", "ai_status")


@REGISTRY.query(
    "has_labels",
    with_ctes(
        LINE_ARTICLES_SQL,
        body="""SELECT act_id, ordinal, coalesce(issue, '') <> '' OR coalesce(explanation, '') <> '' AS labelled,
  issue IS NOT NULL OR explanation IS NOT NULL AS has_value FROM articles""",
    ),
)
def has_labels_query(spark, sf_dir):
    return line_articles(spark, sf_dir).select(
        "act_id",
        "ordinal",
        has_labels("issue", "explanation").alias("labelled"),
        has_labels("issue", "explanation", blank_counts=True).alias("has_value"),
    )


@REGISTRY.query(
    "label_filter",
    with_ctes(
        LINE_ARTICLES_SQL,
        body="SELECT article_id, 'with' AS kind FROM articles WHERE issue IS NOT NULL OR explanation IS NOT NULL UNION ALL SELECT article_id, 'without' FROM articles WHERE issue IS NULL AND explanation IS NULL",
    ),
)
def label_filter(spark, sf_dir):
    rows = line_articles(spark, sf_dir)
    labelled = search.label_filter(rows, True).select("article_id", F.lit("with").alias("kind"))
    return labelled.unionByName(search.label_filter(rows, False).select("article_id", F.lit("without").alias("kind")))


@REGISTRY.query(
    "changed_since",
    with_ctes(ORDER_ACTS_SQL, body=f"SELECT act_id, created_at FROM acts WHERE created_at > {AS_OF_SQL} - INTERVAL 30 DAY"),
)
def changed_since(spark, sf_dir):
    return search.changed_since(order_acts(spark, sf_dir), "created_at", AS_OF).select("act_id", "created_at")


@REGISTRY.query(
    "acts_with_fresh_children",
    with_ctes(
        DOC_ACTS_SQL,
        DOC_LINES_SQL,
        ANNEXES_SQL,
        body="""SELECT act_id FROM acts a WHERE export_status = 'exported' AND
  (EXISTS (SELECT 1 FROM articles r WHERE r.act_id = a.act_id AND r.ai_status = 'completed' AND r.remote_id IS NULL)
   OR EXISTS (SELECT 1 FROM annexes x WHERE x.act_id = a.act_id AND x.ai_status = 'completed' AND x.remote_id IS NULL))""",
    ),
)
def acts_with_fresh_children(spark, sf_dir):
    fresh = lambda t: t.where((F.col("ai_status") == "completed") & F.col("remote_id").isNull())
    acts = doc_acts(spark, sf_dir).where("export_status = 'exported'")
    children = [fresh(doc_lines(spark, sf_dir)), fresh(annexes(spark, sf_dir))]
    return search.with_children(acts, children, "act_id").select("act_id")


@REGISTRY.query("unlabelled_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unlabelled_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return search.exclude_keys(documents, table(spark, sf_dir, "labels"), "doc_id")


@REGISTRY.query("active_categories", with_ctes(CATEGORIES_SQL, body="SELECT category_id, name, sort_order FROM categories WHERE is_active ORDER BY sort_order, name"))
def active_categories(spark, sf_dir):
    active = search.only_active(categories(spark, sf_dir), True)
    return search.ordered(active, "sort_order", "name").select("category_id", "name", "sort_order")


@REGISTRY.query(
    "display_names",
    with_ctes(
        DOC_LINES_SQL,
        body="""SELECT article_id, coalesce(NULLIF(act_type, ''), '') || CASE WHEN number <> '' THEN ' nr. ' || number ELSE '' END || CASE WHEN year <> 0 THEN ' din ' || CAST(year AS VARCHAR) ELSE '' END AS act,
  CASE WHEN label <> '' THEN label WHEN number <> '' THEN 'Articolul ' || number ELSE 'Articol #' || CAST(ordinal AS VARCHAR) END AS article,
  CASE WHEN number <> '' THEN number ELSE 'Anexa ' || CAST(ordinal AS VARCHAR) END AS annex,
  CASE WHEN label <> '' THEN label WHEN number <> '' THEN 'Art. ' || number ELSE 'Ordine ' || CAST(ordinal AS VARCHAR) END || ' (added)' AS change,
  coalesce(NULLIF(concat_ws(' > ', CASE WHEN t <> 0 THEN 'Titlul ' || CAST(t AS VARCHAR) END, CASE WHEN c <> 0 THEN 'Cap. ' || CAST(c AS VARCHAR) END, CASE WHEN s <> 0 THEN 'Sect. ' || CAST(s AS VARCHAR) END), ''), 'N/A') AS path
FROM (SELECT article_id, ordinal, 'LEGE' AS act_type, CASE WHEN article_id % 3 > 0 THEN article_number ELSE '' END AS number,
   CASE WHEN article_id % 2 = 0 THEN 1990 + ordinal ELSE 0 END AS year, CASE WHEN article_id % 5 = 0 THEN issue ELSE '' END AS label,
   ordinal % 3 AS t, CASE WHEN ordinal % 2 = 0 THEN ordinal END AS c, ordinal % 4 AS s FROM articles)""",
    ),
)
def display_names(spark, sf_dir):
    key, ordinal = F.col("article_id"), F.col("ordinal")
    rows = doc_lines(spark, sf_dir).select(
        "article_id",
        "ordinal",
        F.lit("LEGE").alias("act_type"),
        F.when(key % 3 > 0, F.col("article_number")).otherwise("").alias("number"),
        F.when(key % 2 == 0, ordinal + 1990).otherwise(0).alias("year"),
        F.when(key % 5 == 0, F.col("issue")).otherwise("").alias("label"),
        (ordinal % 3).alias("t"),
        F.when(ordinal % 2 == 0, ordinal).alias("c"),
        (ordinal % 4).alias("s"),
    )
    return rows.select(
        "article_id",
        act_name("act_type", "number", "year").alias("act"),
        article_name("label", "number", "ordinal", "article_id").alias("article"),
        annex_name("number", "ordinal").alias("annex"),
        change_name("label", "number", "ordinal", F.lit("added")).alias("change"),
        hierarchy_path("t", "c", "s", F.lit(None).cast("int")).alias("path"),
    )


@REGISTRY.query(
    "row_flags",
    with_ctes(
        DOC_LINES_SQL,
        body="""SELECT article_id, ai_status = 'completed' AS processed, remote_id IS NOT NULL AS exported, coalesce(issue = 'ai', false) AS by_ai,
  CASE WHEN ai_status = 'error' THEN true ELSE coalesce(coalesce(issue, '') <> '' AND coalesce(explanation, '') <> '' AND issue <> explanation, false) END AS changed FROM articles""",
    ),
)
def row_flags(spark, sf_dir):
    kind = F.when(F.col("ai_status") == "error", "added").otherwise("modified")
    return doc_lines(spark, sf_dir).select(
        "article_id",
        is_processed("ai_status").alias("processed"),
        is_exported("remote_id").alias("exported"),
        is_ai_generated("issue").alias("by_ai"),
        has_text_change(kind, "issue", "explanation").alias("changed"),
    )


@REGISTRY.query(
    "unified_columns",
    "SELECT CAST(o_orderkey AS VARCHAR) AS act_number, year(o_orderdate)::INTEGER AS act_date, o_orderpriority AS title, o_orderkey AS article_number, o_orderstatus AS text, '' AS issue, '' AS explanation FROM orders",
)
def unified_columns(spark, sf_dir):
    """Old column names become current ones, the current one wins, missing label columns are added."""
    old = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("Nr"),
        F.col("o_orderstatus").alias("Text_Articol"),
        F.year("o_orderdate").alias("Data_An"),
        F.lit("old").alias("Denumire"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderkey").alias("Art.1"),
        F.lit(0).alias("Art.2"),
    )
    return art.with_defaults(art.unify_columns(old))


@REGISTRY.query(
    "clean_articles",
    with_ctes(
        DOC_LINES_SQL,
        body="SELECT article_id, NULLIF(trim(issue), '') AS issue FROM articles WHERE length(trim(text)) > 5",
    ),
)
def clean_articles(spark, sf_dir):
    rows = art.drop_short_articles(art.drop_blank_articles(doc_lines(spark, sf_dir)))
    return art.blanks_to_null(rows, "issue").select("article_id", "issue")


@REGISTRY.query(
    "first_row_metadata",
    with_ctes(
        DOC_LINES_SQL,
        body="SELECT act_id, text AS title, ai_status FROM articles WHERE ordinal = 1",
    ),
)
def first_row_metadata(spark, sf_dir):
    rows = doc_lines(spark, sf_dir).withColumn("title", F.col("text"))
    return art.first_row_metadata(rows, ["title", "ai_status"], group="act_id")


# ---------------------------------------------------------------- statistics


@REGISTRY.query("acts_by_type", with_ctes(ORDER_ACTS_SQL, body="SELECT act_type, count(*) AS n FROM acts GROUP BY act_type ORDER BY n DESC"))
def acts_by_type(spark, sf_dir):
    return stats.count_by(order_acts(spark, sf_dir), "act_type")


@REGISTRY.query(
    "acts_by_year_top10",
    with_ctes(ORDER_ACTS_SQL, body="SELECT act_year, count(*) AS n FROM acts WHERE act_year IS NOT NULL GROUP BY act_year ORDER BY act_year DESC LIMIT 10"),
)
def acts_by_year_top10(spark, sf_dir):
    return stats.newest_years(order_acts(spark, sf_dir), "act_year")


@REGISTRY.query(
    "global_stats",
    with_ctes(
        ORDER_ACTS_SQL,
        LINE_ARTICLES_SQL,
        LINKS_SQL,
        body="""SELECT (SELECT count(*) FROM acts) AS total_acts, (SELECT max(created_at) FROM acts) AS last_import,
  (SELECT count(*) FROM articles) AS total_articles, (SELECT count(*) FROM links) AS total_links,
  (SELECT count(*) FROM links WHERE status = 'pending_scraping') AS n_pending_scraping, (SELECT count(*) FROM links WHERE status = 'processing') AS n_processing,
  (SELECT count(*) FROM links WHERE status = 'completed') AS n_completed, (SELECT count(*) FROM links WHERE status = 'failed') AS n_failed,
  round((SELECT count(*) FROM articles) / (SELECT count(*) FROM acts)::DOUBLE, 1) AS avg_articles_per_act""",
    ),
)
def global_stats(spark, sf_dir):
    return stats.global_counts(order_acts(spark, sf_dir), line_articles(spark, sf_dir), links(spark, sf_dir))


@REGISTRY.query(
    "recent_changes",
    with_ctes(ORDER_ACTS_SQL, body=f"SELECT count(*) FILTER (WHERE created_at > {AS_OF_SQL} - INTERVAL 30 DAY) AS recent_changes FROM acts"),
)
def recent_changes(spark, sf_dir):
    return stats.recent_changes(order_acts(spark, sf_dir), "created_at", AS_OF)


@REGISTRY.query("latest_time", "SELECT max(ts) AS latest FROM events")
def latest_time(spark, sf_dir):
    return stats.latest(table(spark, sf_dir, "events"), "ts")


@REGISTRY.query(
    "status_histogram",
    with_ctes(
        LINE_ARTICLES_SQL,
        body="""SELECT count(*) FILTER (WHERE ai_status = 'pending') AS n_pending, count(*) FILTER (WHERE ai_status = 'processing') AS n_processing,
  count(*) FILTER (WHERE ai_status = 'completed') AS n_completed, count(*) FILTER (WHERE ai_status = 'error') AS n_error, count(*) AS total FROM articles""",
    ),
)
def status_histogram(spark, sf_dir):
    return stats.status_histogram(line_articles(spark, sf_dir), "ai_status")


@REGISTRY.query(
    "export_histogram",
    with_ctes(
        ORDER_ACTS_SQL,
        body="""SELECT count(*) FILTER (WHERE export_status = 'pending') AS n_pending, count(*) FILTER (WHERE export_status = 'exported') AS n_exported,
  count(*) FILTER (WHERE export_status = 'error') AS n_error, count(*) AS total FROM acts WHERE ai_status = 'completed'""",
    ),
)
def export_histogram(spark, sf_dir):
    done = order_acts(spark, sf_dir).where("ai_status = 'completed'")
    return stats.status_histogram(done, "export_status", ("pending", "exported", "error"))


_COVERAGE_SQL = """coverage AS (SELECT act_id, count(*) AS n_articles,
    count(*) FILTER (WHERE coalesce(issue, '') <> '' OR coalesce(explanation, '') <> '') AS n_labelled FROM articles GROUP BY act_id)"""


@REGISTRY.query(
    "label_coverage",
    with_ctes(
        ORDER_ACTS_SQL,
        LINE_ARTICLES_SQL,
        _COVERAGE_SQL,
        body="""SELECT a.act_id, coalesce(n_articles, 0) AS n_articles, coalesce(n_labelled, 0) AS n_labelled,
  coalesce(round(n_labelled * 100.0::DOUBLE / n_articles, 2), 0) AS coverage FROM acts a LEFT JOIN coverage c ON a.act_id = c.act_id""",
    ),
)
def label_coverage(spark, sf_dir):
    coverage = stats.label_coverage(line_articles(spark, sf_dir))
    return stats.coverage_with_acts(order_acts(spark, sf_dir).select("act_id"), coverage)


@REGISTRY.query(
    "issue_coverage",
    with_ctes(
        LINE_ARTICLES_SQL,
        body="""SELECT act_id, count(*) AS n_articles, count(issue) AS n_labelled, round(count(issue) * 100.0::DOUBLE / NULLIF(count(*), 0), 2) AS coverage
FROM articles GROUP BY act_id HAVING count(*) > 0""",
    ),
)
def issue_coverage(spark, sf_dir):
    return stats.issue_coverage(line_articles(spark, sf_dir))


@REGISTRY.query(
    "pending_per_act",
    with_ctes(
        ORDER_ACTS_SQL,
        LINE_ARTICLES_SQL,
        body="""SELECT a.act_id, a.act_type || ' ' || a.act_number || '/' || CAST(a.act_year AS VARCHAR) AS act, count(*) AS n_pending
FROM acts a JOIN articles r ON a.act_id = r.act_id WHERE r.ai_status = 'pending' GROUP BY ALL""",
    ),
)
def pending_per_act(spark, sf_dir):
    rows = stats.pending_per_act(order_acts(spark, sf_dir), line_articles(spark, sf_dir))
    label = F.concat("act_type", F.lit(" "), "act_number", F.lit("/"), F.col("act_year").cast("string"))
    return rows.select("act_id", label.alias("act"), "n_pending")


@REGISTRY.query(
    "category_stats",
    with_ctes(
        CATEGORIES_SQL,
        ACT_CATEGORIES_SQL,
        LINE_ARTICLES_SQL,
        body="""SELECT c.category_id, c.name, count(DISTINCT ac.act_id) AS n_acts, CAST(sum(s.n) AS BIGINT) AS n_articles
FROM categories c LEFT JOIN act_categories ac ON c.category_id = ac.category_id
LEFT JOIN (SELECT act_id, count(*) AS n FROM articles GROUP BY act_id) s ON ac.act_id = s.act_id
WHERE c.is_active GROUP BY c.category_id, c.name""",
    ),
)
def category_stats(spark, sf_dir):
    rows = stats.category_statistics(categories(spark, sf_dir), act_categories(spark, sf_dir), line_articles(spark, sf_dir))
    return rows.select("category_id", "name", "n_acts", "n_articles")


@REGISTRY.query("top_sources", with_ctes(LINKS_SQL, body="SELECT url, act_count FROM links WHERE act_count > 0 ORDER BY act_count DESC, url LIMIT 10"))
def top_sources(spark, sf_dir):
    return search.top_sources(links(spark, sf_dir))


@REGISTRY.query(
    "related_counts",
    with_ctes(
        ISSUES_SQL,
        ACT_ISSUES_SQL,
        ARTICLE_ISSUES_SQL,
        ANNEX_ISSUES_SQL,
        body="""SELECT issue_id, name, (SELECT count(*) FROM act_issues a WHERE a.issue_id = i.issue_id) AS n_acts,
  (SELECT count(*) FROM article_issues a WHERE a.issue_id = i.issue_id) AS n_articles,
  (SELECT count(*) FROM annex_issues a WHERE a.issue_id = i.issue_id) AS n_annexes FROM issues i""",
    ),
)
def related_counts(spark, sf_dir):
    junctions = {
        "acts": act_issues(spark, sf_dir),
        "articles": article_issues(spark, sf_dir),
        "annexes": annex_issues(spark, sf_dir),
    }
    rows = stats.related_counts(issues(spark, sf_dir), junctions)
    return rows.select("issue_id", "name", "n_acts", "n_articles", "n_annexes")


@REGISTRY.query(
    "outcome_counts",
    "SELECT count(*) FILTER (WHERE event_type = 'error') AS n_error, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'click') AS n_click FROM events",
)
def outcome_counts(spark, sf_dir):
    return stats.outcome_counts(table(spark, sf_dir, "events"), "event_type", ("error", "view", "click"))


@REGISTRY.query(
    "metadata_variants",
    "SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_l_returnflag, count(DISTINCT l_linestatus) AS n_l_linestatus, count(DISTINCT l_suppkey) AS n_l_suppkey FROM lineitem GROUP BY l_orderkey",
)
def metadata_variants(spark, sf_dir):
    return stats.distinct_value_counts(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus", "l_suppkey"])


@REGISTRY.query(
    "document_statistics",
    with_ctes(
        DOC_LINES_SQL,
        body="""SELECT act_id, count(*) AS n_articles, count(*) FILTER (WHERE length(text) > 10) AS n_with_content, CAST(sum(length(text)) AS BIGINT) AS n_chars,
  round(avg(length(text)), 4) AS mean_chars, count(DISTINCT issue) AS n_chapters, count(DISTINCT ai_status) AS n_sections FROM articles GROUP BY act_id""",
    ),
)
def document_statistics(spark, sf_dir):
    return art.document_statistics(doc_lines(spark, sf_dir), group="act_id", chapter="issue", section="ai_status")


# ---------------------------------------------------------------- sequences


@REGISTRY.query(
    "article_dedupe_longest",
    with_ctes(
        DOC_LINES_SQL,
        body="""SELECT act_id, article_number, article_id, text FROM (SELECT *, row_number() OVER (PARTITION BY act_id, article_number ORDER BY length(text) DESC, ordinal) AS rn FROM articles) WHERE rn = 1""",
    ),
)
def article_dedupe_longest(spark, sf_dir):
    rows = doc_lines(spark, sf_dir).select("act_id", "article_number", "article_id", "text", "ordinal")
    return art.dedupe_longest(rows).select("act_id", "article_number", "article_id", "text")


@REGISTRY.query(
    "number_gaps",
    """SELECT l_orderkey, n + 1 AS gap_start, nxt - 1 AS gap_end, nxt - n - 1 AS n_missing FROM
 (SELECT l_orderkey, n, lead(n) OVER (PARTITION BY l_orderkey ORDER BY n) AS nxt FROM (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem))
WHERE nxt - n > 1""",
)
def number_gaps(spark, sf_dir):
    return ordered.number_gaps(table(spark, sf_dir, "lineitem"), group="l_orderkey", number="l_linenumber")


@REGISTRY.query("duplicate_numbers", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_numbers(spark, sf_dir):
    return ordered.duplicate_numbers(table(spark, sf_dir, "lineitem"), group="l_orderkey", number="l_linenumber")


@REGISTRY.query(
    "order_violations",
    """SELECT user_id, event_id, k, previous FROM (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
   lag(CAST(json_extract_string(props, '$.k') AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE previous > k""",
)
def order_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return ordered.order_violations(rows, group="user_id", order="event_id", number="k", chunk=10_000)


@REGISTRY.query("row_positions", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS position FROM events")
def row_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id")
    return ordered.with_position(rows, group="event_type", order="event_id", chunk=10_000)


@REGISTRY.query(
    "heading_changes",
    """SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
WHERE before IS DISTINCT FROM event_type""",
)
def heading_changes(spark, sf_dir):
    """A heading is printed where it differs from the one before."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    rows = ordered.with_neighbour(rows, group="user_id", order="event_id", value="event_type", name="before", chunk=10_000)
    return rows.where(~F.col("before").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", "event_type")


@REGISTRY.query(
    "validate_extraction",
    """SELECT l_orderkey, n_articles, n_duplicated, n_missing, n_short, CAST((n_duplicated > 0)::INTEGER + (n_missing > 0)::INTEGER + (n_short > 0)::INTEGER AS INTEGER) AS n_issues,
  n_duplicated + n_missing + n_short = 0 AS is_valid,
  round(1.0::DOUBLE - ((n_duplicated > 0)::INTEGER + (n_missing > 0)::INTEGER + (n_short > 0)::INTEGER) * 0.15::DOUBLE, 2) AS quality_score
FROM (SELECT l_orderkey, CAST(sum(c) AS BIGINT) AS n_articles, count(*) FILTER (WHERE c > 1) AS n_duplicated,
    CAST(max(l_linenumber) - min(l_linenumber) + 1 - count(*) AS BIGINT) AS n_missing, CAST(sum(s) AS BIGINT) AS n_short
  FROM (SELECT l_orderkey, l_linenumber, count(*) AS c, count(*) FILTER (WHERE length(CAST(l_partkey AS VARCHAR)) < 3) AS s FROM lineitem GROUP BY ALL) GROUP BY l_orderkey)""",
)
def validate_extraction(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("text"))
    return art.validate_extraction(rows, group="l_orderkey", number="l_linenumber", min_text=3)


@REGISTRY.query(
    "validation_details",
    """SELECT l_orderkey, 'duplicate' AS problem, CAST(l_linenumber AS BIGINT) AS first, CAST(l_linenumber AS BIGINT) AS last FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT l_orderkey, 'missing', n + 1, nxt - 1 FROM
 (SELECT l_orderkey, n, lead(n) OVER (PARTITION BY l_orderkey ORDER BY n) AS nxt FROM (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem)) WHERE nxt - n > 1""",
)
def validation_details(spark, sf_dir):
    return art.validation_details(table(spark, sf_dir, "lineitem"), group="l_orderkey", number="l_linenumber")


# ---------------------------------------------------------------- result files

_FILES_SQL = """files AS (
  SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'notes_' || CAST(o_orderkey AS VARCHAR) || '.csv'
     ELSE 'LEGE_' || CAST(o_custkey AS VARCHAR) || '_' || strftime(o_orderdate + to_seconds(CAST(o_orderkey AS INTEGER)), '%Y%m%d_%H%M%S')
       || CASE WHEN o_orderkey % 3 = 0 THEN '.md' ELSE '.csv' END END AS name, CAST(o_totalprice AS BIGINT) AS bytes,
     CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END AS cust, o_orderdate + to_seconds(CAST(o_orderkey AS INTEGER)) AS ts,
     o_orderkey % 3 = 0 AND o_orderkey % 11 > 0 AS is_md FROM orders)"""


def _files(spark, sf_dir):
    key = F.col("o_orderkey")
    stamp = F.date_format(F.col("o_orderdate") + F.make_interval(secs=key), "yyyyMMdd_HHmmss")
    name = F.when(key % 11 == 0, F.concat(F.lit("notes_"), key.cast("string"), F.lit(".csv"))).otherwise(
        F.concat(
            F.lit("LEGE_"), F.col("o_custkey").cast("string"), F.lit("_"), stamp, F.when(key % 3 == 0, ".md").otherwise(".csv")
        )
    )
    return spread(table(spark, sf_dir, "orders")).select(name.alias("name"), F.col("o_totalprice").cast("long").alias("bytes"))


@REGISTRY.query(
    "retain_latest",
    with_ctes(
        _FILES_SQL.replace("CAST(o_totalprice AS BIGINT)", "CAST(trunc(o_totalprice) AS BIGINT)"),
        body="""SELECT name, 'LEGE_' || CAST(cust AS VARCHAR) AS act, row_number() OVER (PARTITION BY cust ORDER BY ts DESC, name DESC) = 1 AS keep,
  CAST(floor(epoch(TIMESTAMP '2002-01-01 00:00:00' - ts) / 86400) AS INTEGER) AS age_days FROM files WHERE cust IS NOT NULL AND NOT is_md""",
    ),
)
def retain_latest(spark, sf_dir):
    rows = tables.retain_latest(_files(spark, sf_dir), as_of=datetime(2002, 1, 1))
    return rows.select("name", "act", "keep", "age_days")


@REGISTRY.query(
    "storage_stats",
    with_ctes(
        _FILES_SQL.replace("CAST(o_totalprice AS BIGINT)", "CAST(trunc(o_totalprice) AS BIGINT)"),
        """old AS (SELECT name FROM (SELECT name, row_number() OVER (PARTITION BY cust ORDER BY ts DESC, name DESC) AS rn FROM files WHERE cust IS NOT NULL AND NOT is_md) WHERE rn > 1)""",
        """dropped AS (SELECT name FROM old UNION SELECT name FROM files WHERE is_md AND replace(name, '.md', '.csv') IN (SELECT name FROM old))""",
        body="""SELECT count(*) FILTER (WHERE name LIKE '%.csv') AS n_csv, count(*) FILTER (WHERE name LIKE '%.md') AS n_md, CAST(sum(bytes) AS BIGINT) AS total_bytes,
  round(avg(bytes), 2) AS mean_bytes, count(*) FILTER (WHERE name LIKE '%.csv' AND name IN (SELECT name FROM dropped)) AS n_superseded,
  CAST(coalesce(sum(bytes) FILTER (WHERE name IN (SELECT name FROM dropped)), 0) AS BIGINT) AS wasted_bytes,
  round(coalesce(sum(bytes) FILTER (WHERE name IN (SELECT name FROM dropped)), 0) * 100.0::DOUBLE / sum(bytes), 1) AS saving_percent FROM files""",
    ),
)
def storage_stats(spark, sf_dir):
    return tables.storage_stats(_files(spark, sf_dir))


PAGES = 8


@REGISTRY.query(
    "list_pages_by_key",
    with_ctes(
        ORDER_ACTS_SQL,
        body=f"""SELECT act_id, CAST((row_number() OVER (ORDER BY issuer ASC NULLS LAST, act_date DESC NULLS FIRST, act_id) - 1) // size AS INTEGER) AS page
FROM acts, (SELECT CAST(ceil(count(*) / {PAGES}.0) AS BIGINT) AS size FROM acts)""",
    ),
)
def list_pages_by_key(spark, sf_dir):
    """All pages of a list in mixed order, each found by the last row of the one before; that row and the counts of ranges reach the driver."""
    keys = ("issuer", "-act_date", "act_id")
    acts = order_acts(spark, sf_dir).select("act_id", "issuer", "act_date")
    size = -(-acts.count() // PAGES)
    after, pages = None, []
    for number, last in enumerate(search.rows_at(acts, keys, [size * (n + 1) for n in range(PAGES)])):
        page = search.page_after(acts, *keys, after=after, last=last, limit=size, max_limit=size)
        pages.append(page.select("act_id", F.lit(number).alias("page")))
        if last is None:
            break
        after = last
    return functools.reduce(DataFrame.unionByName, pages)
