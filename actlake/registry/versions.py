"""Version comparison, table changes and streams."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import decided, decision, levenshtein_similarity, significant_change
from ..operators import diff as d
from ..operators import tables
from ..session import ensure_checkpoint_dir
from ..plans.views import update_package
from ..sources import storage
from ..streaming import generations, jobs
from . import Registry
from . import views as views_queries
from .bind import (
    ACT_CATEGORIES_SQL,
    CATEGORIES_SQL,
    DOC_LINES_SQL,
    LINE_ARTICLES_SQL,
    ORDER_ACTS_SQL,
    act_categories,
    annexes,
    categories,
    doc_acts,
    doc_lines,
    line_articles,
    order_acts,
    table,
    with_ctes,
)

REGISTRY = Registry()

TS = datetime(2025, 1, 1)
TS_SQL = "TIMESTAMP '2025-01-01 00:00:00'"

# the new version: by act, nothing, dropped lines, changed lines, an inserted line, lost numbers
OLD_SQL = DOC_LINES_SQL.replace("articles AS (", "old AS (", 1)
NEW_SQL = """new AS (
  SELECT act_id, article_id + 500000 AS article_id, ordinal,
         CASE WHEN act_id % 5 = 4 AND ordinal % 2 = 0 THEN NULL ELSE article_number END AS article_number,
         CASE WHEN act_id % 5 = 2 AND ordinal % 3 = 0 THEN text || ' amended' ELSE text END AS text
  FROM old WHERE NOT (act_id % 5 = 1 AND ordinal % 4 = 0)
  UNION ALL SELECT doc_id, doc_id * 1000000 + 900000, 900000, 'new', 'Inserted article' FROM documents WHERE doc_id % 5 = 3)"""
DIFF_SQL = """ow AS (SELECT act_id, article_number, article_id FROM (SELECT *, row_number() OVER (PARTITION BY act_id, article_number ORDER BY ordinal DESC, article_id DESC) AS rn FROM old WHERE coalesce(article_number, '') <> '') WHERE rn = 1),
nw AS (SELECT act_id, article_number, article_id FROM (SELECT *, row_number() OVER (PARTITION BY act_id, article_number ORDER BY ordinal DESC, article_id DESC) AS rn FROM new WHERE coalesce(article_number, '') <> '') WHERE rn = 1),
p1 AS (SELECT ow.article_id AS oid, nw.article_id AS nid FROM ow JOIN nw ON ow.act_id = nw.act_id AND ow.article_number = nw.article_number),
ro AS (SELECT act_id, ordinal, article_id FROM (SELECT *, row_number() OVER (PARTITION BY act_id, ordinal ORDER BY article_id DESC) AS rn FROM old WHERE article_id NOT IN (SELECT oid FROM p1)) WHERE rn = 1),
rn AS (SELECT act_id, ordinal, article_id FROM (SELECT *, row_number() OVER (PARTITION BY act_id, ordinal ORDER BY article_id DESC) AS rn FROM new WHERE article_id NOT IN (SELECT nid FROM p1)) WHERE rn = 1),
pairs AS (SELECT * FROM p1 UNION ALL SELECT ro.article_id, rn.article_id FROM ro JOIN rn ON ro.act_id = rn.act_id AND ro.ordinal = rn.ordinal),
diff AS (
  SELECT o.act_id, CASE WHEN o.text <> n.text THEN 'modified' ELSE 'unchanged' END AS change_type, o.article_id AS old_article_id, n.article_id AS new_article_id,
         coalesce(NULLIF(n.article_number, ''), o.article_number) AS article_number, o.text AS old_text, n.text AS new_text, o.issue AS old_issue, o.ordinal AS ordinal
  FROM pairs JOIN old o ON pairs.oid = o.article_id JOIN new n ON pairs.nid = n.article_id
  UNION ALL SELECT act_id, 'deleted', article_id, NULL, article_number, text, NULL, issue, ordinal FROM old WHERE article_id NOT IN (SELECT oid FROM pairs)
  UNION ALL SELECT act_id, 'added', NULL, article_id, article_number, NULL, text, NULL, ordinal FROM new WHERE article_id NOT IN (SELECT nid FROM pairs))"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = doc_lines(spark, sf_dir).select("act_id", "article_id", "ordinal", "article_number", "text", "issue", "explanation")
    act, line = F.col("act_id"), F.col("ordinal")
    kept = old.where(~((act % 5 == 1) & (line % 4 == 0))).select(
        "act_id",
        (F.col("article_id") + 500000).alias("article_id"),
        "ordinal",
        F.when(~((act % 5 == 4) & (line % 2 == 0)), F.col("article_number")).alias("article_number"),
        F.when((act % 5 == 2) & (line % 3 == 0), F.concat("text", F.lit(" amended"))).otherwise(F.col("text")).alias("text"),
    )
    inserted = table(spark, sf_dir, "documents").where("doc_id % 5 = 3").select(
        F.col("doc_id").alias("act_id"),
        (F.col("doc_id") * 1000000 + 900000).alias("article_id"),
        F.lit(900000).alias("ordinal"),
        F.lit("new").alias("article_number"),
        F.lit("Inserted article").alias("text"),
    )
    return old, kept.unionByName(inserted)


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.diff_articles(*_versions(spark, sf_dir), threshold=1.0, with_similarity=False)


@REGISTRY.query(
    "diff_classify",
    with_ctes(
        OLD_SQL,
        NEW_SQL,
        DIFF_SQL,
        body="""SELECT act_id, change_type, old_article_id, new_article_id, article_number, CASE WHEN change_type <> 'unchanged' THEN old_text END AS old_text,
  CASE WHEN change_type <> 'unchanged' THEN new_text END AS new_text FROM diff""",
    ),
)
def diff_classify(spark, sf_dir):
    """Every difference counts (threshold 1), so the whole comparison stays in the JVM."""
    return _diff(spark, sf_dir).select(
        "act_id", "change_type", "old_article_id", "new_article_id", "article_number", "old_text", "new_text"
    )


@REGISTRY.query("diff_similarity")
def diff_similarity(spark, sf_dir):
    """The same comparison with the similarity threshold of imports."""
    rows = d.diff_articles(*_versions(spark, sf_dir), threshold=0.95)
    return rows.select("act_id", "change_type", "old_article_id", "new_article_id", F.round("similarity", 6).alias("similarity"))


# every line against an edited one: appended, inserted in the middle, letters changed, reversed, a half twice, the same
_EDITED_SQL = """edited AS (SELECT act_id, ordinal, coalesce(text, '') AS a, CASE ordinal % 6 WHEN 0 THEN text || ' amended'
  WHEN 1 THEN left(text, CAST(length(text) // 2 AS INTEGER)) || ' new' || substr(text, CAST(length(text) // 2 AS INTEGER) + 1)
  WHEN 2 THEN replace(text, 'ou', 'u') WHEN 3 THEN reverse(text) WHEN 4 THEN left(text, CAST(length(text) // 2 AS INTEGER)) || text ELSE text END AS b FROM articles)"""
# what bounds say of the pairs (a, b) of "edited", with its other columns
DECIDED_SQL = """split AS (SELECT *, length(a) + length(b) AS total, string_split(a, '') AS x, string_split(b, '') AS y, levenshtein(a, b) AS edits FROM edited),
bounds AS (SELECT *,
  2.0::DOUBLE * least(length(a), length(b)) / greatest(total, 1) AS by_length,
  2.0::DOUBLE * coalesce(list_sum(list_transform(list_filter(list_distinct(x), lambda c: c <> ''), lambda c: least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))))), 0) / greatest(total, 1) AS by_characters,
  2.0::DOUBLE * greatest(
    coalesce(list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: x[i] <> y[i]), true), least(length(a), length(b)) + 1) - 1,
    coalesce(list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: x[length(a) + 1 - i] <> y[length(b) + 1 - i]), true), least(length(a), length(b)) + 1) - 1) / greatest(total, 1) AS by_edge FROM split),
decided AS (SELECT *, CASE WHEN a = b THEN 'similar' WHEN a = '' OR b = '' THEN 'significant' WHEN by_length < 0.95 THEN 'significant' WHEN by_edge >= 0.95 THEN 'similar'
  WHEN by_characters < 0.95 THEN 'significant' WHEN edits > floor((1 - 0.95::DOUBLE) * total + 1e-9) THEN 'significant' ELSE 'open' END AS decision FROM bounds)"""


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir).select("act_id", "ordinal", F.coalesce("text", F.lit("")).alias("a"))
    text, half, turn = F.col("a"), F.floor(F.length("a") / 2).cast("int"), F.col("ordinal") % 6
    edited = (
        F.when(turn == 0, F.concat(text, F.lit(" amended")))
        .when(turn == 1, F.concat(F.left(text, half), F.lit(" new"), text.substr(half + 1, F.length(text))))
        .when(turn == 2, F.replace(text, F.lit("ou"), F.lit("u")))
        .when(turn == 3, F.reverse(text))
        .when(turn == 4, F.concat(F.left(text, half), text))
        .otherwise(text)
    )
    return rows.withColumn("b", edited)


@REGISTRY.query(
    "diff_threshold",
    with_ctes(
        DOC_LINES_SQL,
        _EDITED_SQL,
        DECIDED_SQL,
        body="""SELECT act_id, ordinal, decision, CASE decision WHEN 'open' THEN 1 - edits / greatest(length(a), length(b))::DOUBLE < 0.95 ELSE decision = 'significant' END AS significant FROM decided""",
    ),
)
def diff_threshold(spark, sf_dir):
    """Which changes count at the threshold of imports: decided by bounds, and what they leave open by edit distance."""
    rows = _edited(spark, sf_dir).withColumn("found", decided("a", "b"))
    return rows.select("act_id", "ordinal", "found.decision", significant_change(F.col("found"), "a", "b").alias("significant"))


@REGISTRY.query(
    "diff_decisions",
    with_ctes(DOC_LINES_SQL, _EDITED_SQL, DECIDED_SQL, body="SELECT CAST(ordinal % 6 AS INTEGER) AS edit, decision, count(*) AS n FROM decided GROUP BY ALL"),
)
def diff_decisions(spark, sf_dir):
    """How many pairs of each kind of edit the bounds decide, and how many they leave open."""
    rows = _edited(spark, sf_dir).select((F.col("ordinal") % 6).cast("int").alias("edit"), decision("a", "b").alias("decision"))
    return rows.groupBy("edit", "decision").agg(F.count("*").alias("n"))


_SUMMARY_SQL = """summary AS (SELECT act_id, count(*) FILTER (WHERE change_type = 'added') AS n_added, count(*) FILTER (WHERE change_type = 'modified') AS n_modified,
  count(*) FILTER (WHERE change_type = 'deleted') AS n_deleted, count(*) FILTER (WHERE change_type = 'unchanged') AS n_unchanged,
  count(*) FILTER (WHERE change_type IN ('added', 'modified', 'deleted')) AS n_changes, count(*) FILTER (WHERE change_type IN ('added', 'modified')) AS n_relabel FROM diff GROUP BY act_id)"""


@REGISTRY.query("diff_summary", with_ctes(OLD_SQL, NEW_SQL, DIFF_SQL, _SUMMARY_SQL, body="SELECT * FROM summary"))
def diff_summary(spark, sf_dir):
    return d.diff_summary(_diff(spark, sf_dir))


@REGISTRY.query(
    "next_versions",
    with_ctes(
        OLD_SQL,
        NEW_SQL,
        DIFF_SQL,
        _SUMMARY_SQL,
        body="""SELECT s.act_id, CAST(CASE WHEN act_id % 3 = 0 THEN 1 ELSE act_id % 4 + 2 END AS INTEGER) AS version,
  CASE WHEN act_id % 3 = 0 THEN 'initial' WHEN n_changes < n_unchanged + n_modified + n_deleted THEN 'update_partial' ELSE 'update_full' END AS kind,
  n_added, n_modified, n_deleted, n_unchanged + n_modified + n_added AS n_articles FROM summary s""",
    ),
)
def next_versions(spark, sf_dir):
    stored = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select(
        F.col("doc_id").alias("act_id"), (F.col("doc_id") % 4 + 1).cast("int").alias("version")
    )
    return d.next_versions(d.diff_summary(_diff(spark, sf_dir)), stored)


@REGISTRY.query(
    "change_log",
    with_ctes(
        OLD_SQL,
        NEW_SQL,
        DIFF_SQL,
        body="""SELECT act_id, CASE WHEN change_type = 'deleted' THEN old_article_id ELSE new_article_id END AS article_id, article_number, change_type, ordinal,
  CASE WHEN change_type <> 'added' THEN old_text END AS old_text, CASE WHEN change_type <> 'added' THEN old_issue END AS old_issue, CASE WHEN change_type <> 'deleted' THEN new_text END AS new_text,
  change_type <> 'deleted' AS needs_relabel FROM diff WHERE change_type <> 'unchanged'""",
    ),
)
def change_log(spark, sf_dir):
    return d.change_log(_diff(spark, sf_dir)).select(
        "act_id", "article_id", "article_number", "change_type", "ordinal", "old_text", "old_issue", "new_text", "needs_relabel"
    )


@REGISTRY.query(
    "relabel_payloads",
    with_ctes(
        OLD_SQL,
        NEW_SQL,
        DIFF_SQL,
        body="""SELECT new_article_id AS article_id, change_type, CASE WHEN change_type = 'modified' THEN old_text END AS old_text, new_text FROM diff WHERE change_type IN ('added', 'modified')""",
    ),
)
def relabel_payloads(spark, sf_dir):
    queue = d.relabel_queue(d.change_log(_diff(spark, sf_dir)))
    rows = queue.select("article_id", d.relabel_payload(queue).alias("p"))
    at = lambda path: F.get_json_object("p", path)
    return rows.select("article_id", at("$.change_type").alias("change_type"), at("$.old.text").alias("old_text"), at("$.new.text").alias("new_text"))


@REGISTRY.query(
    "version_history",
    "SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS version FROM (SELECT DISTINCT user_id, ts FROM events)",
)
def version_history(spark, sf_dir):
    return d.version_history(table(spark, sf_dir, "events").select("user_id", "ts"), act="user_id")


@REGISTRY.query(
    "similarity_lev",
    "SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE, 6) AS similarity FROM part",
)
def similarity_lev(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(levenshtein_similarity("p_name", "p_type"), 6).alias("similarity"))


# ---------------------------------------------------------------- table changes


@REGISTRY.query(
    "upsert_acts",
    with_ctes(
        ORDER_ACTS_SQL,
        """target AS (SELECT act_id, act_type, title, CAST(act_id % 3 + 1 AS INTEGER) AS version, created_at FROM acts WHERE act_id % 3 > 0)""",
        """source AS (SELECT act_id, 'NEW' AS act_type, upper(title) AS title, created_at FROM acts WHERE act_id % 2 = 0 OR act_id % 3 = 0)""",
        body=f"""SELECT coalesce(t.act_id, s.act_id) AS act_id, CASE WHEN s.act_id IS NOT NULL THEN s.act_type ELSE t.act_type END AS act_type,
  CASE WHEN s.act_id IS NOT NULL THEN s.title ELSE t.title END AS title,
  CAST(CASE WHEN t.act_id IS NULL THEN 1 WHEN s.act_id IS NULL THEN t.version ELSE t.version + 1 END AS INTEGER) AS version,
  coalesce(t.created_at, s.created_at) AS created_at FROM target t FULL JOIN source s ON t.act_id = s.act_id""",
    ),
)
def upsert_acts(spark, sf_dir):
    acts = order_acts(spark, sf_dir)
    target = acts.where("act_id % 3 > 0").select(
        "act_id", "act_type", "title", (F.col("act_id") % 3 + 1).cast("int").alias("version"), "created_at"
    )
    source = acts.where("act_id % 2 = 0 OR act_id % 3 = 0").select("act_id", F.lit("NEW").alias("act_type"), F.upper("title").alias("title"), "created_at")
    return tables.upsert(target, source, "act_id")


@REGISTRY.query(
    "insert_if_absent",
    "SELECT doc_id, 'inserted' AS outcome FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'rejected' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def insert_if_absent(spark, sf_dir):
    inserted, rejected = tables.insert_if_absent(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id")
    return inserted.select("doc_id", F.lit("inserted").alias("outcome")).unionByName(
        rejected.select("doc_id", F.lit("rejected").alias("outcome"))
    )


@REGISTRY.query(
    "partial_update",
    with_ctes(
        ORDER_ACTS_SQL,
        body=f"""SELECT act_id, CASE WHEN act_id % 4 = 0 THEN 'patched' ELSE title END AS title, CASE WHEN act_id % 4 < 2 AND act_id % 8 < 2 THEN NULL ELSE issuer END AS issuer,
  CASE WHEN act_id % 4 < 2 THEN {TS_SQL} ELSE created_at END AS created_at FROM acts""",
    ),
)
def partial_update(spark, sf_dir):
    acts = order_acts(spark, sf_dir).select("act_id", "title", "issuer", "created_at")
    patch = acts.where("act_id % 4 < 2").select(
        "act_id",
        F.when(F.col("act_id") % 4 == 0, "patched").alias("title"),
        F.lit(None).cast("string").alias("issuer"),
        (F.col("act_id") % 8 < 2).alias("has_issuer"),
    )
    return tables.partial_update(acts, patch, "act_id", touched="created_at", ts=TS)


_UPDATES_SQL = """updates AS (SELECT event_id AS seq, user_id * 1000000 + event_id % 9 + 1 AS article_id, event_id % 2 = 0 AS has_issue, event_type AS issue, event_id % 3 = 0 AS has_explanation,
   CASE WHEN event_id % 6 > 0 THEN props END AS explanation FROM events)"""


def _updates(spark, sf_dir):
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        event.alias("seq"),
        (F.col("user_id") * 1000000 + event % 9 + 1).alias("article_id"),
        (event % 2 == 0).alias("has_issue"),
        F.col("event_type").alias("issue"),
        (event % 3 == 0).alias("has_explanation"),
        F.when(event % 6 > 0, F.col("props")).alias("explanation"),
    )


@REGISTRY.query(
    "batch_update_labels",
    with_ctes(
        DOC_LINES_SQL,
        _UPDATES_SQL,
        "i AS (SELECT article_id, arg_max_null(issue, seq) AS issue FROM updates WHERE has_issue GROUP BY article_id)",
        "e AS (SELECT article_id, arg_max_null(explanation, seq) AS explanation FROM updates WHERE has_explanation GROUP BY article_id)",
        body="""SELECT r.article_id, CASE WHEN i.article_id IS NOT NULL THEN i.issue ELSE r.issue END AS issue, CASE WHEN e.article_id IS NOT NULL THEN e.explanation ELSE r.explanation END AS explanation
FROM articles r LEFT JOIN i ON r.article_id = i.article_id LEFT JOIN e ON r.article_id = e.article_id""",
    ),
)
def batch_update_labels(spark, sf_dir):
    updated, _, _ = tables.batch_update_labels(doc_lines(spark, sf_dir), _updates(spark, sf_dir))
    return updated.select("article_id", "issue", "explanation")


@REGISTRY.query(
    "batch_update_counts",
    with_ctes(
        DOC_LINES_SQL,
        _UPDATES_SQL,
        body="""SELECT count(*) FILTER (WHERE article_id IN (SELECT article_id FROM articles)) AS updated, count(*) AS total,
  count(*) FILTER (WHERE article_id NOT IN (SELECT article_id FROM articles)) AS n_missing FROM updates""",
    ),
)
def batch_update_counts(spark, sf_dir):
    return tables.batch_update_labels(doc_lines(spark, sf_dir), _updates(spark, sf_dir))[2]


@REGISTRY.query(
    "update_labels",
    with_ctes(
        DOC_LINES_SQL,
        body="SELECT article_id, CASE WHEN ordinal % 2 = 0 THEN 'set' ELSE issue END AS issue, CASE WHEN ordinal % 2 > 0 THEN explanation END AS explanation FROM articles",
    ),
)
def update_labels(spark, sf_dir):
    articles = doc_lines(spark, sf_dir)
    updates = articles.where("ordinal % 2 = 0").select("article_id", F.lit("set").alias("issue"), F.lit(None).cast("string").alias("explanation"))
    return tables.update_labels(articles, updates).select("article_id", "issue", "explanation")


@REGISTRY.query(
    "delete_cascade",
    """SELECT 'acts' AS table_name, o_orderkey AS act_id, CAST(NULL AS BIGINT) AS article_id FROM orders WHERE o_orderkey % 10 > 0
UNION ALL SELECT 'articles', l_orderkey, l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_orderkey % 10 > 0
UNION ALL SELECT 'changes', user_id,
  CASE WHEN (event_id % 50) % 10 > 0 OR NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = event_id % 50 AND l.l_linenumber = 1) THEN (event_id % 50) * 10 + 1 END
FROM events WHERE user_id % 10 > 0""",
)
def delete_cascade(spark, sf_dir):
    """Every tenth act goes, with its articles and changes; changes of other acts lose dead article ids."""
    acts, articles = order_acts(spark, sf_dir).select("act_id"), line_articles(spark, sf_dir).select("act_id", "article_id")
    changes = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("act_id"), ((F.col("event_id") % 50) * 10 + 1).alias("article_id")
    )
    left = tables.delete_cascade(
        {"acts": acts, "articles": articles, "changes": changes},
        acts.where("act_id % 10 = 0"),
        set_null={"changes": ("article_id", articles)},
    )
    rows = [
        left["acts"].select(F.lit("acts").alias("table_name"), "act_id", F.lit(None).cast("long").alias("article_id")),
        left["articles"].select(F.lit("articles").alias("table_name"), "act_id", "article_id"),
        left["changes"].select(F.lit("changes").alias("table_name"), "act_id", "article_id"),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@REGISTRY.query(
    "delete_articles",
    with_ctes(LINE_ARTICLES_SQL, body="SELECT act_id, article_id FROM articles WHERE article_id NOT IN (SELECT article_id FROM articles WHERE ai_status = 'error')"),
)
def delete_articles(spark, sf_dir):
    articles = line_articles(spark, sf_dir)
    return tables.delete_rows(articles, articles.where("ai_status = 'error'"), "article_id").select("act_id", "article_id")


@REGISTRY.query(
    "replace_children",
    with_ctes(
        DOC_LINES_SQL,
        body="SELECT act_id, text FROM articles WHERE act_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'labelled ' || CAST(quality AS VARCHAR) FROM labels",
    ),
)
def replace_children(spark, sf_dir):
    new = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("act_id"), F.concat(F.lit("labelled "), F.col("quality").cast("string")).alias("text")
    )
    return tables.replace_children(doc_lines(spark, sf_dir).select("act_id", "text"), new)


@REGISTRY.query("backfill", with_ctes(DOC_LINES_SQL, body="SELECT article_id, coalesce(summary, explanation) AS summary FROM articles"))
def backfill(spark, sf_dir):
    return tables.backfill(doc_lines(spark, sf_dir)).select("article_id", "summary")


@REGISTRY.query(
    "touch_updated_at",
    with_ctes(ORDER_ACTS_SQL, body=f"SELECT act_id, CASE WHEN ai_status = 'pending' THEN {TS_SQL} ELSE created_at END AS updated_at FROM acts"),
)
def touch_updated_at(spark, sf_dir):
    acts = order_acts(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    return tables.touch(acts, F.col("ai_status") == "pending", TS).select("act_id", "updated_at")


# requests for pairs: an event asks for (user, k % 25); pairs held are those of lineitem
_REQUESTS_SQL = """requests AS (SELECT user_id AS act_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 25 + 1 AS category_id FROM events)"""


def _requests(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("act_id"), (k % 25 + 1).alias("category_id"))


@REGISTRY.query(
    "link_categories",
    with_ctes(ACT_CATEGORIES_SQL, CATEGORIES_SQL, _REQUESTS_SQL, body="SELECT act_id, category_id FROM act_categories UNION SELECT act_id, category_id FROM requests"),
)
def link_categories(spark, sf_dir):
    return tables.link_pairs(act_categories(spark, sf_dir), _requests(spark, sf_dir), ("act_id", "category_id"))[0]


@REGISTRY.query(
    "link_categories_counts",
    with_ctes(
        ACT_CATEGORIES_SQL,
        _REQUESTS_SQL,
        """fresh AS (SELECT count(*) AS n FROM (SELECT act_id, category_id FROM requests EXCEPT SELECT act_id, category_id FROM act_categories))""",
        body="SELECT n AS added, (SELECT count(*) FROM requests) - n AS skipped FROM fresh",
    ),
)
def link_categories_counts(spark, sf_dir):
    return tables.link_pairs(act_categories(spark, sf_dir), _requests(spark, sf_dir), ("act_id", "category_id"))[1]


@REGISTRY.query(
    "unlink_categories",
    with_ctes(ACT_CATEGORIES_SQL, _REQUESTS_SQL, body="SELECT act_id, category_id FROM act_categories EXCEPT SELECT act_id, category_id FROM requests"),
)
def unlink_categories(spark, sf_dir):
    return tables.unlink_pairs(act_categories(spark, sf_dir), _requests(spark, sf_dir), ("act_id", "category_id"))[0]


@REGISTRY.query(
    "unlink_categories_count",
    with_ctes(ACT_CATEGORIES_SQL, _REQUESTS_SQL, body="SELECT count(*) AS removed FROM (SELECT act_id, category_id FROM act_categories INTERSECT SELECT act_id, category_id FROM requests)"),
)
def unlink_categories_count(spark, sf_dir):
    return tables.unlink_pairs(act_categories(spark, sf_dir), _requests(spark, sf_dir), ("act_id", "category_id"))[1]


@REGISTRY.query(
    "replace_categories",
    with_ctes(
        ACT_CATEGORIES_SQL,
        CATEGORIES_SQL,
        _REQUESTS_SQL,
        body="""SELECT act_id, category_id FROM act_categories WHERE act_id NOT IN (SELECT act_id FROM requests) OR category_id NOT IN (SELECT category_id FROM categories WHERE is_active)
UNION SELECT act_id, category_id FROM requests""",
    ),
)
def replace_categories(spark, sf_dir):
    return tables.replace_pairs(act_categories(spark, sf_dir), _requests(spark, sf_dir), categories(spark, sf_dir))


def _remote(spark, sf_dir):
    """The feed: one category in seven is gone, some have new names, three are new."""
    n = F.col("category_id")
    held = categories(spark, sf_dir).where(n % 7 > 0).select(
        "remote_id", F.when(n % 4 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"), "slug", "description", "color", "icon"
    )
    new = categories(spark, sf_dir).where("category_id <= 3").select(
        (F.col("remote_id") + 900).alias("remote_id"), F.concat(F.lit("new "), "name").alias("name"), "slug", "description", "color", "icon"
    )
    return held.unionByName(new)


_REMOTE_SQL = """feed AS (SELECT remote_id, CASE WHEN category_id % 4 = 0 THEN upper(name) ELSE name END AS name, slug, description, color, icon FROM categories WHERE category_id % 7 > 0
  UNION ALL SELECT remote_id + 900, 'new ' || name, slug, description, color, icon FROM categories WHERE category_id <= 3)"""


@REGISTRY.query(
    "sync_categories",
    with_ctes(
        CATEGORIES_SQL,
        _REMOTE_SQL,
        body="""SELECT coalesce(l.remote_id, r.remote_id) AS remote_id, coalesce(r.name, l.name) AS name, coalesce(r.slug, l.slug) AS slug, coalesce(r.description, l.description) AS description,
  coalesce(r.color, l.color) AS color, coalesce(r.icon, l.icon) AS icon, l.category_id AS known_id, coalesce(l.sort_order, 0) AS sort_order, r.remote_id IS NOT NULL AS is_active,
  CASE WHEN l.remote_id IS NULL THEN 'created' WHEN r.remote_id IS NULL THEN CASE WHEN l.is_active THEN 'deactivated' ELSE 'kept' END
       WHEN l.name <> r.name OR NOT l.is_active THEN 'updated' ELSE 'touched' END AS action
FROM categories l FULL JOIN feed r ON l.remote_id = r.remote_id""",
    ),
)
def sync_categories(spark, sf_dir):
    """All columns of the local table after a sync; ids of new categories are made from their remote ids."""
    rows = tables.sync_categories(categories(spark, sf_dir), _remote(spark, sf_dir), ts=TS)
    known = F.when(F.col("action") != "created", F.col("category_id")).alias("known_id")
    return rows.select("remote_id", "name", "slug", "description", "color", "icon", known, "sort_order", "is_active", "action")


_WANTED_SQL = """wanted AS (SELECT o_orderkey AS act_id, unnest([o_orderkey % 30 + 101, o_custkey % 30 + 101, 9999]) AS remote_id FROM orders)"""


def _wanted(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("act_id"),
        F.array(F.col("o_orderkey") % 30 + 101, F.col("o_custkey") % 30 + 101, F.lit(9999).cast("long")).alias("remote_ids"),
    )


@REGISTRY.query(
    "sync_act_categories",
    with_ctes(
        CATEGORIES_SQL,
        _WANTED_SQL,
        body="SELECT w.act_id, count(c.category_id) AS n_matched FROM wanted w LEFT JOIN categories c ON w.remote_id = c.remote_id AND c.is_active GROUP BY 1",
    ),
)
def sync_act_categories(spark, sf_dir):
    return tables.sync_act_categories(act_categories(spark, sf_dir), _wanted(spark, sf_dir), categories(spark, sf_dir))[1]


@REGISTRY.query(
    "sync_act_category_pairs",
    with_ctes(
        CATEGORIES_SQL,
        ACT_CATEGORIES_SQL,
        _WANTED_SQL,
        body="""SELECT act_id, category_id FROM act_categories
UNION SELECT w.act_id, c.category_id FROM wanted w JOIN categories c ON w.remote_id = c.remote_id AND c.is_active""",
    ),
)
def sync_act_category_pairs(spark, sf_dir):
    """The pairs after the sync: those that were there and those that the remote ids add."""
    pairs, _ = tables.sync_act_categories(act_categories(spark, sf_dir), _wanted(spark, sf_dir), categories(spark, sf_dir))
    return pairs.select("act_id", "category_id")


# ---------------------------------------------------------------- streams


def _rounds(spark: SparkSession, sf_dir: str, run, *, together: bool = False) -> str:
    """Run a streaming query over event files that arrive in four rounds; the folder it worked in.

    Three rounds of ten days each, then the second once more under another name. The query runs
    after each round from where it stopped, or once over all of them, a file at a time (``together``).
    """
    events = table(spark, sf_dir, "events")
    # in the folder that driver and executors share
    work = f"{ensure_checkpoint_dir(spark).rstrip('/')}/actlake-stream-{uuid.uuid4().hex}"
    day = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    for number, part in enumerate((0, 1, 2, 1)):
        events.where(day == part).write.parquet(f"{work}/in/{number}")
        if together and number < 3:
            continue
        reader = spark.readStream.schema(events.schema).option("recursiveFileLookup", True)
        reader = reader.option("maxFilesPerTrigger", 1) if together else reader
        run(reader.parquet(f"{work}/in"), work).awaitTermination()
    return work


def _changed_rows(stream: DataFrame, work: str, mode: str):
    """Write the rows that each batch of an aggregating stream gives out."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/out/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", f"{work}/checkpoint")
    return writer.trigger(availableNow=True).start()


def _last_rows(spark: SparkSession, work: str, keys: list[str]) -> DataFrame:
    """The newest row of each key among all batches."""
    written = spark.read.parquet(f"{work}/out")
    values = [c for c in written.columns if c not in (*keys, "batch")]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")


@REGISTRY.query(
    "status_latest",
    "SELECT user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def status_latest(spark, sf_dir):
    """Current status per entity from four rounds of events, in update mode."""
    run = lambda events, work: _changed_rows(jobs.current_status(events, key="user_id", status="event_type"), work, "update")
    return _last_rows(spark, _rounds(spark, sf_dir, run), ["user_id"])


@REGISTRY.query("stream_status_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_status_counts(spark, sf_dir):
    """Running counts of events; those of the repeated round are older than the watermark and count once."""

    def run(events, work):
        once = jobs.first_of_each(events, ["event_id"], delay="1 day")
        return _changed_rows(jobs.status_counts(once, status="event_type"), work, "update")

    return _last_rows(spark, _rounds(spark, sf_dir, run), ["event_type"])


@REGISTRY.query("stream_ingest", "SELECT event_id, event_type, value FROM events")
def stream_ingest(spark, sf_dir):
    """New files appended to a table exactly once, the events of a repeated one left out."""

    def run(events, work):
        return jobs.ingest(jobs.first_of_each(events, ["event_id"], delay="1 day"), f"{work}/out", f"{work}/checkpoint")

    return spark.read.parquet(f"{_rounds(spark, sf_dir, run)}/out").select("event_id", "event_type", "value")


@REGISTRY.query(
    "stream_drain",
    """SELECT event_id, CAST(least(event_id % 5 + 1, 3) AS INTEGER) AS attempts, CASE WHEN event_id % 5 > 2 THEN 'busy' END AS error FROM events WHERE event_type = 'error'""",
)
def stream_drain(spark, sf_dir):
    """A work queue taken a file at a time: failed items come back with the next batch, three times at most."""

    def work_on(items):
        return items.select("event_id", F.when(F.col("attempts") < F.col("event_id") % 5, "busy").alias("error"))

    def run(events, work):
        return jobs.drain(events.where("event_type = 'error'"), work_on, f"{work}/queue", f"{work}/checkpoint", key="event_id")

    work = _rounds(spark, sf_dir, run, together=True)
    jobs.retry_open(spark, work_on, f"{work}/queue", key="event_id")
    # the repeated file's items were closed before, so they are closed again
    return jobs.drained(spark, f"{work}/queue").distinct()


_VERSIONS_SQL = """ready_versions AS (SELECT DISTINCT user_id AS act_id, CAST(least((day(ts) - 1) // 10, 2) AS INTEGER) AS version FROM events WHERE event_type = '{0}')"""


def _ready(events: DataFrame, kind: str) -> DataFrame:
    """Events that say an act's version is ready."""
    version = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).cast("int")
    return events.where(F.col("event_type") == kind).select(F.col("user_id").alias("act_id"), version.alias("version"), "ts")


def _packages(spark: SparkSession, work: str, ddl: str) -> DataFrame:
    packages = generations.log(spark, f"{work}/outbox", "packages")
    return packages.select("act_id", "version", "part", F.from_json("package", ddl).alias("p")).select("act_id", "version", "part", "p.*")


@REGISTRY.query(
    "stream_outbox",
    with_ctes(
        views_queries.ACT_PACKAGE_SQL,
        _VERSIONS_SQL.format("purchase"),
        body="SELECT p.act_id, v.version, p.part, p.act_type, p.total_articles, p.processed_articles, p.total_annexes, p.processed_annexes, p.total_issues, p.articles, p.annexes, p.issues FROM packages p JOIN ready_versions v ON p.act_id = v.act_id",
    ),
)
def stream_outbox(spark, sf_dir):
    """Whole packages as JSON, once per act and version, however often and in whichever round the event comes."""
    schema: list[str] = []

    def build(fresh):
        packages = views_queries.act_packages(spark, sf_dir, fresh.select("act_id").distinct()).join(fresh, "act_id")
        schema[:] = [packages.schema["package"].dataType.simpleString()]
        return packages.select("act_id", "version", "part", F.to_json("package").alias("package"))

    def run(events, work):
        once = jobs.first_of_each(_ready(events, "purchase"), ["act_id", "version"], delay="1 day")
        return jobs.outbox(once, f"{work}/outbox", f"{work}/checkpoint", keys=["act_id", "version"], build=build)

    work = _rounds(spark, sf_dir, run)
    return views_queries.flat_package(_packages(spark, work, schema[0]), "version")


@REGISTRY.query(
    "stream_update_sync",
    with_ctes(
        views_queries.UPDATE_PACKAGE_SQL,
        _VERSIONS_SQL.format("view"),
        body="SELECT p.act_id, v.version, p.part, p.remote_id, p.new_articles, p.new_annexes FROM packages p JOIN ready_versions v ON p.act_id = v.act_id",
    ),
)
def stream_update_sync(spark, sf_dir):
    """Update packages of exported acts; events of other acts are dropped by a stream-static semi-join."""
    schema: list[str] = []
    acts, articles, children = doc_acts(spark, sf_dir), doc_lines(spark, sf_dir), annexes(spark, sf_dir)
    exported = acts.where("export_status = 'exported' AND remote_id IS NOT NULL")

    def build(fresh):
        keys = fresh.select("act_id").distinct()
        own = [t.join(keys, "act_id", "left_semi") for t in (exported, articles, children)]
        packages = update_package(*own, part_bytes=views_queries.PART_BYTES).join(fresh, "act_id")
        packages = packages.select("act_id", "version", "part", F.struct("remote_id", "new_articles", "new_annexes").alias("package"))
        schema[:] = [packages.schema["package"].dataType.simpleString()]
        return packages.withColumn("package", F.to_json("package"))

    def run(events, work):
        return jobs.update_sync(_ready(events, "view"), exported, f"{work}/outbox", f"{work}/checkpoint", build=build)

    work = _rounds(spark, sf_dir, run)
    return views_queries.flat_update(_packages(spark, work, schema[0]), "version")


@REGISTRY.query(
    "stream_new_files",
    "SELECT event_id, event_type, CAST(NULL AS VARCHAR) AS error FROM events UNION ALL SELECT NULL, NULL, 'file is empty' FROM range(2)",
)
def stream_new_files(spark, sf_dir):
    """Files that arrive in three rounds, each row once: what was taken is known by name, empty files are error rows, a failed batch is repeated."""
    events = table(spark, sf_dir, "events")
    work = f"{ensure_checkpoint_dir(spark).rstrip('/')}/actlake-files-{uuid.uuid4().hex}"
    fails = [1]

    def handle(batch, paths):
        generations.append(spark.read.schema(events.schema).parquet(*paths), f"{work}/base", "events", batch)
        if batch in fails:
            fails.remove(batch)
            raise RuntimeError("stopped before the commit")

    for number in range(3):
        part = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
        events.where(part == number).write.parquet(f"{work}/in/{number}")
        if number:
            storage.put_empty(spark, f"{work}/in/{number}/empty.parquet")
        try:
            generations.drain_new_files(spark, f"{work}/in", f"{work}/base", handle, suffix=".parquet")
        except RuntimeError:
            generations.drain_new_files(spark, f"{work}/in", f"{work}/base", handle, suffix=".parquet")
    rows = generations.log(spark, f"{work}/base", "events").select("event_id", "event_type", F.lit(None).cast("string").alias("error"))
    errors = generations.known_files(spark, f"{work}/base").where("error IS NOT NULL")
    return rows.unionByName(errors.select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("event_type"), "error"))
