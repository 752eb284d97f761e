"""The driver's tables in the roles of acts, articles, annexes, issues, categories and links.

Each role is given twice: as a DataFrame and as the SQL of a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import vocab
from ..operators.tables import dealt
from ..sources.readers import read_table

WS_SQL = "' ' || " + " || ".join(f"chr({ord(c)})" for c in vocab.WHITESPACE if c != " ")


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Its schema is read from the files once, not once per query."""
    key = (sf_dir, name)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = read_table(spark, sf_dir, name).schema
    return read_table(spark, sf_dir, name, _SCHEMAS[key])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give row-heavy work one task per core where a test table is a single small file."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)


def strip_sql(expression: str) -> str:
    return f"trim({expression}, {WS_SQL})"


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


# ---------------------------------------------------------------- acts from orders

ORDER_ACTS_SQL = """acts AS (
  SELECT o_orderkey AS act_id, o_orderpriority AS act_type, CAST(o_orderkey AS VARCHAR) AS act_number,
         CAST(year(o_orderdate) AS INTEGER) AS act_year, CAST(o_orderdate AS DATE) AS act_date,
         o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) AS title,
         CASE WHEN o_custkey % 9 <> 0 THEN 'issuer ' || CAST(o_custkey AS VARCHAR) END AS issuer,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END AS ai_status,
         CASE o_orderkey % 4 WHEN 0 THEN 'exported' WHEN 1 THEN 'error' ELSE 'pending' END AS export_status,
         CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey + 7 AS INTEGER) END AS remote_id,
         o_totalprice AS amount, o_orderdate AS created_at,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS ai_processed_at
  FROM orders)"""


def order_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        key.alias("act_id"),
        F.col("o_orderpriority").alias("act_type"),
        key.cast("string").alias("act_number"),
        F.year("o_orderdate").alias("act_year"),
        F.to_date("o_orderdate").alias("act_date"),
        F.concat("o_orderpriority", F.lit(" "), key.cast("string")).alias("title"),
        F.when(F.col("o_custkey") % 9 != 0, F.concat(F.lit("issuer "), F.col("o_custkey").cast("string"))).alias("issuer"),
        F.when(status == "F", "completed").when(status == "O", "pending").otherwise("processing").alias("ai_status"),
        F.when(key % 4 == 0, "exported").when(key % 4 == 1, "error").otherwise("pending").alias("export_status"),
        F.when(key % 4 == 0, (key + 7).cast("int")).alias("remote_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("created_at"),
        F.when(status != "O", F.col("o_orderdate")).alias("ai_processed_at"),
    )


# articles of those acts; a line number may repeat in an order, so ids may too
LINE_ARTICLES_SQL = """articles AS (
  SELECT l_orderkey AS act_id, l_orderkey * 10 + l_linenumber AS article_id, l_linenumber AS ordinal,
         CAST(l_linenumber AS VARCHAR) AS article_number,
         CASE WHEN l_returnflag = 'A' THEN 'topic ' || l_linestatus WHEN l_returnflag = 'N' THEN '' END AS issue,
         CASE WHEN l_linenumber % 3 = 0 THEN 'see ' || CAST(l_partkey AS VARCHAR) END AS explanation,
         CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'pending' ELSE 'error' END AS ai_status,
         l_shipdate AS ai_processed_at
  FROM lineitem)"""


def line_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("act_id"),
        (F.col("l_orderkey") * 10 + line).alias("article_id"),
        line.alias("ordinal"),
        line.cast("string").alias("article_number"),
        F.when(flag == "A", F.concat(F.lit("topic "), "l_linestatus")).when(flag == "N", "").alias("issue"),
        F.when(line % 3 == 0, F.concat(F.lit("see "), F.col("l_partkey").cast("string"))).alias("explanation"),
        F.when(flag == "A", "completed").when(flag == "N", "pending").otherwise("error").alias("ai_status"),
        F.col("l_shipdate").alias("ai_processed_at"),
    )


# categories from brands, pairs from the parts of an order
CATEGORIES_SQL = """categories AS (
  SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS category_id, CAST(substr(p_brand, 7) AS BIGINT) + 100 AS remote_id,
         p_brand AS name, lower(replace(p_brand, '#', '-')) AS slug, 'parts of ' || p_brand AS description,
         CASE WHEN CAST(substr(p_brand, 7) AS BIGINT) % 2 = 0 THEN '#00' ELSE '#FF' END AS color, CAST(NULL AS VARCHAR) AS icon,
         CAST(CAST(substr(p_brand, 7) AS BIGINT) % 3 AS INTEGER) AS sort_order,
         CAST(substr(p_brand, 7) AS BIGINT) % 5 <> 0 AS is_active
  FROM part)"""
ACT_CATEGORIES_SQL = """act_categories AS (
  SELECT DISTINCT l_orderkey AS act_id, CAST(substr(p_brand, 7) AS BIGINT) AS category_id
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("p_brand", 7, 10).cast("long")
    return table(spark, sf_dir, "part").select("p_brand").distinct().select(
        number.alias("category_id"),
        (number + 100).alias("remote_id"),
        F.col("p_brand").alias("name"),
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("slug"),
        F.concat(F.lit("parts of "), "p_brand").alias("description"),
        F.when(number % 2 == 0, "#00").otherwise("#FF").alias("color"),
        F.lit(None).cast("string").alias("icon"),
        (number % 3).cast("int").alias("sort_order"),
        (number % 5 != 0).alias("is_active"),
    )


def act_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 10).cast("long").alias("category_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("act_id"), F.col("l_partkey").alias("p_partkey"))
    return dealt(lines.join(parts, "p_partkey").select("act_id", "category_id"), "act_id", "category_id").distinct()


# ---------------------------------------------------------------- acts from documents

DOC_ACTS_SQL = """acts AS (
  SELECT doc_id AS act_id, upper(lang) AS act_type, CAST(doc_id AS VARCHAR) AS act_number,
         CAST(1995 + doc_id % 30 AS INTEGER) AS act_year, string_split(text, chr(10))[1] AS title, source AS issuer,
         CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' ELSE 'completed' END AS ai_status,
         CASE doc_id % 3 WHEN 0 THEN 'exported' WHEN 1 THEN 'pending' ELSE 'error' END AS export_status,
         CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id + 50000 AS INTEGER) END AS remote_id,
         CASE WHEN doc_id % 5 = 0 THEN 'about ' || lang END AS summary,
         CASE WHEN doc_id % 4 = 1 THEN 'failed ' || CAST(doc_id AS VARCHAR) END AS ai_error,
         CASE WHEN doc_id % 4 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) END AS ai_processed_at
  FROM documents)"""


def doc_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "documents").select(
        key.alias("act_id"),
        F.upper("lang").alias("act_type"),
        key.cast("string").alias("act_number"),
        (F.lit(1995) + key % 30).cast("int").alias("act_year"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("issuer"),
        F.when(key % 4 == 0, "pending").when(key % 4 == 1, "error").otherwise("completed").alias("ai_status"),
        F.when(key % 3 == 0, "exported").when(key % 3 == 1, "pending").otherwise("error").alias("export_status"),
        F.when(key % 3 == 0, (key + 50000).cast("int")).alias("remote_id"),
        F.when(key % 5 == 0, F.concat(F.lit("about "), "lang")).alias("summary"),
        F.when(key % 4 == 1, F.concat(F.lit("failed "), key.cast("string"))).alias("ai_error"),
        F.when(key % 4 != 0, start + F.make_interval(hours=key.cast("int"))).alias("ai_processed_at"),
    )


DOC_LINES_SQL = """articles AS (
  SELECT act_id, act_id * 1000000 + ordinal AS article_id, CAST(ordinal AS INTEGER) AS ordinal,
         CASE WHEN act_id % 7 = 3 AND ordinal = 3 THEN '2' ELSE CAST(ordinal AS VARCHAR) END AS article_number,
         text,
         CASE WHEN (act_id + ordinal) % 3 = 0 THEN 'topic ' || CAST(ordinal % 5 AS VARCHAR) WHEN (act_id + ordinal) % 7 = 0 THEN '' END AS issue,
         CASE WHEN (act_id + ordinal) % 4 = 1 THEN 'see the order ' || CAST(ordinal AS VARCHAR) END AS explanation,
         CASE WHEN (act_id + ordinal) % 6 = 0 THEN 'summary ' || CAST(ordinal AS VARCHAR) END AS summary,
         CASE (act_id + ordinal) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' ELSE 'completed' END AS ai_status,
         CASE WHEN (act_id + ordinal) % 8 = 2 THEN CAST(act_id AS INTEGER) END AS remote_id,
         CASE WHEN (act_id + ordinal) % 4 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(ordinal AS INTEGER)) END AS ai_processed_at,
         CASE WHEN (act_id + ordinal) % 4 = 1 THEN 'timeout' END AS ai_error
  FROM (SELECT doc_id AS act_id, unnest(string_split(text, chr(10))) AS text,
               generate_subscripts(string_split(text, chr(10)), 1) AS ordinal FROM documents))"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as articles."""
    lines = documents(spark, sf_dir).select(
        F.col("doc_id").alias("act_id"), F.posexplode(F.split("text", "\n")).alias("at", "text")
    )
    lines = lines.withColumn("ordinal", F.col("at") + 1)
    both = F.col("act_id") + F.col("ordinal")
    number = F.when((F.col("act_id") % 7 == 3) & (F.col("ordinal") == 3), "2").otherwise(F.col("ordinal").cast("string"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return lines.select(
        "act_id",
        (F.col("act_id") * 1000000 + F.col("ordinal")).alias("article_id"),
        "ordinal",
        number.alias("article_number"),
        "text",
        F.when(both % 3 == 0, F.concat(F.lit("topic "), (F.col("ordinal") % 5).cast("string"))).when(both % 7 == 0, "").alias("issue"),
        F.when(both % 4 == 1, F.concat(F.lit("see the order "), F.col("ordinal").cast("string"))).alias("explanation"),
        F.when(both % 6 == 0, F.concat(F.lit("summary "), F.col("ordinal").cast("string"))).alias("summary"),
        F.when(both % 4 == 0, "pending").when(both % 4 == 1, "error").otherwise("completed").alias("ai_status"),
        F.when(both % 8 == 2, F.col("act_id").cast("int")).alias("remote_id"),
        F.when(both % 4 != 0, start + F.make_interval(hours=F.col("ordinal"))).alias("ai_processed_at"),
        F.when(both % 4 == 1, "timeout").alias("ai_error"),
    )


ANNEXES_SQL = """annexes AS (
  SELECT conv_id AS act_id, conv_id * 1000 + turn AS annex_id, CAST(turn + 1 AS INTEGER) AS ordinal,
         CASE WHEN role <> 'assistant' THEN 'A' || CAST(turn AS VARCHAR) END AS annex_nr, role AS title, text AS content,
         CAST(NULL AS VARCHAR) AS summary,
         CASE role WHEN 'assistant' THEN 'completed' WHEN 'user' THEN 'pending' ELSE 'error' END AS ai_status,
         CASE WHEN turn % 5 = 1 THEN CAST(conv_id AS INTEGER) END AS remote_id,
         CASE WHEN role <> 'user' THEN TIMESTAMP '2024-02-01 00:00:00' + to_hours(CAST(turn AS INTEGER)) END AS ai_processed_at,
         CASE WHEN role = 'system' THEN 'too long' END AS ai_error
  FROM conversations)"""


def annexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    role, turn = F.col("role"), F.col("turn")
    start = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("act_id"),
        (F.col("conv_id") * 1000 + turn).alias("annex_id"),
        (turn + 1).cast("int").alias("ordinal"),
        F.when(role != "assistant", F.concat(F.lit("A"), turn.cast("string"))).alias("annex_nr"),
        role.alias("title"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("summary"),
        F.when(role == "assistant", "completed").when(role == "user", "pending").otherwise("error").alias("ai_status"),
        F.when(turn % 5 == 1, F.col("conv_id").cast("int")).alias("remote_id"),
        F.when(role != "user", start + F.make_interval(hours=turn.cast("int"))).alias("ai_processed_at"),
        F.when(role == "system", "too long").alias("ai_error"),
    )


ISSUES_SQL = """issues AS (
  SELECT item_id AS issue_id, substr(text, 1, 40) || ' ' || CAST(item_id AS VARCHAR) AS name, text AS description,
         CASE WHEN item_id % 2 = 0 THEN 'ai' ELSE 'manual' END AS source, (item_id % 100) / 100.0::DOUBLE AS confidence,
         CASE WHEN item_id % 3 = 0 THEN CAST(item_id + 500 AS INTEGER) END AS remote_id
  FROM benchmark)"""
ARTICLE_ISSUES_SQL = """article_issues AS (
  SELECT DISTINCT user_id * 1000000 + event_id % 7 + 1 AS article_id, event_id % 40 AS issue_id FROM events)"""
ACT_ISSUES_SQL = """act_issues AS (
  SELECT DISTINCT doc_id AS act_id, (doc_id * 7 + quality) % 40 AS issue_id FROM labels)"""
ANNEX_ISSUES_SQL = """annex_issues AS (
  SELECT DISTINCT conv_id * 1000 + turn AS annex_id, (conv_id + turn) % 40 AS issue_id FROM conversations WHERE role = 'assistant')"""


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        item.alias("issue_id"),
        F.concat(F.substring("text", 1, 40), F.lit(" "), item.cast("string")).alias("name"),
        F.col("text").alias("description"),
        F.when(item % 2 == 0, "ai").otherwise("manual").alias("source"),
        ((item % 100) / 100.0).alias("confidence"),
        F.when(item % 3 == 0, (item + 500).cast("int")).alias("remote_id"),
    )


def article_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") * 1000000 + event % 7 + 1).alias("article_id"), (event % 40).alias("issue_id")
    ).distinct()


def act_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("act_id"), ((F.col("doc_id") * 7 + F.col("quality")) % 40).alias("issue_id")
    ).distinct()


def annex_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("annex_id"), ((F.col("conv_id") + F.col("turn")) % 40).alias("issue_id")
    ).distinct()


LINKS_SQL = """links AS (
  SELECT page_id AS link_id, url, CASE page_id % 4 WHEN 0 THEN 'pending_scraping' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
         CAST(page_id % 13 AS INTEGER) AS act_count
  FROM pages)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        key.alias("link_id"),
        "url",
        F.when(key % 4 == 0, "pending_scraping").when(key % 4 == 1, "processing").when(key % 4 == 2, "completed").otherwise("failed").alias("status"),
        (key % 13).cast("int").alias("act_count"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")
