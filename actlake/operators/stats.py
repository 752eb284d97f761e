"""Counts, histograms and coverage. Every aggregate combines map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.labels import has_labels
from .singles import beside


def global_counts(acts: DataFrame, articles: DataFrame, links: DataFrame) -> DataFrame:
    """One row: totals, link statuses, articles per act, last import.

    Three single-row aggregates side by side; each table is read once.
    """
    a = acts.agg(F.count("*").alias("total_acts"), F.max("created_at").alias("last_import"))
    r = articles.agg(F.count("*").alias("total_articles"))
    status = F.col("status")
    link = links.agg(
        F.count("*").alias("total_links"),
        *[F.count_if(status == s).alias(f"n_{s}") for s in vocab.LINK_STATUSES],
    )
    combined = beside(a, r, link)
    average = F.round(F.col("total_articles") / F.col("total_acts"), 1)
    return combined.withColumn(
        "avg_articles_per_act", F.when(F.col("total_acts") > 0, average).otherwise(0.0)
    )


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def newest_years(df: DataFrame, year: str, limit: int = 10) -> DataFrame:
    counts = df.where(F.col(year).isNotNull()).groupBy(year).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col(year).desc()).limit(limit)


def latest(df: DataFrame, column: str, name: str = "latest") -> DataFrame:
    return df.agg(F.max(column).alias(name))


def recent_changes(df: DataFrame, column: str, as_of, days: int = 30) -> DataFrame:
    recent = F.col(column) > F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.agg(F.count_if(recent).alias("recent_changes"))


def status_histogram(df: DataFrame, status: str, values: tuple[str, ...] = vocab.AI_STATUSES) -> DataFrame:
    """One row with a count per status (0 where none) and the total, in one pass."""
    counts = [F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values]
    return df.agg(*counts, F.count("*").alias("total"))


def label_coverage(
    articles: DataFrame, *, act: str = "act_id", issue: str = "issue", explanation: str = "explanation"
) -> DataFrame:
    """Articles, labelled articles (blank is no label) and percentage per act."""
    counted = articles.groupBy(act).agg(
        F.count("*").alias("n_articles"), F.count_if(has_labels(issue, explanation)).alias("n_labelled")
    )
    return counted.withColumn("coverage", F.round(F.col("n_labelled") * 100.0 / F.col("n_articles"), 2))


def coverage_with_acts(acts: DataFrame, coverage: DataFrame, *, act: str = "act_id") -> DataFrame:
    """Coverage for every act, 0 for acts without articles."""
    return acts.join(coverage, act, "left").na.fill({"n_articles": 0, "n_labelled": 0, "coverage": 0.0})


def issue_coverage(articles: DataFrame, *, act: str = "act_id", issue: str = "issue") -> DataFrame:
    """Coverage by the not-NULL test of one label column; acts without articles do not appear."""
    counted = articles.groupBy(act).agg(F.count("*").alias("n_articles"), F.count(issue).alias("n_labelled"))
    percent = F.round(F.col("n_labelled") * 100.0 / F.nullif(F.col("n_articles"), F.lit(0)), 2)
    return counted.where("n_articles > 0").withColumn("coverage", percent)


def pending_per_act(acts: DataFrame, articles: DataFrame, *, act: str = "act_id", status: str = "ai_status") -> DataFrame:
    """Pending articles per act; counted before the join, so the join meets one row per act."""
    pending = articles.where(F.col(status) == "pending").groupBy(act).agg(F.count("*").alias("n_pending"))
    return acts.join(pending, act)


def category_statistics(
    categories: DataFrame, act_categories: DataFrame, articles: DataFrame, *, act: str = "act_id", category: str = "category_id"
) -> DataFrame:
    """Acts and articles per active category; categories without acts stay with 0 acts."""
    per_act = articles.groupBy(act).agg(F.count("*").alias("n"))
    pairs = act_categories.select(act, category).distinct().join(per_act, act, "left")
    per_category = pairs.groupBy(category).agg(F.count("*").alias("n_acts"), F.sum("n").alias("n_articles"))
    active = categories.where(F.col("is_active"))
    return active.join(per_category, category, "left").na.fill({"n_acts": 0})


def related_counts(issues: DataFrame, junctions: dict[str, DataFrame], *, issue: str = "issue_id") -> DataFrame:
    """Per issue the number of rows in each junction table, 0 where none.

    The junctions are counted in one aggregate over their union: one shuffle of partial
    counts instead of one join each.
    """
    tagged = None
    for name, table in junctions.items():
        rows = table.select(issue, F.lit(name).alias("_kind"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    counts = tagged.groupBy(issue).agg(
        *[F.count_if(F.col("_kind") == name).alias(f"n_{name}") for name in junctions]
    )
    return issues.join(counts, issue, "left").na.fill({f"n_{name}": 0 for name in junctions})


def child_counts(
    parents: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str, *, salts: int = 32
) -> DataFrame:
    """COUNT(DISTINCT id) per parent and child table, without the child-by-child product.

    ``children`` maps a name to (table, id column). Children of other parents are dropped
    by one semi-join before distinct ids are taken. It also runs on a salt made of the
    child's id, so a parent with very many children is met by ``salts`` tasks.
    """
    ids = None
    for name, (table, id_column) in children.items():
        rows = table.where(F.col(id_column).isNotNull())
        rows = rows.select(key, F.lit(name).alias("_kind"), F.col(id_column).cast("string").alias("_id"))
        ids = rows if ids is None else ids.unionByName(rows)
    every_salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    wanted = parents.select(key, every_salt.alias("_salt"))
    ids = ids.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts).cast("long")))
    ids = ids.join(wanted, [key, "_salt"], "left_semi").distinct()
    counts = ids.groupBy(key).agg(*[F.count_if(F.col("_kind") == name).alias(f"n_{name}") for name in children])
    return parents.join(counts, key, "left").na.fill({f"n_{name}": 0 for name in children})


def outcome_counts(results: DataFrame, outcome: str, values: tuple[str, ...]) -> DataFrame:
    """Tallies of a batch, one column per outcome."""
    return results.agg(*[F.count_if(F.col(outcome) == v).alias(f"n_{v}") for v in values])


def distinct_value_counts(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Distinct non-NULL values per column and group."""
    return df.groupBy(group).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def table_audit(spark, expected: tuple[str, ...], database: str | None = None) -> DataFrame:
    """How many of the expected tables the catalog holds; a look at metadata only."""
    tables = [t.name for t in (spark.catalog.listTables(database) if database else spark.catalog.listTables())]
    rows = [(name, name in tables) for name in expected]
    return spark.createDataFrame(rows, "table_name string, present boolean")
