"""From raw pages to act and article tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import basic_metadata, full_metadata
from ..functions.text import is_present
from ..operators.articles import confidence_score, post_process, validate_extraction
from ..operators.html import ACT_PAGES, article_bodies, article_rows, detect_content_type, html_elements, page_metadata
from ..operators.render import render_pages
from ..session import stored


def page_acts(elements: DataFrame, *, key: str = "page_id") -> DataFrame:
    """Act metadata per page: basic values, filled from the fuller patterns where missing."""
    texts = page_metadata(elements, key=key)
    packed = texts.select(
        key,
        basic_metadata("designation", "header").alias("b"),
        full_metadata("designation", "header", "issuer", "publication").alias("f"),
    )
    return packed.select(
        key,
        F.coalesce("b.act_type", "f.act_type").alias("act_type"),
        F.coalesce("b.act_number", "f.act_number").alias("act_number"),
        "f.act_date",
        F.coalesce("f.act_year", "b.act_year").alias("act_year"),
        "f.date_is_approximate",
        F.coalesce("b.title", "f.title").alias("title"),
        "f.issuer",
        "f.gazette_nr",
        "f.gazette_date",
        "f.gazette_year",
    )


def parse_pages(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> dict[str, DataFrame]:
    """articles, acts (metadata, metrics, validation), errors and Markdown blocks of marked-up pages.

    The elements are written once to the shared folder: four outputs are built from them, each of a few columns, and HTML
    is by far the largest thing to read and parse. A page that is not HTML or yields no article is a row in ``errors``.
    """
    typed = pages.withColumn("content_type", detect_content_type(html))
    usable = typed.where(F.col("content_type") == "html")
    elements = html_elements(usable.select(key, html), key=key, html=html, selector=ACT_PAGES, nested=True)
    elements = stored(elements, "elements")
    acts = page_acts(elements, key=key)
    bodies = article_bodies(elements, key=key)
    rows = article_rows(elements, key=key)
    texts = article_bodies(elements, key=key, markdown=False)
    rows = rows.join(texts, (rows[key] == texts[key]) & (rows["pos"] == texts["article_pos"]), "left").drop(
        texts[key], "article_pos", "tag", "classes"
    )
    rows = rows.withColumnsRenamed({"text": "article_label", "body": "text"}).withColumn(
        "text", F.coalesce("text", F.lit(""))
    )
    rows = rows.join(acts, key, "left").withColumnRenamed("pos", "ordinal")
    scores = confidence_score(rows, group=key)
    articles = post_process(rows, group=key)
    checks = validate_extraction(articles, group=key)
    metrics = acts.join(scores.select(key, "confidence"), key, "left").join(
        checks.drop("n_articles"), key, "left"
    )
    counts = articles.groupBy(key).agg(F.count("*").alias("n_articles"))
    metrics = metrics.join(counts, key, "left").na.fill({"n_articles": 0, "confidence": 0.0})
    found = counts.select(key)
    reason = F.when(F.col("content_type") != "html", "not HTML").otherwise("no articles found")
    errors = typed.join(found, key, "left_anti").select(key, "content_type", reason.alias("error"))
    titles = elements.where(F.array_contains("classes", "S_ART_TTL")).groupBy(key).agg(F.count("*").alias("n_articles"))
    headers = acts.join(titles, key, "left").na.fill({"n_articles": 0})
    issues = articles.select(key, "article_number", "issue")
    blocks = render_pages(elements, bodies, headers, key=key, issues=issues.where(is_present("issue")))
    return {"articles": articles, "acts": metrics, "errors": errors, "blocks": blocks}
