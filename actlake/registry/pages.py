"""Queries over raw pages. Marker elements are h1-h3, p, li and footer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import candidate_urls, canonical_doc_url, document_id, is_valid_source_url
from ..operators.articles import confidence_score, document_statistics
from ..functions.text import int_to_roman
from ..operators.html import (
    GENERIC_PAGES,
    article_bodies,
    article_rows,
    detect_content_type,
    fill_hierarchy,
    html_elements,
    plain_text,
)
from ..plans.parse import parse_pages
from ..session import stored
from ..sources.readers import page_problem
from . import Registry
from .bind import DOC_LINES_SQL, doc_lines, pages, strip_sql, table, with_ctes

REGISTRY = Registry()

_HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<![^>]*>"


def _decode_sql(expression: str) -> str:
    table_ = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", None), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
    for name, char in table_:
        shown = "chr(160)" if char is None else f"'{char}'"
        expression = f"replace({expression}, '{name}', {shown})"
    return expression


def _text_sql(markup: str, separator: str) -> str:
    marked = _decode_sql(rf"regexp_replace({markup}, '</?[A-Za-z][^>]*(?:>|\z)', chr(1), 'g')")
    node = strip_sql("t")
    return f"array_to_string([{node} FOR t IN string_split({marked}, chr(1)) IF {node} <> ''], {separator})"


ELEMENTS_SQL = rf"""pieces AS (
  SELECT page_id, unnest(parts) AS piece, generate_subscripts(parts, 1) - 1 AS pos
  FROM (SELECT page_id, string_split(regexp_replace(regexp_replace(html, '{_HIDDEN}', '', 'g'),
          '(?i)<(h1|h2|h3|p|li|footer)([\s>/])', chr(1) || '\1\2', 'g'), chr(1)) AS parts FROM pages)),
cut AS (
  SELECT page_id, pos, lower(regexp_extract(piece, '^([A-Za-z][A-Za-z0-9]*)', 1)) AS tag,
         CASE WHEN contains(piece, '>') THEN substr(piece, strpos(piece, '>') + 1) ELSE '' END AS rest
  FROM pieces WHERE pos > 0),
elements AS (
  SELECT page_id, CAST(pos AS INTEGER) AS pos, tag,
         CASE tag WHEN 'h1' THEN 'title' WHEN 'h2' THEN 'chapter' WHEN 'h3' THEN 'section' WHEN 'p' THEN 'article'
                  WHEN 'li' THEN 'item' WHEN 'footer' THEN 'footer' END AS kind, text
  FROM (SELECT page_id, pos, tag, {_text_sql('rest', "''")} AS text FROM cut) WHERE text <> '')"""

_FIRST_INT = r"TRY_CAST(NULLIF(regexp_extract(text, '(?:^|[^\p{L}\p{N}_])([0-9]+)(?:$|[^\p{L}\p{N}_])', 1), '') AS INTEGER)"

CONTEXT_SQL = """context AS (
  SELECT page_id, pos, kind, text,
         last_value(CASE WHEN kind = 'title' THEN text END IGNORE NULLS)
           OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS title_name
  FROM elements)"""


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_elements(pages(spark, sf_dir), selector=GENERIC_PAGES)


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = article_rows(_elements(spark, sf_dir), require_number=False)
    return rows.withColumn("act_type", F.lit("page")).withColumn("article_label", F.col("tag"))


@REGISTRY.query(
    "page_elements", with_ctes(ELEMENTS_SQL, body="SELECT page_id, pos, tag, kind, text FROM elements")
)
def page_elements(spark, sf_dir):
    return _elements(spark, sf_dir).select("page_id", "pos", "tag", "kind", "text")


@REGISTRY.query(
    "page_articles",
    with_ctes(
        ELEMENTS_SQL,
        body=f"SELECT page_id, pos, {_FIRST_INT} AS article_number, text FROM elements WHERE kind = 'article'",
    ),
)
def page_articles(spark, sf_dir):
    return _articles(spark, sf_dir).select("page_id", "pos", "article_number", "text")


@REGISTRY.query(
    "page_context",
    with_ctes(ELEMENTS_SQL, CONTEXT_SQL, body="SELECT page_id, pos, kind, title_name FROM context"),
)
def page_context(spark, sf_dir):
    filled = fill_hierarchy(_elements(spark, sf_dir))
    return filled.select("page_id", "pos", "kind", "title_name")


@REGISTRY.query(
    "page_confidence",
    with_ctes(
        ELEMENTS_SQL,
        CONTEXT_SQL,
        body="""SELECT page_id, count(*) AS n_articles,
  round(0.5 + CASE WHEN bool_or(title_name IS NOT NULL) THEN 0.2 ELSE 0.0 END
        + CASE WHEN avg(length(text)) > 50 THEN 0.2 ELSE 0.0 END + 0.1, 2)::DOUBLE AS confidence
FROM context WHERE kind = 'article' GROUP BY page_id""",
    ),
)
def page_confidence(spark, sf_dir):
    scored = confidence_score(_articles(spark, sf_dir), group="page_id", structure=("title_name",), metadata=("act_type",))
    return scored.select("page_id", "n_articles", "confidence")


@REGISTRY.query(
    "page_statistics",
    with_ctes(
        ELEMENTS_SQL,
        CONTEXT_SQL,
        body="""SELECT page_id, count(*) AS n_articles, count(*) FILTER (WHERE length(text) > 10) AS n_with_content,
  CAST(sum(length(text)) AS BIGINT) AS n_chars, round(avg(length(text)), 4) AS mean_chars,
  count(DISTINCT title_name) AS n_chapters
FROM context WHERE kind = 'article' GROUP BY page_id""",
    ),
)
def page_statistics(spark, sf_dir):
    stats = document_statistics(_articles(spark, sf_dir), group="page_id", chapter="title_name", section="section_name")
    return stats.drop("n_sections")


_DROPPED = (
    r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<nav\b[^>]*>.*?</nav\s*>|"
    r"<header\b[^>]*>.*?</header\s*>|<footer\b[^>]*>.*?</footer\s*>|<!--.*?-->|<![^>]*>"
)


@REGISTRY.query(
    "page_plain_text",
    rf"""WITH body AS (
  SELECT page_id, regexp_extract(regexp_replace(html, '{_DROPPED}', '', 'g'), '(?is)<body[\s>].*', 0) AS markup FROM pages)
SELECT page_id, CASE WHEN length(text) > 500 THEN text END AS text, CASE WHEN length(text) > 500 THEN NULL ELSE 'no more than 500 characters' END AS problem
FROM (SELECT page_id, {_text_sql('markup', 'chr(10)')} AS text FROM body)""",
)
def page_plain_text(spark, sf_dir):
    # these pages have no content container, so the body is what is taken;
    # exploded, so that the column below does not make Spark extract each text twice
    text = pages(spark, sf_dir).select("page_id", F.explode(F.array(plain_text("html"))).alias("text"))
    return text.withColumn("problem", F.when(F.col("text").isNull(), "no more than 500 characters"))


@REGISTRY.query(
    "content_type",
    """SELECT page_id AS id, 'page' AS origin, CASE WHEN starts_with(lower(trim(html)), '<!doctype') OR starts_with(lower(trim(html)), '<html')
    OR (contains(lower(html), '<div') AND contains(lower(html), 'class=')) THEN 'html' ELSE 'text' END AS content_type FROM pages
UNION ALL
SELECT doc_id, 'document', CASE WHEN starts_with(lower(trim(text)), '<!doctype') OR starts_with(lower(trim(text)), '<html')
    OR (contains(lower(text), '<div') AND contains(lower(text), 'class=')) THEN 'html' ELSE 'text' END FROM documents""",
)
def content_type(spark, sf_dir):
    from_pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.lit("page").alias("origin"), detect_content_type("html").alias("content_type")
    )
    from_documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.lit("document").alias("origin"), detect_content_type("text").alias("content_type")
    )
    return from_pages.unionByName(from_documents)


@REGISTRY.query(
    "usable_pages",
    """SELECT page_id, url, CASE WHEN html IS NULL THEN 'no response' WHEN length(html) < 100 THEN 'shorter than 100 characters' END AS problem FROM (
  SELECT page_id, url, CASE page_id % 10 WHEN 0 THEN left(html, 99) WHEN 1 THEN left(html, 100) WHEN 2 THEN NULL ELSE html END AS html FROM pages)""",
)
def usable(spark, sf_dir):
    """All responses, cut or lost for some pages, with what is wrong with them."""
    key = F.col("page_id") % 10
    response = F.when(key == 0, F.left("html", F.lit(99))).when(key == 1, F.left("html", F.lit(100))).when(key != 2, F.col("html"))
    rows = table(spark, sf_dir, "pages").withColumn("html", response)
    return rows.select("page_id", "url", page_problem().alias("problem"))


# class-marked act pages made of the lines of documents: titles, chapters, sections and articles with nested bodies
_ACT_LINES_SQL = f"""units AS (SELECT act_id AS page_id, ordinal AS o, (ordinal - 1) // 12 AS j, (ordinal - 1) % 12 AS r, {strip_sql('text')} AS t FROM articles),
context AS (SELECT page_id, o, j, r, t, CAST(j + 1 AS INTEGER) AS title_nr,
  (SELECT arg_max(h.t, h.o) FROM units h WHERE h.page_id = u.page_id AND h.r = 0 AND h.t <> '' AND h.o < u.o) AS title_name,
  CASE WHEN r > 3 THEN CAST(j + 1 AS INTEGER) END AS chapter_nr, CASE WHEN r > 3 THEN (SELECT NULLIF(max(h.t), '') FROM units h WHERE h.page_id = u.page_id AND h.j = u.j AND h.r = 3) END AS chapter_name,
  CASE WHEN r > 6 THEN CAST(j + 1 AS INTEGER) END AS section_nr, CASE WHEN r > 6 THEN (SELECT NULLIF(max(h.t), '') FROM units h WHERE h.page_id = u.page_id AND h.j = u.j AND h.r = 6) END AS section_name
  FROM units u WHERE r NOT IN (0, 3, 6)),
bodies AS (SELECT *, CASE o % 5 WHEN 0 THEN t || 'end' WHEN 1 THEN '(1)...' || t || 'a)alpha1.oneomegaclosing' WHEN 2 THEN '(1)...' || t || '...(2)...second' WHEN 3 THEN t || '1.onetail' ELSE 'a)...' || t || '...b)...second' END AS body FROM context)"""


def _span(name: str, *parts) -> Column:
    return F.concat(F.lit(f'<span class="{name}">'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("</span>"))


def _act_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document, one element for each of its lines; stray text and unmarked elements stand between them."""
    o, text = F.col("ordinal"), F.col("text")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    turn, number = (o - 1) % 12, F.floor((o - 1) / 12).cast("int") + 1
    plain = F.concat(text, F.lit(" <b>end</b>"))
    points = _span("S_PCT", _span("S_PCT_TTL", "1."), _span("S_PCT_BDY", "one"))
    letters = _span("S_LIT", _span("S_LIT_TTL", "a)"), _span("S_LIT_BDY", "alpha", points, "<i> omega</i>"))
    second = lambda name, label: _span(name, _span(f"{name}_TTL", label), _span(f"{name}_BDY", "second"))
    first = lambda name, label, *inner: _span(name, _span(f"{name}_TTL", label), _span(f"{name}_BDY", text, *inner))
    body = (
        F.when(o % 5 == 0, plain)
        .when(o % 5 == 1, F.concat(first("S_ALN", "(1)", letters, " closing "), F.lit("<em>stray</em>")))
        .when(o % 5 == 2, F.concat(first("S_ALN", "(1)"), F.lit(" stray "), second("S_ALN", "(2)")))
        .when(o % 5 == 3, _span("S_PAR", text, points, "<u>tail</u>"))
        .otherwise(F.concat(first("S_LIT", "a)"), second("S_LIT", "b)"), F.lit("stray")))
    )
    label = lambda name: F.concat(F.lit(f"{name} "), int_to_roman(number))
    unit = (
        F.when(turn == 0, _span("S_TTL", _span("S_TTL_TTL", label("Titlul")), " stray ", _span("S_TTL_DEN", text)))
        .when(turn == 3, F.concat(_span("S_CAP_TTL", label("Capitolul")), F.lit("stray"), _span("S_CAP_DEN", text), F.lit("<br> stray")))
        .when(turn == 6, F.concat(_span("S_SEC_TTL", F.concat(F.lit("Secțiunea "), number.cast("string"))), _span("S_SEC_DEN", text)))
        .otherwise(_span("S_ART", _span("S_ART_TTL", F.concat(F.lit("Articolul "), o.cast("string"))), "<p>stray</p>", _span("S_ART_BDY", body), "after the body <b>7</b>"))
    )
    lines = doc_lines(spark, sf_dir).groupBy("act_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", unit.alias("unit")))).alias("units"))
    joined = F.array_join(F.transform("units", lambda u: u["unit"]), "\n")
    return lines.select(F.col("act_id").alias("page_id"), F.concat(F.lit("<!DOCTYPE html><html><body>"), joined, F.lit("</body></html>")).alias("html"))


_ACT_BASE = (DOC_LINES_SQL, _ACT_LINES_SQL)
_CONTEXT_COLUMNS = ("title_nr", "title_name", "chapter_nr", "chapter_name", "section_nr", "section_name")


@REGISTRY.query("act_page_context", with_ctes(*_ACT_BASE, body=f"SELECT page_id, CAST(o AS INTEGER) AS article_number, {', '.join(_CONTEXT_COLUMNS)} FROM context"))
def act_page_context(spark, sf_dir):
    """Articles with a number and the title, chapter and section in force, of class-marked pages."""
    elements = html_elements(_act_pages(spark, sf_dir), nested=True)
    return article_rows(elements).select("page_id", "article_number", *_CONTEXT_COLUMNS)


@REGISTRY.query("act_page_bodies", with_ctes(*_ACT_BASE, body="SELECT page_id, CAST(o AS INTEGER) AS article_number, body FROM bodies"))
def act_page_bodies(spark, sf_dir):
    """Bodies with points in letters in paragraphs: each text belongs to the element that is open around it."""
    # both sides read them, and parsing is by far the largest part of the work
    elements = stored(html_elements(_act_pages(spark, sf_dir), nested=True), "elements")
    bodies = article_bodies(elements, markdown=False).withColumnRenamed("article_pos", "pos")
    return article_rows(elements).join(bodies, ["page_id", "pos"]).select("page_id", "article_number", "body")


def _parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Act pages, some of which are no HTML and some of which hold no article."""
    rows = _act_pages(spark, sf_dir)
    kind = F.col("page_id") % 7
    return rows.withColumn("html", F.when(kind == 0, F.lit("only text")).when(kind == 1, F.lit("<html><body><p>nothing</p></body></html>")).otherwise(F.col("html")))


@REGISTRY.query(
    "act_page_articles",
    with_ctes(
        *_ACT_BASE,
        body=f"""SELECT page_id, 'Articolul ' || CAST(o AS VARCHAR) AS article_label, CAST(o AS INTEGER) AS article_number, {strip_sql('body')} AS text, {', '.join(_CONTEXT_COLUMNS)}
FROM bodies WHERE page_id % 7 > 1 AND length({strip_sql('body')}) > 5""",
    ),
)
def act_page_articles(spark, sf_dir):
    """The articles that parsing whole pages gives."""
    articles = parse_pages(_parsed_pages(spark, sf_dir))["articles"]
    return articles.select("page_id", "article_label", "article_number", "text", *_CONTEXT_COLUMNS)


@REGISTRY.query(
    "parse_errors",
    with_ctes(
        *_ACT_BASE,
        body=f"""SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'not HTML' ELSE 'no articles found' END AS error FROM (SELECT DISTINCT page_id FROM units) p
WHERE page_id % 7 < 2 OR NOT EXISTS (SELECT 1 FROM bodies b WHERE b.page_id = p.page_id AND length({strip_sql('body')}) > 5)""",
    ),
)
def parse_errors(spark, sf_dir):
    """Pages that yield no article, with the reason."""
    return parse_pages(_parsed_pages(spark, sf_dir))["errors"].select("page_id", "error")


# addresses of the pages, given the forms document addresses have
_FORMS_SQL = """forms AS (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://acts.example.org/Public/DetaliiDocument/' || CAST(page_id AS VARCHAR)
     WHEN 1 THEN 'http://acts.example.org/Public/FormaConsolidata/' || CAST(page_id AS VARCHAR) || 'AB'
     WHEN 2 THEN 'https://acts.example.org/Public/FormaPrintabila/X' || CAST(page_id AS VARCHAR)
     WHEN 3 THEN 'ftp://acts.example.org/DetaliiDocument/' || CAST(page_id AS VARCHAR) ELSE url END AS url
  FROM pages)"""


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, number = F.col("page_id"), F.col("page_id").cast("string")
    url = (
        F.when(key % 5 == 0, F.concat(F.lit("https://acts.example.org/Public/DetaliiDocument/"), number))
        .when(key % 5 == 1, F.concat(F.lit("http://acts.example.org/Public/FormaConsolidata/"), number, F.lit("AB")))
        .when(key % 5 == 2, F.concat(F.lit("https://acts.example.org/Public/FormaPrintabila/X"), number))
        .when(key % 5 == 3, F.concat(F.lit("ftp://acts.example.org/DetaliiDocument/"), number))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


@REGISTRY.query(
    "url_validate",
    with_ctes(
        _FORMS_SQL,
        body="""SELECT page_id, url, contains(regexp_extract(url, '^(?i:https?)://([^/?#]*)', 1), 'example.org') AS is_valid,
  CASE WHEN contains(url, 'FormaConsolidata') THEN url
       WHEN regexp_matches(url, 'DetaliiDocument/[0-9]+') THEN 'https://acts.example.org/Public/FormaConsolidata/' || regexp_extract(url, 'DetaliiDocument/([0-9]+)', 1)
       ELSE url END AS canonical,
  CASE WHEN regexp_matches(url, '(DetaliiDocument|FormaConsolidata)/[0-9]+') THEN regexp_extract(url, '(?:DetaliiDocument|FormaConsolidata)/([0-9]+)', 1)
       ELSE sha256(url) END AS document_id
FROM forms""",
    ),
)
def url_validate(spark, sf_dir):
    return _forms(spark, sf_dir).select(
        "page_id",
        "url",
        is_valid_source_url("url", "example.org").alias("is_valid"),
        canonical_doc_url("url", "https://acts.example.org/Public").alias("canonical"),
        document_id("url").alias("document_id"),
    )


@REGISTRY.query(
    "url_candidates",
    with_ctes(
        _FORMS_SQL,
        """ids AS (SELECT *, NULLIF(regexp_extract(url, '(?:DetaliiDocument|FormaConsolidata)/([A-Z0-9]+)', 1), '') AS doc FROM forms)""",
        """lists AS (SELECT page_id, CASE WHEN doc IS NOT NULL AND NOT contains(url, 'FormaPrintabila') THEN
    ['https://acts.example.org/Public/FormaPrintabila/' || doc, 'https://acts.example.org/Public/FormaConsolidata/' || doc, url] ELSE [url] END AS urls FROM ids)""",
        body="SELECT page_id, CAST(generate_subscripts(urls, 1) AS INTEGER) AS attempt, unnest(urls) AS url FROM lists",
    ),
)
def url_candidates(spark, sf_dir):
    urls = candidate_urls("url", "https://acts.example.org/Public")
    rows = _forms(spark, sf_dir).select("page_id", F.posexplode(urls).alias("at", "url"))
    return rows.select("page_id", (F.col("at") + 1).alias("attempt"), "url")
