"""Markdown documents of acts, as blocks in order.

Every operator here yields blocks (key, section, seq, block), one row per piece of
text. `assemble` joins the blocks of an act into one string; a sink can also write the
blocks themselves, which keeps an act of any size out of a single cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_paragraphs, int_to_roman, is_present
from .ordered import CHUNK, with_neighbour

# --- fixed values: placeholders in rendered articles ---
ISSUE_TODO = "**Issue:** *[TODO - adaugă descriere scurtă]*"
EXPLANATION_TODO = "**Explicație:** *[TODO - adaugă explicație în 1-2 fraze, limbaj simplu]*"
NO_CONTENT = "*[Conținut lipsă]*"
INDEX_TODO = "*[Issue: TODO]*"
EMPTY_DOCUMENT = "# Document gol\n\nNu s-au găsit articole."

HEADER, INDEX, MIDDLE, ARTICLE = 0, 1, 2, 3


def _line(*parts) -> Column:
    """Parts joined without separator; NULL (no line) if any part is NULL."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _shown(name: str, missing: str = "None") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(missing))


def _rows(*lines) -> Column:
    """Lines joined by newline, NULL lines left out."""
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


def assemble(blocks: DataFrame, *, key: str, name: str = "content", part_size: int | None = None) -> DataFrame:
    """One string per act from its blocks in order.

    With ``part_size`` an act's string comes in parts of that many ordinals, numbered in
    document order, so that no act has to be gathered whole.
    """
    keys = [key]
    if part_size is not None:
        part = F.col("section").cast("long") * 1_000_000_000 + F.floor(F.col("seq") / part_size)
        blocks = blocks.withColumn("part", part)
        keys.append("part")
    ordered = F.array_sort(F.collect_list(F.struct("section", "seq", "block")))
    joined = blocks.groupBy(*keys).agg(ordered.alias("_blocks"))
    return joined.select(*keys, F.array_join(F.transform("_blocks", lambda b: b["block"]), "\n").alias(name))


# ---------------------------------------------------------------- from page structure


def _structure(elements: DataFrame, key: str) -> DataFrame:
    """Headings and articles of a page with the headings above them, as shown in documents."""
    w = Window.partitionBy(key).orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind, text = F.col("kind"), F.col("text")
    following = F.lead(F.struct("kind", "text")).over(w)
    rows = elements.where(kind.isNotNull() & (text != "")).withColumn("_next", following)
    named = F.when(
        ((kind == "chapter_nr") & (F.col("_next.kind") == "chapter_name"))
        | ((kind == "section_nr") & (F.col("_next.kind") == "section_name")),
        _line(text, " - ", F.col("_next.text")),
    ).otherwise(text)
    rows = rows.withColumn("full", named)
    held = lambda c: F.struct(c.alias("v"))
    none = F.struct(F.lit(None).cast("string").alias("v"))
    title = F.when(kind == "title_nr", held(F.col("full")))
    chapter = F.when(kind == "chapter_nr", held(F.col("full"))).when(kind == "title_nr", none)
    section = F.when(kind == "section_nr", held(F.col("full"))).when(kind.isin("title_nr", "chapter_nr"), none)
    rows = rows.withColumns(
        {
            "in_title": F.last(title, ignorenulls=True).over(so_far)["v"],
            "in_chapter": F.last(chapter, ignorenulls=True).over(so_far)["v"],
            "in_section": F.last(section, ignorenulls=True).over(so_far)["v"],
        }
    )
    rows = rows.where(kind.isin("title_nr", "chapter_nr", "section_nr", "article"))
    number = F.regexp_extract(text, r"(?i)articol(?:ul)?\s+(\d+)", 1)
    return rows.withColumn("number", F.when(kind == "article", F.nullif(number, F.lit(""))))


def render_index(elements: DataFrame, *, key: str = "page_id", issues: DataFrame | None = None) -> DataFrame:
    """Index lines: headings by depth, articles as links, with the issue where ``issues`` has one."""
    rows = _structure(elements, key)
    kind = F.col("kind")
    depth = (
        F.when(kind == "title_nr", 3)
        .when(kind == "chapter_nr", F.when(F.col("in_title").isNotNull(), 4).otherwise(3))
        .when(
            kind == "section_nr",
            F.when(F.col("in_chapter").isNotNull(), 5).when(F.col("in_title").isNotNull(), 4).otherwise(3),
        )
    )
    heading = _line(F.repeat(F.lit("#"), depth), " ", F.col("full"))
    link = _line("- [Articolul ", F.col("number"), "](#articolul-", F.col("number"), ")")
    if issues is not None:
        known = issues.where(is_present("issue")).select(key, F.col("article_number").cast("string").alias("number"), "issue")
        rows = rows.join(known, [key, "number"], "left")
        link = F.concat(link, F.coalesce(F.concat(F.lit(" - "), F.col("issue")), F.lit("")))
    lines = rows.withColumn("block", F.when(kind == "article", link).otherwise(heading))
    return lines.where(F.col("block").isNotNull()).select(
        key, F.lit(INDEX).alias("section"), F.col("pos").cast("long").alias("seq"), "block"
    )


def render_articles(elements: DataFrame, bodies: DataFrame, metadata: DataFrame, *, key: str = "page_id") -> DataFrame:
    """One block per article: context, placeholders, metadata and formatted content.

    ``metadata``: key, act_type, act_number, act_year, title; ``bodies``: key, article_pos, markdown.
    """
    rows = _structure(elements, key).where(F.col("number").isNotNull())
    rows = rows.join(bodies.select(key, F.col("article_pos").alias("pos"), "markdown"), [key, "pos"], "left")
    rows = rows.join(metadata.select(key, "act_type", "act_number", "act_year", "title"), key, "left")
    title, chapter, section = F.col("in_title"), F.col("in_chapter"), F.col("in_section")
    block = _rows(
        _line("### Articolul ", F.col("number")),
        "",
        "**Context ierarhic:**",
        _line("- **Titlu:** ", title),
        _line("- **Capitol:** ", chapter),
        _line("- **Secțiune:** ", section),
        "",
        ISSUE_TODO,
        "",
        EXPLANATION_TODO,
        "",
        "**Metadata:**",
        "```yaml",
        "tip_element: articol",
        _line("nr_articol: ", F.col("number")),
        _line("titlu: ", title),
        _line("capitol: ", chapter),
        _line("sectiune: ", section),
        _line("tip_act: ", _shown("act_type")),
        _line("nr_act: ", _shown("act_number")),
        _line("an_act: ", _shown("act_year", "N/A")),
        _line("titlu_act: ", _shown("title")),
        "```",
        "",
        "**Conținut:**",
        "",
        F.coalesce(F.nullif("markdown", F.lit("")), F.lit(NO_CONTENT)),
        "",
        "---",
        "",
    )
    return rows.select(key, F.lit(ARTICLE).alias("section"), F.col("pos").cast("long").alias("seq"), block.alias("block"))


def render_page_header(metadata: DataFrame, *, key: str = "page_id") -> DataFrame:
    """Front matter and heading lines. ``metadata`` also needs n_articles."""
    gazette = F.when(
        is_present(F.col("gazette_nr").cast("string")) & is_present("gazette_date"),
        _line("**Publicat în:** Monitorul Oficial nr. ", F.col("gazette_nr"), " din ", F.col("gazette_date"), "\n"),
    )
    block = _rows(
        "---",
        _line("tip_act: ", _shown("act_type")),
        _line("nr_act: ", _shown("act_number")),
        _line("data_act: ", _shown("act_date")),
        _line("an_act: ", _shown("act_year", "N/A")),
        _line("emitent_act: ", _shown("issuer")),
        _line("titlu_act: ", _shown("title")),
        _line("mof_nr: ", _shown("gazette_nr")),
        _line("mof_data: ", _shown("gazette_date")),
        _line("mof_an: ", _shown("gazette_year", "N/A")),
        _line("total_articole: ", F.col("n_articles")),
        "---",
        "",
        _line("# ", _shown("act_type"), " nr. ", _shown("act_number"), " din ", _shown("act_date")),
        "",
        F.when(is_present("issuer"), _line("**Emitent:** ", F.col("issuer"), "\n")),
        gazette,
        F.when(is_present("title"), _line("**Titlu:** ", F.col("title"), "\n")),
        "## INDEX",
        "",
    )
    return metadata.select(key, F.lit(HEADER).alias("section"), F.lit(0).cast("long").alias("seq"), block.alias("block"))


def render_pages(
    elements: DataFrame, bodies: DataFrame, metadata: DataFrame, *, key: str = "page_id", issues: DataFrame | None = None
) -> DataFrame:
    """All blocks of the documents of pages."""
    middle = metadata.select(
        key, F.lit(MIDDLE).alias("section"), F.lit(0).cast("long").alias("seq"), F.lit("\n## ARTICOLE\n").alias("block")
    )
    return (
        render_page_header(metadata, key=key)
        .unionByName(render_index(elements, key=key, issues=issues))
        .unionByName(middle)
        .unionByName(render_articles(elements, bodies, metadata, key=key))
    )


# ---------------------------------------------------------------- from article rows


def _level(name: str, number: str, label: str) -> Column:
    """``CAPITOLUL II - name``; the bare name without a number; NULL without a name."""
    roman = int_to_roman(number)
    return F.when(
        is_present(name), F.when(roman != "", _line(f"{label} ", roman, " - ", F.col(name))).otherwise(F.col(name))
    )


def render_rows(articles: DataFrame, *, act: str = "act_id", order: str = "ordinal", chunk: int = CHUNK) -> DataFrame:
    """Blocks of documents from article rows that carry their act's metadata.

    A heading is printed where it differs from the row before. Neighbours come from
    chunks of an act, so a very long act is not one task.
    """
    levels = (
        ("title", "title_name", "title_nr", "TITLUL", "## "),
        ("chapter", "chapter_name", "chapter_nr", "CAPITOLUL", "### "),
        ("section", "section_name", "section_nr", "SECȚIUNEA", "#### "),
        ("subsection", "subsection_name", "subsection_nr", "SUBSECȚIUNEA", "##### "),
    )
    rows = articles
    for short, name, number, label, _ in levels:
        text = _level(name, number, label) if name in articles.columns else F.lit(None).cast("string")
        rows = rows.withColumn(f"_{short}", text)
    rows = rows.withColumn("_path", F.struct(*[F.col(f"_{short}").alias(short) for short, *_ in levels]))
    rows = with_neighbour(rows, group=act, order=order, value="_path", name="_before", chunk=chunk)

    headings, changed = [], F.lit(False)
    for short, _, _, _, marks in levels:
        differs = ~F.col(f"_{short}").eqNullSafe(F.col("_before")[short])
        changed = changed | F.coalesce(differs, F.lit(True))
        headings.append(F.when(changed, _line(marks, F.col(f"_{short}"))))
    number = F.col("article_number").cast("string")
    index = _rows(*headings, F.when(is_present(number), _line("- [Art. ", number, "](#art-", number, ") - " + INDEX_TODO)))
    index_rows = rows.select(
        act, F.lit(INDEX).alias("section"), F.col(order).cast("long").alias("seq"), index.alias("block")
    ).where(F.col("block") != "")

    shown_number = F.when(is_present(number), number).otherwise(F.col(order).cast("string"))
    path = F.concat_ws(" / ", "_title", "_chapter", "_section")
    body = _rows(
        _line('<a id="art-', shown_number, '"></a>'),
        _line("## Art. ", shown_number),
        "",
        F.when(path != "", _line("**Context ierarhic:** ", path, "\n")),
        ISSUE_TODO,
        "",
        EXPLANATION_TODO,
        "",
        "**Metadata:**",
        "```yaml",
        "tip_element: articol",
        F.when(is_present(number), _line("nr_articol: ", number)),
        _line("titlu: ", F.col("_title")),
        _line("capitol: ", F.col("_chapter")),
        _line("sectiune: ", F.col("_section")),
        _line("tip_act: ", _shown("act_type")),
        _line("nr_act: ", _shown("act_number")),
        _line("an_act: ", _shown("act_year")),
        _line("titlu_act: ", _shown("title")),
        "```",
        "",
        "**Conținut:**",
        "",
        F.when(is_present("text"), format_paragraphs("text")).otherwise(NO_CONTENT),
        "",
        "---",
        "",
    )
    article_blocks = rows.select(
        act, F.lit(ARTICLE).alias("section"), F.col(order).cast("long").alias("seq"), body.alias("block")
    )

    fields = ["act_type", "act_number", "act_date", "act_year", "issuer", "title", "gazette_nr", "gazette_date", "gazette_year"]
    have = [c for c in fields if c in articles.columns]
    acts = articles.groupBy(act).agg(F.min_by(F.struct(*have), order).alias("m"), F.count("*").alias("n_articles"))
    acts = acts.select(act, "m.*", "n_articles")
    acts = acts.withColumns({c: F.lit(None).cast("string") for c in fields if c not in have})
    header = _rows(
        "---",
        *[
            _line(f"{label}: ", _shown(name, "N/A"))
            for label, name in (("tip_act", "act_type"), ("nr_act", "act_number"), ("data_act", "act_date"), ("an_act", "act_year"), ("emitent_act", "issuer"))
        ],
        _line('titlu_act: "', _shown("title", "N/A"), '"'),
        *[
            _line(f"{label}: ", _shown(name, "N/A"))
            for label, name in (("mof_nr", "gazette_nr"), ("mof_data", "gazette_date"), ("mof_an", "gazette_year"))
        ],
        _line("total_articole: ", F.col("n_articles")),
        "---",
        "",
        F.when(
            is_present(F.col("act_number").cast("string")),
            _line("# ", _shown("act_type"), " nr. ", F.col("act_number"), " din ", _shown("act_date")),
        ).otherwise(_line("# ", _shown("act_type"), " din ", _shown("act_date"))),
        "",
        F.when(is_present("issuer"), _line("**Emitent:** ", F.col("issuer"))),
        F.when(
            is_present(F.col("gazette_nr").cast("string")),
            _line("**Publicat în:** Monitorul Oficial nr. ", F.col("gazette_nr"), " din ", _shown("gazette_date")),
        ),
        "",
        F.when(is_present("title"), _line("## Titlu Act\n", F.col("title"), "\n")),
        "---",
        "",
        "# INDEX",
        "",
    )
    heads = acts.select(act, F.lit(HEADER).alias("section"), F.lit(0).cast("long").alias("seq"), header.alias("block"))
    middle = acts.select(
        act, F.lit(MIDDLE).alias("section"), F.lit(0).cast("long").alias("seq"), F.lit("\n---\n\n# ARTICOLE\n").alias("block")
    )
    return heads.unionByName(index_rows).unionByName(middle).unionByName(article_blocks)
