from pages_data import ACT, MALFORMED

from actlake.operators.html import (
    GENERIC_PAGES,
    article_bodies,
    article_rows,
    decode_entities,
    detect_content_type,
    html_elements,
    plain_text,
)
from actlake.operators.quality import check_documents
from actlake.operators.render import assemble, render_rows
from actlake.plans.parse import parse_pages
from actlake.registry import all_queries


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls, 1)), "page_id long, html string")


def test_content_type(spark):
    df = spark.createDataFrame([("  <!DOCTYPE html>",), ("<HTML>",), ("x <div class='a'>",), ("<div>",), ("",)], "t string")
    assert [r.x for r in df.select(detect_content_type("t").alias("x")).collect()] == ["html", "html", "html", "text", "text"]


def test_entities(spark):
    df = spark.createDataFrame([("a &amp;lt; &lt;b&gt; &#536;&#x219; &eacute; &nope; &amp &#0;",)], "t string")
    assert df.select(decode_entities("t")).first()[0] == "a &lt; <b> Șș é &nope; &amp &#0;"


def test_malformed_page(spark):
    rows = html_elements(pages(spark, MALFORMED), selector=GENERIC_PAGES).orderBy("pos").collect()
    assert [(r.tag, r.kind, r.text) for r in rows] == [
        ("h1", "title", "Head <one>"),
        ("p", "article", "Firstpara"),
        ("p", "article", "Second 1 < 2 éșline"),
        ("li", "item", "item"),
    ]


def test_hierarchy_resets(spark):
    rows = article_rows(html_elements(pages(spark, ACT))).orderBy("pos").collect()
    got = [(r.article_number, r.title_nr, r.title_name, r.chapter_nr, r.chapter_name, r.section_nr) for r in rows]
    name = "General & apa ă"
    assert got[:3] == [(1, 1, name, 2, "Scop", None), (2, 1, name, 2, "Scop", 1), (3, 1, name, 2, "Scop", 1)]
    # a new title clears chapter and section, its predecessor's name stays
    assert got[3] == (5, 2, name, None, None, None)


def test_article_bodies(spark):
    elements = html_elements(pages(spark, ACT), nested=True)
    rows = article_bodies(elements).orderBy("article_pos").collect()
    assert rows[0].body == "(1)...Se aplicălaalin.a)unu;b)doi...(2)...Al doilea alineat"
    assert rows[0].markdown == "**(1)**\n\nSe aplică la alin.\n\n  **a)** unu;\n  **b)** doi\n\n**(2)**\n\nAl doilea alineat\n"
    assert rows[2].body == "a)...prima literă;...b)...a doua literă"
    assert rows[3].body == "Text directîngroșat"
    assert rows[4].markdown == "Introducere\n\n1. primul punct"


def test_parse_pages(spark):
    out = parse_pages(pages(spark, ACT, "only text", "<html><p>nothing</p></html>", ""))
    articles = out["articles"].orderBy("ordinal").collect()
    # the longest of the two articles 5 stays, article 6 is too short
    assert [(r.article_label, r.article_number) for r in articles] == [
        ("Articolul 1", 1), ("Articolul 2", 2), ("Articolul 3", 3), ("Articolul 5", 5),
    ]
    act = out["acts"].first()
    assert (act.act_type, act.act_number, act.act_date, act.act_year, act.issuer) == ("LEGE", 121, "30/04/2024", 2024, "Parlamentul")
    assert (act.n_missing, act.n_duplicated, act.n_issues, act.quality_score) == (1, 0, 1, 0.85)
    assert act.confidence == 0.8  # mean text length is under 50
    errors = {r.page_id: r.error for r in out["errors"].collect()}
    assert errors == {2: "not HTML", 3: "no articles found", 4: "not HTML"}


def test_rendered_page_passes_rules(spark):
    document = assemble(parse_pages(pages(spark, ACT))["blocks"], key="page_id")
    content = document.first().content
    assert content.startswith("---\ntip_act: LEGE\nnr_act: 121\ndata_act: 30/04/2024\nan_act: 2024\nemitent_act: Parlamentul\n")
    assert "total_articole: 6" in content
    assert "### Titlul I\n#### Capitolul II - Scop\n- [Articolul 1](#articolul-1)\n##### Secțiunea 1\n" in content
    failed = check_documents(document, file="page_id").where("NOT passed").select("rule").collect()
    assert [r.rule for r in failed] == ["no_extra_newlines"]


def test_render_from_rows_prints_headings_once(spark):
    articles = parse_pages(pages(spark, ACT))["articles"].withColumnRenamed("page_id", "act_id")
    for chunk in (1, 1000):
        blocks = render_rows(articles, chunk=chunk)
        content = assemble(blocks, key="act_id").first().content
        assert content.count("### CAPITOLUL II - Scop") == 1
        assert content.count("## TITLUL I - General") == 1
        assert content.count('<a id="art-') == 4
    parts = assemble(blocks, key="act_id", part_size=20).orderBy("part").collect()
    assert len(parts) > 4 and "\n".join(r.content for r in parts) == content


def test_plain_text(spark):
    long = "<p>" + "cuvânt " * 200 + "</p>"
    htmls = [
        f"<body><nav>menu</nav><div id='content'>{long}</div><footer>f</footer></body>",
        f"<body><main>{long}</main><div>other</div></body>",
        "<body>short</body>",
        long,
    ]
    rows = pages(spark, *htmls).select("page_id", plain_text("html").alias("t")).orderBy("page_id").collect()
    assert [r.t is None for r in rows] == [False, False, True, False]
    assert "menu" not in rows[0].t and "other" not in rows[1].t


def test_elements_reuse_the_partitioning_of_pages(spark):
    stored = pages(spark, ACT).repartition(4, "page_id")
    plan = article_rows(html_elements(stored))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_separator(spark):
    rows = html_elements(pages(spark, "<p>a<b>b</b></p>"), selector=GENERIC_PAGES, separator=" ").collect()
    assert rows[0].text == "a b"


def test_bodies_without_markdown(spark):
    elements = html_elements(pages(spark, ACT), nested=True)
    want = [tuple(r)[:3] for r in article_bodies(elements).orderBy("article_pos").collect()]
    assert want and [tuple(r) for r in article_bodies(elements, markdown=False).orderBy("article_pos").collect()] == want


def test_only_headings_and_articles_are_put_in_order(spark):
    plan = article_rows(html_elements(pages(spark, ACT), nested=True))._jdf.queryExecution().executedPlan().toString()
    sort = plan.index("Sort [")
    assert "Window" in plan[:sort] and "article" in plan[sort:].partition("Generate")[0]  # the filter stands below the sort


def test_bodies_are_made_of_elements_written_once(spark, tmp_path):
    spark.createDataFrame([(1, "title\nfirst line\nsecond line")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = all_queries()["act_page_bodies"].run(spark, str(tmp_path))
    assert [tuple(r) for r in found.orderBy("article_number").collect()] == [(1, 2, "(1)...first line...(2)...second"), (1, 3, "second line1.onetail")]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
