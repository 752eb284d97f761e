import random

import pytest
from pyspark.sql import functions as F

from actlake.operators import quality as q
from actlake.operators.quality_parts import check_parts, cut_parts
from actlake.sources.readers import read_markdown_parts
from actlake.sources.sinks import write_markdown

GOOD = (
    "---\ntip_act: LEGE\ndata_act: 1\ntotal_articole: 1\n---\n\n## INDEX\n\n### Titlul I\n- [Articolul 1](#articolul-1)\n\n"
    "## ARTICOLE\n\n### Articolul 1\n\n**Context ierarhic:**\n\n**(1)**\n\ntext conform alin. (2)\n  **a)** unu\n"
)
BAD = {
    "has_metadata_header": GOOD[4:],
    "has_index": GOOD.replace("## INDEX", "INDEX"),
    "has_articles": GOOD.replace("## ARTICOLE", ""),
    "no_unformatted_paragraphs": GOOD + "\nun text (3) liber",
    "letters_indented": GOOD + "\n**b)** doi",
    "references_not_bold": GOOD + "\n**lit. a)**",
    "index_links_valid": GOOD.replace("(#articolul-1)", "(#Articolul_1)"),
    "index_links_working": GOOD.replace("[Articolul 1]", "[Articolul 9]"),
    "metadata_complete": GOOD.replace("data_act: 1\n", ""),
    "articles_have_context": GOOD.replace("**Context ierarhic:**", ""),
    "no_extra_spaces": GOOD + "a   b",
    "no_extra_newlines": GOOD + "\n\n\na",
}


def test_document_rules(spark):
    df = spark.createDataFrame([("good", GOOD)] + list(BAD.items()), "file string, content string")
    results = q.check_documents(df).collect()
    assert len(results) == (1 + len(BAD)) * len(q.DOCUMENT_RULES)
    failed = {}
    for r in results:
        if not r.passed:
            failed.setdefault(r.file, set()).add(r.rule)
    assert "good" not in failed
    for rule in BAD:
        assert rule in failed[rule], rule


def test_index_without_links_fails(spark):
    df = spark.createDataFrame([("a", "## INDEX\n\nnothing\n## ARTICOLE\n[x](#y)")], "file string, content string")
    rows = {r.rule: r for r in q.check_documents(df).collect()}
    assert not rows["index_links_valid"].passed and rows["index_links_valid"].detail == "the index holds no links"


def test_rules_are_data(spark):
    own = q.Rule("no_todo", "warning", lambda c: q.outcome(~c.contains("TODO"), "todo left"))
    off = q.Rule("has_index", "error", q.has_index, enabled=False)
    df = spark.createDataFrame([("a", "TODO")], "file string, content string")
    assert [(r.rule, r.passed) for r in q.check_documents(df, rules=(own, off)).collect()] == [("no_todo", False)]


ROWS = [("f", 1, "articol", "text", 1, "A", "I"), ("f", 2, "articol", "text", 2, "A", None)]
SCHEMA = "file string, ordinal int, element_kind string, text string, article_number int, act_type string, chapter_name string"


@pytest.mark.parametrize(
    "rule, rows",
    [
        ("no_empty_articles", ROWS + [("f", 3, "articol", "", 3, "A", "I")]),
        ("articles_have_numbers", ROWS + [("f", 3, "articol", "x", None, "A", "I")]),
        ("metadata_consistent", ROWS + [("f", 3, "articol", "x", 3, "B", "I")]),
        ("article_numbers_sequential", ROWS + [("f", 3, "articol", "x", 1, "A", "I")]),
        ("has_hierarchy", [r[:6] + (None,) for r in ROWS]),
    ],
)
def test_article_rules(spark, rule, rows):
    labels = {"issue": F.lit(""), "explanation": F.lit("")}
    check = lambda data: {r.rule: r.passed for r in q.check_articles(spark.createDataFrame(data, SCHEMA).withColumns(labels), chunk=1).collect()}
    assert all(check(ROWS).values())
    failed = {name for name, passed in check(rows).items() if not passed}
    assert failed == {rule}


def test_missing_columns(spark):
    rows = {r.rule: r.passed for r in q.check_articles(spark.createDataFrame(ROWS, SCHEMA).drop("element_kind")).collect()}
    assert not rows["has_required_columns"] and not rows["issue_column_exists"] and rows["article_numbers_sequential"]


def test_pairs_and_summary(spark):
    articles = spark.createDataFrame([("a",) + ROWS[0][1:], ("b",) + ROWS[0][1:]], SCHEMA.replace("file", "stem"))
    docs = spark.createDataFrame([("a", GOOD)], "stem string, content string")
    results = q.check_pairs(articles, docs)
    got = {(r.stem, r.file_type): r.n for r in results.groupBy("stem", "file_type").agg(F.count("*").alias("n")).collect()}
    assert got == {("b", "pair"): 1, ("a", "csv"): 8, ("a", "markdown"): 14}
    summary = q.quality_summary(results.where("file_type <> 'pair'").withColumn("file", F.concat("stem", "file_type"))).first()
    assert (summary.n_files, summary.n_checks, summary.n_files_with_errors) == (2, 22, 1)


# what rules look for, so that random texts hold much of it across lines
TOKENS = (
    "[", "]", "](#", "](#a-1)", "](#A_1)", ")", "**lit. ", "a)** ", "**alin.", "(5)** ", "(7) ", "alin. (3)", "\n", "\n", "\n\n", "\n\n\n", "   ",
    "## INDEX", "## ", "### t", "\n### t\n", "\n## ARTICOLE\n", "\n---\n", "tip_act: 1\n", "data_act:", "total_articole:", "\n**b)** x", "[t](#t)\n", "x",
    "### Articolul 1\n", "**Context ierarhic:**",
)


def _made(n, seed):
    chance = random.Random(seed)
    heads = ("", "---\n", "---\ntip_act: x\ndata_act:1\ntotal_articole: 3\n---\n", "---\ntip_act: x\n\n## INDEX\n")
    return [chance.choice(heads) + "".join(chance.choices(TOKENS, k=chance.randrange(40))) for _ in range(n)]


def _rows(results):
    return sorted((r.file, r.rule, r.severity, r.passed, r.detail) for r in results.collect())


@pytest.mark.parametrize("part_chars", [0, 12, 60])
def test_parts_are_judged_as_the_whole(spark, part_chars):
    texts = [GOOD, *BAD.values(), "", "\n", "\n\n\n", *_made(400, part_chars)]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, content string")
    parts = cut_parts(docs, part_chars=part_chars)
    joined = parts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("p"))
    assert {r.file: "".join(p.content for p in r.p) for r in joined.collect()} == {str(i): t for i, t in enumerate(texts)}
    want, got = _rows(q.check_documents(docs)), _rows(check_parts(parts))
    assert len(want) == len(texts) * len(q.DOCUMENT_RULES)
    assert [(texts[int(w[0])], w, g) for w, g in zip(want, got, strict=True) if w != g][:3] == []


def test_parts_with_nulls_and_without_rows(spark):
    rows = [("a", 1, "---\n"), ("a", 2, None), ("a", 3, "---\n## INDEX\n"), ("b", 1, None)]
    parts = spark.createDataFrame(rows, "file string, part int, content string")
    whole = spark.createDataFrame([("a", "---\n---\n## INDEX\n"), ("b", "")], "file string, content string")
    assert _rows(check_parts(parts)) == _rows(q.check_documents(whole))
    assert check_parts(parts.where("part > 9")).count() == 0


def test_parts_written_and_read(spark, tmp_path):
    texts = {"a": "one\ntwo\n\nthree\n", "b": "\n\n", "c d": GOOD}
    docs = spark.createDataFrame(list(texts.items()), "file string, content string")
    parts = cut_parts(docs, part_chars=8).withColumn("block", F.regexp_replace("content", r"\n\z", ""))
    write_markdown(parts.withColumnRenamed("file", "file_key"), str(tmp_path), part="part")
    got = {}
    for r in sorted(read_markdown_parts(spark, str(tmp_path)).collect(), key=lambda r: r.part):
        got[r.stem] = got.get(r.stem, "") + r.content
    assert got == texts
