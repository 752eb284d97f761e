import datetime

import pytest
from pyspark.sql import functions as F

from actlake.functions import text as t
from actlake.functions.labels import act_name, article_name, hierarchy_path
from actlake.functions.metadata import consolidated_metadata, full_metadata, merge_metadata
from actlake.functions.urls import candidate_urls, canonical_doc_url, document_id, is_valid_source_url


def apply(spark, values, function):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r.x for r in df.select(function(F.col("t")).alias("x")).collect()]


def test_roman_numbers(spark):
    values = ["I", "IV", "IX", "XL", "MCMXCIV", "IIII", "", "Titlul XII nume", "abc", "VX", "xiv", "ĂIV"]
    assert apply(spark, values, t.roman_to_int) == [1, 4, 9, 40, 1994, 4, None, 12, None, 5, None, None]
    df = spark.createDataFrame([(0,), (None,), (4,), (1994,), (-3,), (3999,), (12345,)], "n int")
    got = [r.x for r in df.select(t.int_to_roman("n").alias("x")).collect()]
    assert got == ["", "", "IV", "MCMXCIV", "", "MMMCMXCIX", "MMMMMMMMMMMMCCCXLV"]


def test_roman_round_trip(spark):
    df = spark.range(1, 4000).select(F.col("id").cast("int").alias("n"))
    wrong = df.where(t.roman_to_int(t.int_to_roman("n")) != F.col("n"))
    assert wrong.count() == 0


def test_first_int_and_year(spark):
    assert apply(spark, ["art. 12 alin. 3", "a12", "é12 7", "", "99999999999"], t.first_int) == [12, None, 7, None, None]
    assert apply(spark, ["30/04/2024", "2024", "1899", "12345", "din 2101 x", None], t.year_of) == [2024, 2024, None, None, None, None]


def test_typed_parsing(spark):
    assert apply(spark, ["3.7", "I", " 12 ", "", "-2.9", "1e3", "1d", "99999999999"], t.parse_int) == [3, None, 12, None, -2, 1000, None, None]
    assert apply(spark, ["0.85", "x", "1."], t.parse_float) == [0.85, None, 1.0]
    day = datetime.date(2024, 4, 30)
    assert apply(spark, ["30/04/2024", "2024-04-30", "30/4/2024", "31/02/2024", "30.04.2024", " "], t.parse_date) == [day, day, day, None, None, None]


def test_months_and_labels(spark):
    assert apply(spark, ["Aprilie", "MAI", "brumar"], t.month_number) == [4, 5, None]
    assert apply(spark, ["Articolul 5 - Definiții", "Anexa 1"], t.clean_label) == ["Articolul 5", "Anexa 1"]
    got = apply(spark, ["Articolul 5 Text aici", "Alt text"], lambda c: t.strip_label_prefix(c, F.lit("Articolul 5")))
    assert got == ["Text aici", "Alt text"]


def test_normalize_references(spark):
    values = ["laalin. (1)", "lalit. a)", "lacap. II", "prevederilorart. 10", "(1)se", "a)șib)", "lasecț. 2", "art. 5", "partea"]
    assert apply(spark, values, t.normalize_references) == [
        "la alin. (1)", "la lit. a)", "la cap. II", "prevederilor art. 10", "(1) se", "a) și b)", "la secț. 2", "art. 5", "partea",
    ]


def test_format_letters(spark):
    values = [
        "conform lit. d);...text",
        "conform lit. a);...text",
        "Se aprobă a) unu;...b) doi;...c)trei",
        "Intro;...a) unu;...și restul;...;",
        "fără listă a) b)",
    ]
    assert apply(spark, values, t.format_letters) == [
        "conform lit. d);...text",
        "conform lit. a);...text",
        "Se aprobă:\n  **a)** unu\n  **b)** doi\n  **c)** trei",
        "Intro:\n  **a)** unu\n\nși restul",
        "fără listă a) b)",
    ]


def test_format_paragraphs(spark):
    values = ["(1) Primul. (2) Al doilea cu lit. (3) mic", "(1) Lista a) x;...b) y", "(1)fără spațiu", ""]
    assert apply(spark, values, t.format_paragraphs) == [
        "**(1)**\nPrimul.\n\n**(2)**\nAl doilea cu lit. (3) mic",
        "**(1)**\nLista:\n  **a)** x\n  **b)** y",
        "(1)fără spațiu",
        "",
    ]


def test_relevance(spark):
    df = spark.createDataFrame([("Codul codului cod", "cod fiscal", None), ("cod " * 200, None, "COD"), (None, None, "x")], "a string, b string, c string")
    assert [r.x for r in df.select(t.relevance("a", "b", "c", "Cod").alias("x")).collect()] == [8.0, 100.0, 0.0]


def test_file_names(spark):
    names = ["LEGE_123_2024_20251107_211711.csv", "notes.csv", "A_20251399_000000.md"]
    got = apply(spark, names, t.parse_result_filename)
    assert (got[0].act, got[0].kind, got[0].ts) == ("LEGE_123_2024", "csv", datetime.datetime(2025, 11, 7, 21, 17, 11))
    assert got[1].act is None and got[2].ts is None and got[2].act is None
    df = spark.createDataFrame([("ORDONANȚĂ DE URGENȚĂ", "5", 2020), (None, "1", 2020), ("LEGE", None, 0)], "k string, n string, y int")
    assert [r.x for r in df.select(t.result_file_key("k", "n", "y").alias("x")).collect()] == ["ORDONANTA_DE_URGENTA_5_2020", "act_legislativ", "LEGE"]


def test_urls(spark):
    base = "https://acts.example.org/Public"
    urls = [f"{base}/DetaliiDocument/12", f"{base}/FormaConsolidata/9", "ftp://acts.example.org/x", "not a url", "https://other.net/acts.example.org", None]
    assert apply(spark, urls, lambda c: is_valid_source_url(c, "acts.example.org")) == [True, True, False, False, False, False]
    assert apply(spark, urls[:2], lambda c: canonical_doc_url(c, base)) == [f"{base}/FormaConsolidata/12", urls[1]]
    assert apply(spark, urls[:1], lambda c: candidate_urls(c, base)) == [[f"{base}/FormaPrintabila/12", f"{base}/FormaConsolidata/12", urls[0]]]
    ids = apply(spark, urls[:4], document_id)
    assert ids[:2] == ["12", "9"] and len(ids[3]) == 64


@pytest.mark.parametrize(
    "designation, kind, number, date, approximate",
    [
        ("LEGE nr. 123 din 30 aprilie 2024", "LEGE", 123, "30/04/2024", False),
        ("lege nr. 123/2024", "LEGE", 123, "01/01/2024", True),
        ("METODOLOGIE din 9 iulie 2025", "METODOLOGIE", None, "09/07/2025", False),
        ("ORDONANŢĂ DE URGENŢĂ nr. 5 din 1 mai 2020", "ORDONANȚĂ DE URGENȚĂ", 5, "01/05/2020", False),
        ("LEGE nr. 1 din 30 brumar 2024", "LEGE", 1, None, False),
        ("Comunicat", None, None, None, False),
    ],
)
def test_full_metadata(spark, designation, kind, number, date, approximate):
    m = apply(spark, [designation], lambda c: full_metadata(c, F.lit("h"), F.lit("i"), F.lit("Monitorul Oficial nr. 7 din 2 mai 2024")))[0]
    assert (m.act_type, m.act_number, m.act_date, m.date_is_approximate) == (kind, number, date, approximate)
    assert (m.gazette_nr, m.gazette_date, m.gazette_year) == (7, "02/05/2024", 2024)


def test_consolidated_metadata(spark):
    none = F.lit(None).cast("string")
    texts = ["LEGE nr. 7 din 31 februarie 2020", "PARLAMENTUL ROMÂNIEI LEGE nr. 8/2021 privind apa"]
    gazette = F.lit("MONITORUL OFICIAL AL ROMÂNIEI, PARTEA I, nr. 4 din 2 mai 2024")
    a, b = apply(spark, texts, lambda c: consolidated_metadata(c, none, none, gazette))
    assert (a.act_type, a.act_number, a.act_date, a.act_year) == ("LEGE", "7", None, None)
    assert (b.act_number, b.act_year, b.title, b.issuer) == ("8", 2021, "apa", "Parlamentul României")
    assert (a.gazette.nr, a.gazette.date, a.gazette.year) == ("4", datetime.date(2024, 5, 2), 2024)


def test_merge_metadata(spark):
    df = spark.createDataFrame([("LEGE", 1, "DECRET", 0), ("LEGE", 1, "", 5), ("LEGE", 1, None, None)], "a string, n int, b string, m int")
    rows = df.select(*merge_metadata({"a": "a", "n": "n"}, {"a": F.col("b"), "n": F.col("m")})).collect()
    assert [tuple(r) for r in rows] == [("DECRET", 1), ("LEGE", 5), ("LEGE", 1)]


def test_labels(spark):
    df = spark.createDataFrame([("LEGE", "5", 2020, None, 3), ("LEGE", None, 0, "Articolul 2", 0)], "k string, n string, y int, l string, o int")
    rows = df.select(act_name("k", "n", "y").alias("a"), article_name("l", "n", "o", F.lit(9)).alias("r"), hierarchy_path("o", F.lit(None).cast("int"), "y", F.lit(0)).alias("p")).collect()
    assert [tuple(r) for r in rows] == [("LEGE nr. 5 din 2020", "Articolul 5", "Titlul 3 > Sect. 2020"), ("LEGE", "Articolul 2", "N/A")]
