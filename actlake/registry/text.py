"""Queries over text and metadata expressions, on whole documents, lines and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metadata import basic_metadata, consolidated_metadata, full_metadata
from ..functions.text import (
    clean_label,
    first_int,
    format_letters,
    format_paragraphs,
    highlight,
    int_to_roman,
    month_number,
    normalize_references,
    parse_date,
    parse_float,
    parse_int,
    parse_result_filename,
    result_file_key,
    roman_to_int,
    strip_label_prefix,
    year_of,
)
from . import Registry
from .bind import DOC_LINES_SQL, doc_lines, documents, spread, strip_sql, table, with_ctes

REGISTRY = Registry()

_WORD = r"[^\p{L}\p{N}_]"


@REGISTRY.query(
    "text_first_int",
    rf"""SELECT doc_id, TRY_CAST(NULLIF(regexp_extract(text, '(?:^|{_WORD})([0-9]+)(?:$|{_WORD})', 1), '') AS INTEGER) AS first_int,
  CASE WHEN y BETWEEN 1900 AND 2100 THEN y END AS year
FROM (SELECT doc_id, text, TRY_CAST(NULLIF(regexp_extract(text, '(?:^|{_WORD})([0-9]{{4}})(?:$|{_WORD})', 1), '') AS INTEGER) AS y FROM documents)""",
)
def text_first_int(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", first_int("text").alias("first_int"), year_of("text").alias("year")
    )


@REGISTRY.query(
    "text_year",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 5 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders""",
)
def text_year(spark, sf_dir):
    """Years out of date strings in the shapes acts use; five digits are no year."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    shape = (
        F.when(key % 6 == 0, F.date_format(date, "dd/MM/yyyy"))
        .when(key % 6 == 1, F.date_format(date, "d MMMM yyyy"))
        .when(key % 6 == 2, F.date_format(date, " yyyy "))
        .when(key % 6 == 3, F.date_format(date, "yyyy-MM-dd"))
        .when(key % 6 == 4, F.concat(F.lit("nr. 12/"), F.date_format(date, "yyyy")))
        .otherwise(F.concat(F.date_format(date, "yyyy"), F.lit("7")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", year_of(shape).alias("year"))


_VALUE_SQL = "CASE {c} WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 END"


@REGISTRY.query(
    "int_to_roman",
    """SELECT o_orderkey, CASE WHEN n <= 0 THEN '' ELSE repeat('M', n // 1000)
  || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][(n // 100) % 10 + 1]
  || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][(n // 10) % 10 + 1]
  || ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1] END AS roman
FROM (SELECT o_orderkey, CAST(o_orderkey % 4000 AS INTEGER) AS n FROM orders)""",
)
def int_to_roman_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", int_to_roman(F.col("o_orderkey") % 4000).alias("roman"))


@REGISTRY.query(
    "roman_to_int",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4000 > 0 THEN CAST(o_orderkey % 4000 AS INTEGER) END AS value FROM orders",
)
def roman_to_int_query(spark, sf_dir):
    numeral = F.concat(F.lit("titlul "), int_to_roman(F.col("o_orderkey") % 4000), F.lit(" - nume"))
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", roman_to_int(numeral).alias("value"))


@REGISTRY.query(
    "roman_in_text",
    rf"""WITH n AS (SELECT doc_id, regexp_extract(text, '(?:^|{_WORD})([IVXLCDM]+)(?:$|{_WORD})', 1) AS s FROM documents),
v AS (SELECT doc_id, [{_VALUE_SQL.format(c="c")} FOR c IN string_split(s, '')] AS d FROM n WHERE s <> '')
SELECT doc_id, CAST(list_sum([CASE WHEN d[i] < coalesce(list_max(d[i + 1:]), 0) THEN -d[i] ELSE d[i] END FOR i IN range(1, len(d) + 1)]) AS INTEGER) AS value FROM v""",
)
def roman_in_text(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.explode(F.array(roman_to_int("text"))).alias("value"))
    return rows.where(F.col("value").isNotNull())


def _glue_sql(text: str) -> str:
    return f"replace(replace(replace(replace({text}, ' la ', ' laalin. '), ' de ', ' deart. '), ' and ', ')and '), ' the ', ' lab) ')"


@REGISTRY.query(
    "normalize_references",
    rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_glue_sql('text')},
  '([\p{{L}}\p{{N}}_])((?:alin|lit|cap|art|pct|sec[țt]|tit|par)\.)', '\1 \2', 'g'),
  '\)([a-zăâîșțA-ZĂÂÎȘȚ])', ') \1', 'g'), '(și|sau|de|cu|la|în|pentru|ca|dacă)([a-z]\))', '\1 \2', 'g') AS text FROM documents""",
)
def normalize_references_query(spark, sf_dir):
    """Whole texts with references glued on, put apart again."""
    glued = F.col("text")
    for plain, joined in ((" la ", " laalin. "), (" de ", " deart. "), (" and ", ")and "), (" the ", " lab) ")):
        glued = F.replace(glued, F.lit(plain), F.lit(joined))
    return documents(spark, sf_dir).select("doc_id", normalize_references(glued).alias("text"))


@REGISTRY.query("format_paragraphs")
def format_paragraphs_query(spark, sf_dir):
    """Sentences of whole texts numbered as paragraphs with lettered points, then formatted."""
    capital = "[A-ZĂÎÂȘȚÄÖÜÉÈÊÇ]"
    numbered = F.array_join(
        F.transform(
            F.split("text", rf"(?<=\.)\s+(?={capital})"),
            lambda s, i: F.when(i % 3 == 0, F.concat(F.lit("("), (i / 3 + 1).cast("int").cast("string"), F.lit(") "), s))
            .when(i % 3 == 1, F.concat(F.lit("a) "), s, F.lit(";...")))
            .otherwise(F.concat(F.lit("b) "), s, F.lit(" "))),
        ),
        "",
    )
    rows = documents(spark, sf_dir).select("doc_id", numbered.alias("text"))
    return rows.select("doc_id", format_paragraphs("text").alias("text"))


@REGISTRY.query(
    "format_letters",
    f"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(parts) = 0 THEN 'Intro' WHEN len(parts) = 1 THEN 'Intro a) ' || parts[1] ELSE
   {strip_sql("'Intro'")} || ':' || array_to_string([chr(10) || '  **' || chr(CAST(97 + (i - 1) % 20 AS INTEGER)) || ')** ' || {strip_sql('parts[i]')} FOR i IN range(1, len(parts) + 1)], '') END AS text
FROM (SELECT doc_id, text, [{strip_sql('p')} FOR p IN string_split(text, chr(10)) IF {strip_sql('p')} <> ''] AS parts FROM documents)""",
)
def format_letters_query(spark, sf_dir):
    """All lines of a text as points lettered a) to t), then again from a), joined the way parsed bodies are."""
    lines = F.filter(F.split("text", "\n"), lambda p: F.length(F.regexp_replace(p, r"(?U)\s", "")) > 0)
    points = F.transform(lines, lambda p, i: F.concat(F.char(i % 20 + 97), F.lit(") "), p))
    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("Intro "), F.array_join(points, ";...")).alias("text"))
    return rows.select("doc_id", format_letters("text").alias("text"))


@REGISTRY.query(
    "article_labels",
    with_ctes(
        DOC_LINES_SQL,
        body=rf"""SELECT article_id, CASE WHEN ordinal % 3 = 0 THEN 'Anexa ' || article_number ELSE 'Articolul ' || article_number END AS label,
  {strip_sql("text")} AS text FROM articles""",
    ),
)
def article_labels(spark, sf_dir):
    """Labels with trailing words are cut, and a label glued before its text is removed."""
    number = F.col("article_number")
    label = F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("Anexa "), number)).otherwise(
        F.concat(F.lit("Articolul "), number, F.lit(" - Definiții"))
    )
    rows = doc_lines(spark, sf_dir).select("article_id", "text", clean_label(label).alias("label"))
    glued = F.concat("label", F.lit(" "), "text")
    return rows.select("article_id", "label", strip_label_prefix(glued, "label").alias("text"))


@REGISTRY.query(
    "file_key",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'ORDONANTA_DE_URGENTA' WHEN 1 THEN 'HOTARÎRE_X' WHEN 2 THEN 'LEGE' WHEN 3 THEN 'INSTRUCTIUNE_SA' ELSE NULL END AS key_type,
  CASE WHEN o_orderkey % 5 = 4 THEN 'act_legislativ' ELSE
    (CASE o_orderkey % 5 WHEN 0 THEN 'ORDONANTA_DE_URGENTA' WHEN 1 THEN 'HOTARÎRE_X' WHEN 2 THEN 'LEGE' ELSE 'INSTRUCTIUNE_SA' END)
    || CASE WHEN o_orderkey % 3 > 0 THEN '_' || CAST(o_orderkey AS VARCHAR) ELSE '' END
    || CASE WHEN o_orderkey % 7 > 0 THEN '_' || CAST(year(o_orderdate) AS VARCHAR) ELSE '' END END AS file_key FROM orders""",
)
def file_key(spark, sf_dir):
    key = F.col("o_orderkey")
    kind = (
        F.when(key % 5 == 0, "ORDONANȚĂ DE URGENȚĂ")
        .when(key % 5 == 1, "HOTĂRÎRE X")
        .when(key % 5 == 2, "LEGE")
        .when(key % 5 == 3, "INSTRUCȚIUNE ȘÂ")
    )
    number, year = F.when(key % 3 > 0, key), F.when(key % 7 > 0, F.year("o_orderdate"))
    plain = F.nullif(result_file_key(kind, F.lit(None), F.lit(None)), F.lit("act_legislativ"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", plain.alias("key_type"), result_file_key(kind, number, year).alias("file_key")
    )


@REGISTRY.query(
    "result_filename",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN 'LEGE_' || CAST(o_custkey AS VARCHAR) || '_' || CAST(year(o_orderdate) AS VARCHAR) END AS act,
  CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate + to_seconds(CAST(o_orderkey AS INTEGER)) END AS ts,
  CASE WHEN o_orderkey % 4 < 3 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'md' ELSE 'csv' END END AS kind FROM orders""",
)
def result_filename(spark, sf_dir):
    key = F.col("o_orderkey")
    ts = F.col("o_orderdate") + F.make_interval(secs=key)
    name = F.concat(
        F.lit("LEGE_"),
        F.col("o_custkey").cast("string"),
        F.lit("_"),
        F.year("o_orderdate").cast("string"),
        F.lit("_"),
        F.when(key % 4 == 3, F.date_format(ts, "yyyyMMdd")).otherwise(F.date_format(ts, "yyyyMMdd_HHmmss")),
        F.when(key % 4 == 0, ".md").otherwise(".csv"),
    )
    parsed = parse_result_filename(name)
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", parsed.alias("p")).select("o_orderkey", "p.*")


@REGISTRY.query(
    "typed_parsing",
    """SELECT o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) END AS parsed_date,
  CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE CAST(trunc(o_totalprice) AS INTEGER) END AS parsed_int,
  CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE o_totalprice END AS parsed_float FROM orders""",
)
def typed_parsing(spark, sf_dir):
    """Strings as they stand in article files: two date formats, decimals, Roman numerals, blanks."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    as_date = (
        F.when(key % 5 == 0, F.date_format(date, " d/M/yyyy "))
        .when(key % 5 == 1, F.date_format(date, "yyyy-MM-dd"))
        .when(key % 5 == 2, F.lit("31/02/2024"))
        .when(key % 5 == 3, F.date_format(date, "d.M.yyyy"))
        .otherwise("")
    )
    as_number = F.when(key % 5 == 3, "XIV").when(key % 5 == 4, "  ").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        parse_date(as_date).alias("parsed_date"),
        parse_int(as_number).alias("parsed_int"),
        parse_float(as_number).alias("parsed_float"),
    )


_MONTHS_SQL = "['ianuarie','februarie','martie','aprilie','mai','iunie','iulie','august','septembrie','octombrie','noiembrie','decembrie']"


def _designation():
    """Designations in three shapes, from order keys and dates."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    months = F.array(*[F.lit(m) for m in _MONTHS_SQL.strip("[]").replace("'", "").split(",")])
    month = F.get(months, F.month(date) - 1)
    long_date = F.concat(F.dayofmonth(date).cast("string"), F.lit(" "), month, F.lit(" "), F.year(date).cast("string"))
    number = key.cast("string")
    return (
        F.when(key % 4 == 0, F.concat(F.lit("Lege nr. "), number, F.lit(" din "), long_date))
        .when(key % 4 == 1, F.concat(F.lit("ORDONANŢĂ DE URGENŢĂ nr."), number, F.lit("/"), F.year(date).cast("string")))
        .when(key % 4 == 2, F.concat(F.lit("metodologie din "), long_date))
        .otherwise(F.concat(F.lit("Comunicat privind ordinea nr. "), number))
    )


@REGISTRY.query(
    "act_metadata_basic",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'LEGE' WHEN 1 THEN 'ORDONANȚĂ DE URGENȚĂ' WHEN 2 THEN 'METODOLOGIE' ELSE 'ORDIN' END AS act_type,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey AS INTEGER) END AS act_number,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS act_year,
  CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%-d/%m/%Y') END AS act_date, o_orderpriority AS title FROM orders""",
)
def act_metadata_basic(spark, sf_dir):
    packed = basic_metadata(_designation(), "o_orderpriority")
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", packed.alias("m")).select("o_orderkey", "m.*")


@REGISTRY.query(
    "act_metadata_full",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'LEGE' WHEN 1 THEN 'ORDONANȚĂ DE URGENȚĂ' WHEN 2 THEN 'METODOLOGIE' END AS act_type,
  CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderkey AS INTEGER) END AS act_number,
  CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN '01/01/' || CAST(year(o_orderdate) AS VARCHAR) WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') END AS act_date,
  CASE WHEN o_orderkey % 4 < 3 THEN CAST(year(o_orderdate) AS INTEGER) END AS act_year, o_orderkey % 4 = 1 AS date_is_approximate,
  o_orderpriority AS title, CAST(o_custkey AS VARCHAR) AS issuer, CAST(o_custkey AS INTEGER) AS gazette_nr,
  '07/03/2019' AS gazette_date, CAST(2019 AS INTEGER) AS gazette_year FROM orders""",
)
def act_metadata_full(spark, sf_dir):
    issuer = F.col("o_custkey").cast("string")
    gazette = F.concat(F.lit("MONITORUL OFICIAL nr. "), issuer, F.lit(" din 7 martie 2019"))
    packed = full_metadata(_designation(), "o_orderpriority", issuer, gazette)
    return spread(table(spark, sf_dir, "orders")).select("o_orderkey", packed.alias("m")).select("o_orderkey", "m.*")


@REGISTRY.query(
    "act_metadata_typed",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'LEGE' WHEN 1 THEN 'ORDONANȚĂ DE URGENȚĂ' WHEN 2 THEN 'METODOLOGIE' ELSE 'ORDIN' END AS act_type,
  CASE WHEN o_orderkey % 4 <> 2 THEN CAST(o_orderkey AS VARCHAR) END AS act_number,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS act_date,
  CASE WHEN o_orderkey % 4 < 3 THEN CAST(year(o_orderdate) AS INTEGER) END AS act_year,
  CASE WHEN o_orderkey % 4 = 3 THEN 'ordinea nr. ' || CAST(o_orderkey AS VARCHAR) END AS title,
  CAST(o_custkey AS VARCHAR) AS gazette_nr, CASE WHEN o_custkey % 2 = 0 THEN DATE '2019-03-07' END AS gazette_date,
  CASE WHEN o_custkey % 2 = 0 THEN CAST(2019 AS INTEGER) END AS gazette_year FROM orders""",
)
def act_metadata_typed(spark, sf_dir):
    day = F.when(F.col("o_custkey") % 2 == 0, " din 7 martie 2019").otherwise(" din 31 februarie 2019")
    gazette = F.concat(F.lit("MONITORUL OFICIAL AL ROMÂNIEI, PARTEA I, nr. "), F.col("o_custkey").cast("string"), day)
    none = F.lit(None).cast("string")
    packed = consolidated_metadata(_designation(), none, none, gazette)
    rows = spread(table(spark, sf_dir, "orders")).select("o_orderkey", packed.alias("m"))
    return rows.select(
        "o_orderkey",
        "m.act_type",
        "m.act_number",
        "m.act_date",
        "m.act_year",
        "m.title",
        F.col("m.gazette.nr").alias("gazette_nr"),
        F.col("m.gazette.date").alias("gazette_date"),
        F.col("m.gazette.year").alias("gazette_year"),
    )


@REGISTRY.query(
    "month_numbers",
    "SELECT event_id, CASE WHEN event_id % 13 < 12 THEN CAST(event_id % 13 + 1 AS INTEGER) END AS month FROM events",
)
def month_numbers(spark, sf_dir):
    names = F.array(*[F.lit(m.title()) for m in _MONTHS_SQL.strip("[]").replace("'", "").split(",")], F.lit("brumar"))
    return table(spark, sf_dir, "events").select(
        "event_id", month_number(F.get(names, (F.col("event_id") % 13).cast("int"))).alias("month")
    )


@REGISTRY.query("highlights", "SELECT doc_id, substr(text, 1, 200) AS highlight FROM documents")
def highlights(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", highlight("text").alias("highlight"))
