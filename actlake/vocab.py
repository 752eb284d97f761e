"""Vocabularies, bounds, weights, class names and patterns.

Everything in this module is data that results depend on. Operators take these as
parameters with the values below as defaults, so other languages or page layouts
only need other tables.
"""

from __future__ import annotations

from html.entities import name2codepoint

# --- fixed values: act types, in matching order (first one contained wins) ---
ACT_TYPES = (
    "LEGE",
    "ORDONANȚĂ DE URGENȚĂ",
    "ORDONANȚĂ",
    "HOTĂRÂRE",
    "DECRET",
    "ORDIN",
    "REGULAMENT",
    "NORMĂ",
    "INSTRUCȚIUNE",
    "METODOLOGIE",
)

# --- fixed values: month names ---
MONTHS = {
    "ianuarie": 1,
    "februarie": 2,
    "martie": 3,
    "aprilie": 4,
    "mai": 5,
    "iunie": 6,
    "iulie": 7,
    "august": 8,
    "septembrie": 9,
    "octombrie": 10,
    "noiembrie": 11,
    "decembrie": 12,
}

# --- fixed values: bounds and weights ---
MIN_YEAR = 1900
MAX_YEAR = 2100
MIN_TEXT_LENGTH = 10
MIN_HTML_LENGTH = 100
CONFIDENCE_WEIGHTS = {
    "has_articles": 0.5,
    "has_structure": 0.2,
    "has_content": 0.2,
    "has_metadata": 0.1,
}

# --- fixed values: class names of marked-up act pages -> element kind ---
ACT_CLASSES = {
    "S_ART_TTL": "article",
    "S_ART": "article_block",
    "S_CAP_TTL": "chapter_nr",
    "S_CAP_DEN": "chapter_name",
    "S_SEC_TTL": "section_nr",
    "S_SEC_DEN": "section_name",
    "S_TTL_TTL": "title_nr",
    "S_TTL_DEN": "title_name",
}

# --- fixed values: body classes of an article, and the glue between label and text ---
BODY_CLASS = "S_ART_BDY"
BODY_PARTS = {
    "S_ALN": "...",
    "S_LIT": "...",
    "S_PCT": " ",
    "S_PAR": "",
}

# --- fixed values: classes that hold act metadata ---
METADATA_CLASSES = {
    "S_DEN": "designation",
    "S_HDR": "header",
    "S_EMT_BDY": "issuer",
    "S_EMI": "issuer_alt",
    "S_PUB_BDY": "publication",
    "S_MOF": "gazette",
}

# --- fixed values: designation and gazette patterns ---
TYPE_PATTERN = (
    "LEGE|ORDONANȚ[AĂ]\\s+DE\\s+URGEN[TȚ][AĂ]|ORDONANȚ[AĂ]|HOT[AĂ]R[ÂÎ]RE|DECRET|ORDIN|"
    "REGULAMENT|NORM[AĂ]|INSTRUC[TȚ]IUNE|METODOLOGIE"
)
UNNUMBERED_TYPE_PATTERN = "METODOLOGIE|REGULAMENT|NORM[AĂ]|INSTRUC[TȚ]IUNE"
GAZETTE_PATTERN = (
    "MONITORUL\\s+OFICIAL\\s*(?:AL\\s+ROM[AÂ]NIEI)?\\s*[,\\s]*(?:PARTEA\\s+I)?\\s*[,\\s]*"
    "nr\\.?\\s*(\\d+)\\s+din\\s+(\\d{1,2})\\s+(\\w+)\\s+(\\d{4})"
)
PARLIAMENT = ("PARLAMENTUL ROMÂNIEI", "Parlamentul României")

# --- fixed values: spelling of a type in a designation -> normal form, first match wins ---
TYPE_FORMS = (
    ("URGENȚĂ|URGENTA", "ORDONANȚĂ DE URGENȚĂ"),
    ("ORDONANȚ", "ORDONANȚĂ"),
    ("HOTĂR", "HOTĂRÂRE"),
    ("INSTRUCȚ", "INSTRUCȚIUNE"),
    ("NORMĂ|NORMA", "NORMĂ"),
    ("METODOLOGI", "METODOLOGIE"),
)

# --- fixed values: forms of a document address, preferred first ---
PRINT_FORM = "FormaPrintabila"
CONSOLIDATED_FORM = "FormaConsolidata"
DETAIL_FORM = "DetaliiDocument"

# --- fixed values: reference abbreviations and joining words in glued text ---
ABBREVIATIONS = ("alin", "lit", "cap", "art", "pct", "sec[țt]", "tit", "par")
JOINING_WORDS = ("și", "sau", "de", "cu", "la", "în", "pentru", "ca", "dacă")

# --- fixed values: status sets ---
AI_STATUSES = ("pending", "processing", "completed", "error")
EXPORT_STATUSES = ("pending", "exported", "error")
LINK_STATUSES = ("pending_scraping", "processing", "completed", "failed")
SOURCES = ("ai", "manual")

# --- fixed values: containers tried in order for the plain text of a page ---
TEXT_CONTAINERS = (
    "#content",
    ".content",
    "#main-content",
    ".main-content",
    ".document-content",
    ".law-content",
    ".act-content",
    "main",
    ".container",
    "body",
)

# Characters a blank-trim removes; Spark's trim() alone removes only U+0020.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85  "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)

# Character references by name, from the standard library's table.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
