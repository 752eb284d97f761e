"""From raw pages to element rows, headings in force, and article bodies.

No DOM is built and no Python runs per row. A page is split at the elements a
selector names, one row per element, in document order. An element's text is what
stands between its start and the next selected element, so the result is defined
for unclosed and badly nested markup as well. Read as ``nested``, open and close tags are
matched by a running depth: an element's own text ends where the element closes, and what
follows up to the next selected element are rows of their own, at the depth where they stand.

Splitting is map-only. Only the operators that look back in document order need
the rows of a page together; a `pages` table bucketed by its key already has them so.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import ColumnLike, as_column, first_int, let, normalize_references, roman_to_int, strip

_HIDDEN = r"(?is)<(?:!--.*?-->|(script|style)\b[^>]*>.*?</\1\s*>|![^>]*>)"
_TAG = r"</?[A-Za-z][^>]*(?:>|\z)"
_VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"
_BREAK = "\u0001"


@dataclass(frozen=True)
class Selector:
    """Which elements of a page are rows, and what they are.

    ``classes`` and ``tags`` map to an element kind; ``prefix`` selects further
    elements by class prefix without giving them a kind.
    """

    classes: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    prefix: str | None = None

    def start_pattern(self) -> str:
        """Zero-width-after-`<` pattern for the start of a selected element."""
        choices = []
        names = [f"{name}(?=[\\s\"'>])" for name in self.classes]
        if self.prefix:
            names.append(self.prefix)
        if names:
            joined = "|".join(names)
            choices.append(rf"[a-z][^>]*?\sclass\s*=\s*[\"']?(?:[^\"'>]*\s)?(?-i:{joined})")
        if self.tags:
            choices.append(rf"(?:{'|'.join(self.tags)})(?=[\s>/])")
        return rf"(?i)<(?={'|'.join(choices)})"


ACT_PAGES = Selector(classes=vocab.ACT_CLASSES | vocab.METADATA_CLASSES, prefix="S_")
GENERIC_PAGES = Selector(
    tags={
        "h1": "title",
        "h2": "chapter",
        "h3": "section",
        "p": "article",
        "li": "item",
        "footer": "footer",
    }
)


def detect_content_type(content: ColumnLike) -> Column:
    """'html' for a document start or a div with classes, else 'text'."""
    low = F.lower(strip(content))
    is_html = low.startswith("<!doctype") | low.startswith("<html") | (low.contains("<div") & low.contains("class="))
    return F.when(is_html, "html").otherwise("text")


# the references nearly every page uses; the rest go through the full table
_COMMON = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
_AMP = "\u0002"


# one expression string: building the map from single literals costs a call to the JVM each
_NAMED = ", ".join(f"'{name}', '\\u{ord(char):04x}'" for name, char in vocab.ENTITIES.items())


def _decode_rare(text: Column) -> Column:
    names = F.expr(f"map({_NAMED})")

    def decode(piece: Column) -> Column:
        ref = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        code = (
            F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 6), 16, 10).cast("long"))
            .when(ref.startswith("#"), F.substring(ref, 2, 7).try_cast("long"))
        )
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        by_code = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32"))
        char = F.when(ref.startswith("#"), by_code).when(ref != "", F.element_at(names, ref))
        rest = piece.substr(F.length(ref) + 2, F.length(piece))
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece))

    return F.array_join(F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(decode(p))), "")


def decode_entities(c: ColumnLike) -> Column:
    """Character references, by name and by number; unknown ones are left as they are.

    ``&amp;`` is set aside first, so that what it protects is not decoded twice.
    """
    text = as_column(c)
    common = F.replace(text, F.lit("&amp;"), F.lit(_AMP))
    for name, char in _COMMON.items():
        common = F.replace(common, F.lit(f"&{name};"), F.lit(char))
    rare = let(common, lambda t: F.when(t.rlike("&[#A-Za-z]"), _decode_rare(t)).otherwise(t))
    return F.when(text.contains("&"), F.replace(rare, F.lit(_AMP), F.lit("&"))).otherwise(text)


def inner_text(markup: ColumnLike, separator: str = "") -> Column:
    """Text nodes of a fragment, each trimmed, blank ones dropped, joined with ``separator``."""
    marked = let(F.regexp_replace(as_column(markup), _TAG, _BREAK), decode_entities)
    return F.array_join(_text_nodes(marked), separator)


def _text_nodes(marked: Column) -> Column:
    return F.filter(F.transform(F.split(marked, _BREAK), strip), lambda n: n != "")


def without_hidden(html: ColumnLike) -> Column:
    """Drop comments, scripts, styles and declarations before anything looks for tags, and characters that mark places here."""
    unmarked = F.replace(F.replace(as_column(html), F.lit(_BREAK), F.lit("")), F.lit(_AMP), F.lit(""))
    return F.regexp_replace(unmarked, _HIDDEN, "")


def classify_element(classes: ColumnLike, tag: ColumnLike, selector: Selector = ACT_PAGES) -> Column:
    """Kind of the first class found in the selector, else of the tag, else NULL."""

    def table(entries: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])

    kinds = []
    if selector.classes:
        hits = F.transform(as_column(classes), lambda c: F.element_at(table(selector.classes), c))
        kinds.append(F.get(F.filter(hits, lambda k: k.isNotNull()), F.lit(0)))
    if selector.tags:
        kinds.append(F.element_at(table(selector.tags), as_column(tag)))
    return F.coalesce(*kinds)


def html_elements(
    pages: DataFrame,
    *,
    key: str = "page_id",
    html: str = "html",
    selector: Selector = ACT_PAGES,
    separator: str = "",
    nested: bool = False,
) -> DataFrame:
    """One row per selected element with text: key, pos, tag, classes, kind, text.

    ``nested`` ends each text where its element closes. It also keeps elements without text
    of their own, adds the text nodes joined by blanks, depth_change, the number of elements
    left open (or closed) by the stretch of markup up to the next element, and rows without a
    tag for what stands in that stretch after the element: ``sub`` numbers them, and
    ``level`` is their depth from the end of the stretch.
    """
    pieces = pages.select(key, F.posexplode(F.split(without_hidden(html), selector.start_pattern())).alias("pos", "piece"))
    # a piece starts just after its '<'; what stands before the first element is not one
    piece, cut = F.col("piece"), F.instr("piece", F.lit(">"))
    pieces = pieces.where("pos > 0").select(
        key,
        "pos",
        F.substring_index("piece", ">", 1).alias("head"),
        F.when(cut > 0, piece.substr(cut + 1, F.length(piece))).otherwise("").alias("rest"),
    )
    # parsed row by row, so that the code is compiled; the explode at the end keeps later filters from parsing twice
    if nested:
        rows = _nested_elements(pieces, key, separator)
    else:
        element = F.struct(_tag_name().alias("tag"), _class_names().alias("classes"), inner_text("rest", separator).alias("text"))
        rows = pieces.select(key, "pos", F.explode(F.array(element)).alias("element")).select(key, "pos", "element.*")
    rows = rows.withColumn("kind", classify_element("classes", "tag", selector))
    return rows if nested else rows.where(F.col("text") != "")


def _tag_name() -> Column:
    return F.lower(F.regexp_extract("head", r"^([A-Za-z][A-Za-z0-9]*)", 1))


def _class_names() -> Column:
    attribute = F.regexp_extract("head", r"(?i)\sclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'/]+)", 1)
    names = F.btrim(attribute, F.lit("\"'"))
    several = F.filter(F.split(names, r"\s+"), lambda c: c != "")
    return F.when(names.rlike(r"\s"), several).when(names != "", F.array(names)).otherwise(F.array().cast("array<string>"))


def _nested_elements(pieces: DataFrame, key: str, separator: str) -> DataFrame:
    """The elements of ``pieces`` (head, rest) and the stretches of text behind them, as rows."""
    tag = _tag_name()
    own = F.when(tag.rlike(rf"^(?:{_VOID})$") | F.col("head").endswith("/"), 0).otherwise(1)
    rows = pieces.select(
        key,
        "pos",
        tag.alias("tag"),
        _class_names().alias("classes"),
        own.alias("own"),
        F.split(F.regexp_replace("rest", _TAG, _BREAK), _BREAK).alias("texts"),
        F.transform(F.regexp_extract_all("rest", F.lit(_TAG), F.lit(0)), _depth_change).alias("changes"),
    )
    rows = rows.withColumn("s", _stretches(F.col("own"), F.col("texts"), F.col("changes")))
    # the text nodes of each stretch, found once; tags are marks by now
    nodes = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(_text_nodes(decode_entities(t)))
    out = F.transform("s.out", lambda t: F.struct(t["m"].alias("m"), nodes(t["text"]).alias("nodes")))
    rows = rows.select(key, "pos", "tag", "classes", "own", F.col("s.r").alias("r"), out.alias("out"))
    rows = rows.select(key, "pos", F.posexplode(_nested_rows(separator)).alias("sub", "element"))
    return rows.select(key, "pos", "sub", "element.*")


def _depth_change(tag: Column) -> Column:
    flat = tag.rlike(rf"(?i)^</?(?:{_VOID})\b") | tag.endswith("/>")
    return F.when(flat, 0).when(tag.startswith("</"), -1).otherwise(1)


def _stretches(own: Column, texts: Column, changes: Column) -> Column:
    """struct(r, out): the depth after the markup, and its text cut wherever the depth falls below all before.

    Each of ``out`` is struct(m, text): text nodes, apart by marks, that stand at depth m or deeper.
    """
    start = F.struct(own.alias("r"), own.alias("m"), F.get(texts, F.lit(0)).alias("cur"), F.array().cast("array<struct<m:int,text:string>>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        text, depth = F.get(texts, i), s["r"] + F.get(changes, i - 1)
        done = F.struct(s["m"].alias("m"), s["cur"].alias("text"))
        fell = F.struct(depth.alias("r"), depth.alias("m"), text.alias("cur"), F.concat(s["out"], F.array(done)).alias("out"))
        on = F.struct(depth.alias("r"), s["m"].alias("m"), F.concat(s["cur"], F.lit(_BREAK), text).alias("cur"), s["out"].alias("out"))
        return F.when(depth < s["m"], fell).otherwise(on)

    ending = lambda s: F.struct(s["r"].alias("r"), F.concat(s["out"], F.array(F.struct(s["m"].alias("m"), s["cur"].alias("text")))).alias("out"))
    places = F.when(F.size(changes) > 0, F.sequence(F.lit(1), F.size(changes))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, ending)


def _nested_rows(separator: str) -> Column:
    """The element's row and one for each stretch of text behind it, as an array."""
    out, after, opens = F.col("out"), F.col("r"), F.col("own") == 1

    def row(tag: Column, classes: Column, nodes: Column, change: Column, level: Column) -> Column:
        return F.struct(
            tag.alias("tag"),
            classes.alias("classes"),
            F.array_join(nodes, separator).alias("text"),
            F.array_join(nodes, " ").alias("spaced"),
            change.alias("depth_change"),
            level.alias("level"),
        )

    none = F.array().cast("array<string>")
    first = F.when(opens, F.get(out, F.lit(0))["nodes"]).otherwise(none)
    own = row(F.col("tag"), F.col("classes"), first, after, F.lit(0))
    tails = F.when(opens, F.slice(out, F.lit(2), F.size(out))).otherwise(out)
    behind = F.transform(tails, lambda t: row(F.lit(None).cast("string"), none, t["nodes"], F.lit(0), t["m"] - after))
    return F.concat(F.array(own), behind)


def _in_order(key: str) -> Window:
    return Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


# level -> kinds that set it (with the value they set) and kinds that clear it
_LEVELS = {
    "title_nr": ({"title_nr": roman_to_int, "title": roman_to_int}, ()),
    "title_name": ({"title_name": strip, "title": strip}, ()),
    "chapter_nr": (
        {"chapter_nr": lambda t: F.coalesce(roman_to_int(t), first_int(t)), "chapter": first_int},
        ("title_nr", "title"),
    ),
    "chapter_name": ({"chapter_name": strip, "chapter": strip}, ("title_nr", "title")),
    "section_nr": (
        {"section_nr": first_int, "section": first_int},
        ("title_nr", "title", "chapter_nr", "chapter"),
    ),
    "section_name": (
        {"section_name": strip, "section": strip},
        ("title_nr", "title", "chapter_nr", "chapter"),
    ),
}


def fill_hierarchy(elements: DataFrame, *, key: str = "page_id") -> DataFrame:
    """Add the title, chapter and section in force at each element.

    A level is cleared by a non-NULL struct holding NULL, which a null-skipping
    ``last`` stops at. A new title clears chapter and section, a new chapter clears
    the section; names of a level stay until the next name of that level.
    """
    kind, text = F.col("kind"), F.col("text")
    speaks = text != ""
    filled = {}
    for level, (setters, clearers) in _LEVELS.items():
        event = None
        for name, value in setters.items():
            condition, held = speaks & (kind == name), F.struct(value(text).alias("v"))
            event = F.when(condition, held) if event is None else event.when(condition, held)
        if clearers:
            empty = F.struct(F.lit(None).cast("int" if level.endswith("_nr") else "string").alias("v"))
            event = event.when(speaks & kind.isin(*clearers), empty)
        filled[level] = F.last(event, ignorenulls=True).over(_in_order(key))["v"]
    return elements.withColumns(filled)


def page_metadata(elements: DataFrame, *, key: str = "page_id") -> DataFrame:
    """First text per metadata kind of each page, as columns."""
    kinds = list(dict.fromkeys(vocab.METADATA_CLASSES.values()))
    wanted = elements.where(F.col("kind").isin(*kinds) & (F.col("text") != ""))
    return wanted.groupBy(key).agg(
        *[F.min_by(F.when(F.col("kind") == k, F.col("text")), F.when(F.col("kind") == k, F.col("pos"))).alias(k) for k in kinds]
    )


def article_rows(
    elements: DataFrame, *, key: str = "page_id", require_number: bool = True
) -> DataFrame:
    """Article elements with the headings in force; by default only those with a number."""
    # no other elements set or clear a level, so no others are put in order
    kinds = dict.fromkeys(["article", *(name for setters, _ in _LEVELS.values() for name in setters)])
    filled = fill_hierarchy(elements.where(F.col("kind").isin(*kinds) & (F.col("text") != "")), key=key)
    rows = filled.where(F.col("kind") == "article")
    rows = rows.withColumn("article_number", first_int("text"))
    if require_number:
        rows = rows.where(F.coalesce(F.col("article_number"), F.lit(0)) != 0)
    return rows.drop("depth_change", "spaced", "kind", "sub", "level")


# ---------------------------------------------------------------- bodies


BODY_LEVELS = 12  # elements deeper inside a body are text of those around them


# the classes that make up a body; an open element is one number, its place and which of these it is
_BODY_NAMES = [n for part in vocab.BODY_PARTS for n in (part, f"{part}_TTL", f"{part}_BDY")]


def _code(name: str) -> int:
    return _BODY_NAMES.index(name) + 1


def _name_of(opened: Column) -> Column:
    return F.get(F.lit(_BODY_NAMES), _code_of(opened).cast("int") - 1)


def _code_of(opened: Column) -> Column:
    return opened.bitwiseAND(F.lit(15).cast("long"))


def _place_of(opened: Column) -> Column:
    return F.shiftright(opened, 4)


def _body_segments(elements: DataFrame, key: str) -> DataFrame:
    """Elements inside article bodies with their article, top-level part and nested item."""
    w = Window.partitionBy(key).orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, -1)
    depth, is_title, is_body = F.col("depth"), F.col("is_title"), F.col("is_body")
    names = F.lit(_BODY_NAMES)
    code = F.coalesce(F.array_position(names, F.get(F.filter("classes", lambda c: F.array_contains(names, c)), F.lit(0))), F.lit(0).cast("long"))

    rows = elements.select(
        key,
        "pos",
        "sub",
        "text",
        "spaced",
        "depth_change",
        "level",
        F.col("kind").eqNullSafe("article").alias("is_title"),
        F.array_contains("classes", vocab.BODY_CLASS).alias("is_body"),
        F.when(F.col("sub") == 0, F.shiftleft(F.col("pos").cast("long"), 4) + code).alias("opens"),
    )
    # how many elements are open around the row
    rows = rows.withColumn("depth", F.coalesce(F.sum("depth_change").over(before), F.lit(0)) + F.col("level"))
    # the body that was opened last, place 0 after a title
    latest = lambda value: F.last(F.when(is_title, F.lit(0)).when(is_body, value), ignorenulls=True).over(w)
    rows = rows.withColumns(
        {
            "article_pos": F.last(F.when(is_title, F.col("pos")), ignorenulls=True).over(w),
            "body_pos": latest(F.col("pos")),
            "body_depth": latest(depth),
        }
    )
    in_force, inside = F.col("body_pos") > 0, F.col("inside")
    rows = rows.withColumn("inside", F.when(in_force, depth - F.col("body_depth")))
    # where the body was left: at the first row that stands no deeper than it
    rows = rows.withColumn("left", F.last(F.when((inside <= 0) & ~is_body, F.col("pos")), ignorenulls=True).over(w))
    still = F.col("left").isNull() | (F.col("left") < F.col("body_pos"))
    rows = rows.where(in_force & (is_body | (still & (inside > 0))))

    # the open element at each level inside the body; a row that stands no deeper than a level ends what was open there
    levels = {}
    for level in range(1, BODY_LEVELS + 1):
        opened = F.when(~is_body & (inside == level) & F.col("opens").isNotNull(), F.col("opens")).when(inside <= level, F.lit(0).cast("long"))
        levels[f"level_{level}"] = F.last(opened, ignorenulls=True).over(w)
    rows = rows.withColumns(levels)
    stack = F.filter(F.array(*[F.col(n) for n in levels]), lambda e: _code_of(e) > 0)
    rows = rows.withColumn("stack", stack).drop(*levels)

    first, part = F.get("stack", F.lit(0)), F.col("part")
    rows = rows.withColumn("part", F.when(_code_of(first).isin(*[_code(p) for p in vocab.BODY_PARTS]), first))
    inner = F.slice("stack", F.lit(2), F.size("stack"))
    items = [_code("S_LIT"), _code("S_PCT")]
    holders = [*items, *[_code(f"{p}_{x}") for p in vocab.BODY_PARTS for x in ("TTL", "BDY")]]
    held = F.get(F.filter(inner, lambda e: _code_of(e).isin(*holders)), F.lit(0))
    rows = rows.withColumns({"held": _code_of(held) - _code_of(part), "open_item": F.get(F.reverse(F.filter(inner, lambda e: _code_of(e).isin(*items))), F.lit(0))})
    item = F.col("open_item")
    # a part's label and body come after it among the names
    role = F.when(F.col("held") == 1, "label").when(F.col("held") == 2, "body").otherwise("intro")
    own = lambda x: F.exists(inner, lambda e: (_place_of(e) > _place_of(item)) & (_code_of(e) == _code_of(item) + x))
    return rows.select(
        key,
        "pos",
        "sub",
        "text",
        "spaced",
        "article_pos",
        _place_of(part).cast("int").alias("part_pos"),
        _name_of(part).alias("part_name"),
        role.alias("role"),
        _place_of(item).cast("int").alias("item"),
        _name_of(item).alias("item_name"),
        F.when(own(1), "label").when(own(2), "body").otherwise("none").alias("item_role"),
    )


def _texts(segments: Column, keep=None, separator: str = "", field: str = "text") -> Column:
    chosen = segments if keep is None else F.filter(segments, keep)
    return F.array_join(F.filter(F.transform(chosen, lambda s: s[field]), lambda t: t != ""), separator)


def article_bodies(elements: DataFrame, *, key: str = "page_id", markdown: bool = True) -> DataFrame:
    """Body text and Markdown of each article: (key, article_pos, body, markdown); without the last on request.

    ``elements`` must be read with ``nested=True``: containers carry the nesting.
    Grouping is per part, then per article, so one group is one paragraph or one article.
    """
    segments = _body_segments(elements, key)
    fields = ("spaced", "role", "item", "item_name", "item_role") if markdown else ("role",)
    parts = (
        segments.where((F.col("text") != "") | F.col("role").isin("label", "body"))
        .groupBy(key, "article_pos", "part_pos", "part_name")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "sub", "text", *fields))).alias("segments"))
    )
    seg = F.col("segments")
    glue = F.coalesce(*[F.when(F.col("part_name") == n, F.lit(g)) for n, g in vocab.BODY_PARTS.items()])
    label = _texts(seg, lambda s: s["role"] == "label")
    in_body = _texts(seg, lambda s: s["role"] == "body")
    complete = F.exists(seg, lambda s: s["role"] == "label") & F.exists(seg, lambda s: s["role"] == "body")
    is_par = F.col("part_name") == "S_PAR"
    plain = F.when(is_par, F.nullif(_texts(seg), F.lit(""))).when(complete, F.concat(label, glue, in_body))

    def joined(name: str, separator: str) -> Column:
        values = F.filter(F.transform("parts", lambda p: p[name]), lambda t: t.isNotNull())
        return F.when(F.size(values) > 0, F.array_join(values, separator))

    def nonblank(name: str, separator: str) -> Column:
        values = F.filter(F.transform("parts", lambda p: p[name]), lambda t: t != "")
        return F.array_join(values, separator)

    body = F.coalesce(joined("plain", "..."), nonblank("everything", "")).alias("body")
    if not markdown:
        parts = parts.select(key, "article_pos", F.coalesce("part_pos", F.lit(0)).alias("part_pos"), plain.alias("plain"), _texts(seg).alias("everything"))
        grouped = parts.groupBy(key, "article_pos").agg(F.sort_array(F.collect_list(F.struct("part_pos", "plain", "everything"))).alias("parts"))
        return grouped.select(key, "article_pos", body)

    item_ids = F.array_distinct(
        F.transform(F.filter(seg, lambda s: s["item"].isNotNull()), lambda s: F.struct(s["item"].alias("id"), s["item_name"].alias("name")))
    )

    def item_line(item: Column) -> Column:
        of_item = lambda role: _texts(seg, lambda s: (s["item"] == item["id"]) & (s["item_role"] == role))
        tag, text = of_item("label"), normalize_references(of_item("body"))
        line = F.when(item["name"] == "S_LIT", F.concat(F.lit("  **"), tag, F.lit("** "), text)).otherwise(
            F.concat(tag, F.lit(" "), text)
        )
        return F.when((tag != "") & (text != ""), line)

    letters = F.filter(item_ids, lambda i: i["name"] == "S_LIT")
    points = F.filter(item_ids, lambda i: i["name"] == "S_PCT")
    loose = lambda s: s["item"].isNull() & (s["role"] != "label")
    spaced = _texts(seg, loose, " ", "spaced")
    intro = normalize_references(spaced)
    lettered = F.concat_ws(
        "\n",
        F.when(intro != "", F.concat(intro, F.lit("\n"))),
        F.nullif(F.array_join(F.transform(letters, item_line), "\n"), F.lit("")),
    )
    whole = normalize_references(F.when(is_par, _texts(seg)).otherwise(in_body))
    content = F.when(F.size(letters) > 0, lettered).otherwise(whole)
    numbered = F.when(complete, F.concat(F.lit("**"), label, F.lit("**\n\n"), content, F.lit("\n")))
    pointed = F.concat_ws(
        "\n",
        F.when(spaced != "", F.concat(spaced, F.lit("\n"))),
        F.nullif(F.array_join(F.transform(points, item_line), "\n"), F.lit("")),
    )
    parts = parts.select(
        key,
        "article_pos",
        F.coalesce("part_pos", F.lit(0)).alias("part_pos"),
        plain.alias("plain"),
        _texts(seg).alias("everything"),
        _texts(seg, separator="\n").alias("lines"),
        F.when(is_par & (F.size(points) > 0), True).otherwise(False).alias("has_points"),
        F.when(F.col("part_name") == "S_ALN", numbered).alias("numbered"),
        F.when(is_par, pointed).alias("pointed"),
        F.when(is_par, F.concat(content, F.lit("\n"))).alias("simple"),
    )
    grouped = parts.groupBy(key, "article_pos").agg(
        F.sort_array(
            F.collect_list(F.struct("part_pos", "plain", "everything", "lines", "numbered", "pointed", "simple"))
        ).alias("parts"),
        F.max("has_points").alias("has_points"),
    )
    return grouped.select(
        key,
        "article_pos",
        body,
        F.coalesce(
            F.when(F.col("has_points"), joined("pointed", "\n")),
            joined("numbered", "\n"),
            joined("simple", "\n"),
            normalize_references(nonblank("lines", "\n")),
        ).alias("markdown"),
    )


# ---------------------------------------------------------------- whole-page text

_DROPPED = r"(?is)<(script|style|nav|header|footer)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<![^>]*>"


def container_markup(html: ColumnLike, container: str) -> Column:
    """Markup from the start of the first matching container to its last closing tag, else NULL."""
    name = container.lstrip("#.")
    if container.startswith("#"):
        pattern = rf"(?is)<([a-z][a-z0-9]*)\b[^>]*\sid\s*=\s*[\"']?{name}[\"'\s>]"
    elif container.startswith("."):
        pattern = rf"(?is)<([a-z][a-z0-9]*)\b[^>]*\sclass\s*=\s*[\"']?(?:[^\"'>]*\s)?{name}[\"'\s>]"
    else:
        pattern = rf"(?is)<({name})[\s>]"
    text = as_column(html)

    def bounded(tail: Column) -> Column:
        closing = F.concat(F.lit("</"), F.lower(F.regexp_extract(tail, pattern, 1)))
        return let(closing, lambda tag: _up_to_last(tail, tag))

    start = F.regexp_instr(text, F.lit(pattern))
    cut = let(start, lambda at: F.when(at > 0, let(text.substr(at, F.length(text)), bounded)))
    return F.when(text.contains(name), cut)  # the plain substring test spares most regex runs


def _up_to_last(text: Column, closing: Column) -> Column:
    """Text before the last ``closing`` (given in lower case), or all of it."""

    def cut(from_end: Column) -> Column:
        length = F.length(text) - from_end - F.length(closing) + 1
        return F.when(from_end > 0, F.left(text, length)).otherwise(text)

    return let(F.instr(F.reverse(F.lower(text)), F.reverse(closing)), cut)


def plain_text(
    html: ColumnLike,
    *,
    containers: tuple[str, ...] = vocab.TEXT_CONTAINERS,
    enough: int = 1000,
    least: int = 500,
) -> Column:
    """Text lines of the first container with more than ``enough`` characters.

    If none is that long, the last container present counts, or the whole page where
    there is none; a result of at most ``least`` characters is NULL.
    """

    def choose(cleaned: Column) -> Column:
        found = F.array_compact(F.array(*[container_markup(cleaned, c) for c in containers]))
        markups = let(found, lambda ms: F.when(F.size(ms) > 0, ms).otherwise(F.array(cleaned)))
        return let(
            F.transform(markups, lambda m: inner_text(m, "\n")),
            lambda ts: F.coalesce(F.get(F.filter(ts, lambda t: F.length(t) > enough), F.lit(0)), F.element_at(ts, -1)),
        )

    chosen = let(F.regexp_replace(as_column(html), _DROPPED, ""), choose)
    return let(chosen, lambda t: F.when(F.length(t) > least, t))
