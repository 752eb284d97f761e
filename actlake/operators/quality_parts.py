"""The document rules over documents in parts, judged without gathering a document.

A document is the concatenation of its parts in order. Every part but a document's last ends with a line, which
``cut_parts`` and the Markdown sink keep to. Each part yields a small state: counts, first examples, the runs of line
breaks at both edges, begun and ended references, and whether it opens or closes the index. Windows over the states
alone give every part what stands before it; texts are read again only for the parts of an index. What spans parts
(the metadata block, the index, runs of line breaks, a reference or link that begins in one part and ends in a later
one) counts as in the whole document.

The result is that of ``quality.check_documents``. Null content is an empty part; a document with empty parts only is
an empty document. ``file`` and ``part`` are not null, and a part occurs once. One case differs: a reference that spans
parts and whose last two asterisks would also begin the next one at the end of the same part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import quality as q

PART_CHARS = 1 << 20
SHOWN = 100  # characters, and blank parts, kept of what an example shows the first 80 characters of
_CLOSE = r"(?m)^##(?!#)"


def cut_parts(documents: DataFrame, *, file: str = "file", content: str = "content", part_chars: int = PART_CHARS) -> DataFrame:
    """(file, part, content): whole lines of at most ``part_chars`` characters together; a longer line is a part of its own."""
    pattern = rf"[\s\S]{{0,{part_chars}}}\n|[\s\S]+?(?:\n|\z)"
    text = F.coalesce(F.col(content), F.lit(""))
    pieces = F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return documents.select(file, F.posexplode(pieces).alias("part", "content"))


def _matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _found(hits: Column, n: int, width: int) -> Column:
    """How many there are and the first ones as they are shown."""
    return F.struct(F.size(hits).cast("long").alias("n"), q._examples(hits, n, width).alias("shown"))


def _edges(c: Column, pattern: str) -> Column:
    """A reference pattern's hits, those left if a reference begun before ends here, and what begins or ends here."""
    opening, closing = pattern.split(r"\s*")
    head = F.regexp_extract(c, rf"\A\s*{closing}", 0)
    rest = F.substr(c, F.length(head) + 1)
    # found references are made one letter, so that none of their characters begins another
    tail = F.regexp_extract(F.regexp_replace(c, pattern, "x"), rf"{opening}\s*\z", 0)
    return F.struct(
        _found(_matches(c, pattern), 5, 80).alias("alone"),
        _found(_matches(rest, pattern), 5, 80).alias("after"),
        head.alias("head"),
        F.substring(tail, 1, SHOWN).alias("tail"),
    )


def _piece(c: Column, opens: Column) -> Column:
    """A part's share of the index: from the index heading where it stands here, else from the part's start."""
    goes_on = F.get(F.split(F.substring_index(c, q.INDEX, 1), _CLOSE), F.lit(0))
    return F.when(opens, q.index_section(c)).otherwise(goes_on)


def _link_edge(piece: Column) -> Column:
    """Whether no link can be open at the piece's end: True or False whatever came before, NULL: as before it."""
    settled = piece.contains(")") & piece.rlike(r"\][^\[\]]*\z") & ~piece.rlike(r"\]\(#[^\)]*\z")
    return F.when(settled, F.lit(True)).when(piece.contains("["), F.lit(False))


def _states(parts: DataFrame, file: str, part: str, content: str) -> DataFrame:
    """The state of each part; looks at nothing but the part."""
    c = F.col("_c")
    segments = F.split(c, q.FENCE)
    after_index = F.substr(c, F.instr(c, F.lit(q.INDEX)) + len(q.INDEX))
    lines = F.split(c, "\n")
    loose = F.filter(lines, lambda x: x.rlike(q.UNFORMATTED) & ~x.rlike(q.REFERENCE))
    flat = F.filter(lines, lambda x: x.rlike(q.FLAT_LETTER))
    inner = F.regexp_replace(c, r"\A\n+|\n+\z", "")
    count = lambda pattern: F.regexp_count(c, F.lit(pattern)).cast("long")
    rows = parts.select(F.col(file).alias("_file"), F.col(part).alias("_part"), F.coalesce(F.col(content), F.lit("")).alias("_c"))
    return rows.select(
        "_file",
        "_part",
        F.when(c != "", c.startswith(q.FENCE)).alias("starts"),
        q._count_text(c, q.FENCE).cast("long").alias("n_fences"),
        # the metadata block is what stands after the first fence: here after one fence, or up to one
        *[
            F.array(*[F.coalesce(F.get(segments, F.lit(k)).contains(f"{f}:"), F.lit(False)) for f in q.REQUIRED_FIELDS]).alias(f"fields_{k}")
            for k in (0, 1)
        ],
        c.contains(q.INDEX).alias("has_index"),
        c.contains(q.ARTICLES).alias("has_articles"),
        ((q._count_text(c, q.INDEX) >= 2) | after_index.rlike(_CLOSE)).alias("ends_own"),
        (c.contains(q.INDEX) | c.rlike(_CLOSE)).alias("ends_open"),
        _link_edge(_piece(c, F.lit(True))).alias("edge_own"),
        _link_edge(_piece(c, F.lit(False))).alias("edge_open"),
        count(q.PARAGRAPH).alias("n_paragraphs"),
        count(q.LETTER).alias("n_letters"),
        count(q.HEADING).alias("n_headings"),
        count(q.CONTEXT).alias("n_contexts"),
        count(" {3,}").alias("n_spaces"),
        _found(loose, 3, 80).alias("loose"),
        _found(flat, 3, 60).alias("flat"),
        F.array(*[_edges(c, p) for p in q.BOLD_REFERENCES]).alias("references"),
        c.rlike(r"\A\s*\z").alias("blank"),
        F.when(c.rlike(r"\A\s*\z"), F.substring(c, 1, SHOWN)).alias("gap"),
        (F.length(F.regexp_extract(c, r"\A\n*", 0))).cast("long").alias("lead"),
        F.length(F.regexp_extract(c, r"\n*\z", 0)).cast("long").alias("trail"),
        (inner == "").alias("only_breaks"),
        F.regexp_count(inner, F.lit("\n{3,}")).cast("long").alias("n_runs"),
    )


def _in_context(states: DataFrame) -> DataFrame:
    """States with what the parts before them hold."""
    order = Window.partitionBy("_file").orderBy("_part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero, no = F.lit(0).cast("long"), F.lit(False)
    rows = states.withColumns(
        {
            "fences_before": F.coalesce(F.sum("n_fences").over(before), zero),
            "index_part": F.min(F.when(F.col("has_index"), F.col("_part"))).over(so_far),
            "breaks": F.coalesce(F.sum(F.when(F.col("only_breaks"), F.col("lead"))).over(so_far), zero),
            "begun": F.last(F.when(~F.col("blank"), F.transform("references", lambda r: r["tail"])), ignorenulls=True).over(before),
            "text_part": F.last(F.when(~F.col("blank"), F.col("_part")), ignorenulls=True).over(before),
            "blanks": F.collect_list(F.when(F.col("blank"), F.struct("_part", "gap"))).over(order.rowsBetween(-SHOWN, -1)),
            "is_last": F.lead(F.lit(True)).over(order).isNull(),
        }
    )
    opens = F.coalesce(F.col("index_part") == F.col("_part"), no)
    rows = rows.withColumns(
        {
            "opens": opens,
            "ends": F.col("index_part").isNotNull() & F.when(opens, F.col("ends_own")).otherwise(F.col("ends_open")),
            # line breaks at the end of what stands before: the last other part's, and those of parts of nothing else since
            "run_before": F.coalesce(F.last(F.when(~F.col("only_breaks"), F.col("trail") - F.col("breaks")), ignorenulls=True).over(before), zero),
        }
    )
    rows = rows.withColumn("run_before", F.col("run_before") + F.coalesce(F.lag("breaks").over(order), zero))
    rows = rows.withColumn("in_index", F.col("index_part").isNotNull() & ~F.coalesce(F.max("ends").over(before), no))
    edge = F.when(F.col("in_index"), F.when(opens, F.col("edge_own")).otherwise(F.col("edge_open")))
    rows = rows.withColumn("settled", F.coalesce(F.last(edge, ignorenulls=True).over(so_far), F.lit(True)))
    # parts of the index between which a link may run belong to one group
    fresh = F.when(F.coalesce(F.lag("settled").over(order), F.lit(True)), 1).otherwise(0)
    rows = rows.withColumn("group", F.sum(fresh).over(so_far))
    # a run of line breaks counts where it ends
    broken = F.when(~F.col("only_breaks"), (F.col("run_before") + F.col("lead") >= 3).cast("long") + F.col("n_runs")).otherwise(zero)
    trailing = F.when(F.col("only_breaks"), F.col("run_before") + F.col("lead")).otherwise(F.col("trail"))
    rows = rows.withColumn("n_breaks", broken + (F.col("is_last") & (trailing >= 3)).cast("long"))

    def with_begun(r: Column, i: Column) -> Column:
        tail = F.coalesce(F.get("begun", i), F.lit(""))
        since = F.filter("blanks", lambda b: b["_part"] > F.col("text_part"))
        gap = F.array_join(F.transform(since, lambda b: b["gap"]), "")
        joined = q._examples(F.array(F.concat(tail, gap, r["head"])), 1, 80)
        ended = F.struct((r["after"]["n"] + 1).alias("n"), F.concat(joined, r["after"]["shown"]).alias("shown"))
        return F.when((tail != "") & (r["head"] != ""), ended).otherwise(r["alone"])

    return rows.withColumn("bold", F.transform("references", with_begun))


def _first(rows: DataFrame, order: str, n: int) -> DataFrame:
    """(_file, n, shown) of rows (_file, order, text): how many, and the first ``n`` texts in order."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_file").orderBy(order))).where(F.col("_rank") <= n)
    shown = F.array_sort(F.collect_list(F.struct("_rank", "text")))
    return ranked.groupBy("_file").agg(F.transform(shown, lambda s: s["text"]).alias("shown"))


def _examples_of(context: DataFrame) -> DataFrame:
    """(_file, loose, flat, bold): the first examples of the rules that show some."""
    def marked(shown: Column, rule: str, pattern: Column) -> Column:
        return F.transform(shown, lambda t, i: F.struct(F.lit(rule).alias("rule"), pattern.alias("pattern"), i.alias("at"), t.alias("text")))

    bold = F.flatten(F.transform("bold", lambda b, k: marked(b["shown"], "bold", k)))
    listed = F.concat(marked(F.col("loose.shown"), "loose", F.lit(0)), marked(F.col("flat.shown"), "flat", F.lit(0)), bold)
    rows = context.select("_file", "_part", F.explode(listed).alias("e")).select("_file", "_part", "e.*")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("_file", "rule").orderBy("pattern", "_part", "at")))
    ranked = ranked.where(F.col("rank") <= F.when(F.col("rule") == "bold", 5).otherwise(3))

    def of(rule: str) -> Column:
        held = F.array_sort(F.collect_list(F.when(F.col("rule") == rule, F.struct("rank", "text"))))
        return F.array_join(F.transform(held, lambda s: s["text"]), " | ").alias(f"{rule}_shown")

    return ranked.groupBy("_file").agg(of("loose"), of("flat"), of("bold"))


def _links(parts: DataFrame, context: DataFrame, file: str, part: str, content: str) -> DataFrame:
    """(_file, at, text, anchor) of the links of the indexes. Only the parts of an index are read."""
    wanted = context.where("in_index").select("_file", "_part", "opens", "group")
    texts = parts.select(F.col(file).alias("_file"), F.col(part).alias("_part"), F.coalesce(F.col(content), F.lit("")).alias("_c"))
    pieces = wanted.join(texts, ["_file", "_part"]).select("_file", "group", "_part", _piece(F.col("_c"), F.col("opens")).alias("piece"))
    ordered = F.array_sort(F.collect_list(F.struct("_part", "piece")))
    merged = pieces.groupBy("_file", "group").agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("text"))
    found = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(q._LINK), F.lit(1)).alias("text"), F.regexp_extract_all("text", F.lit(q._LINK), F.lit(2)).alias("anchor")
    )
    links = merged.select("_file", "group", F.posexplode(found).alias("i", "l"))
    return links.select("_file", F.struct("group", "i").alias("at"), "l.text", "l.anchor")


def check_parts(parts: DataFrame, *, file: str = "file", part: str = "part", content: str = "content") -> DataFrame:
    """(file, rule, severity, passed, detail) for every document and document rule."""
    context = stored(_in_context(_states(parts, file, part, content)).drop("references", "begun", "blanks", "gap"), "quality-states")
    total = lambda name: F.sum(name).alias(name)
    blocks = [
        F.max(
            F.coalesce(F.when(F.col("fences_before") == 0, F.col("fields_1")[i]).when(F.col("fences_before") == 1, F.col("fields_0")[i]), F.lit(False))
        ).alias(f"field_{i}")
        for i in range(len(q.REQUIRED_FIELDS))
    ]
    totals = context.groupBy("_file").agg(
        F.coalesce(F.min_by("starts", F.when(F.col("starts").isNotNull(), F.col("_part"))), F.lit(False)).alias("starts"),
        *map(total, ("n_fences", "n_paragraphs", "n_letters", "n_headings", "n_contexts", "n_spaces", "n_breaks")),
        F.max("has_index").alias("has_index"),
        F.max("has_articles").alias("has_articles"),
        F.sum("loose.n").alias("n_loose"),
        F.sum("flat.n").alias("n_flat"),
        F.sum(F.aggregate("bold", F.lit(0).cast("long"), lambda a, b: a + b["n"])).alias("n_bold"),
        *blocks,
    )
    links = stored(_links(parts, context, file, part, content), "quality-links")
    bad = links.where(~F.col("anchor").rlike(r"^[a-z0-9-]+$")).select("_file", "at", F.col("anchor").alias("text"))
    of_links = links.groupBy("_file").agg(
        F.count("*").alias("n_links"), F.count_if(~F.col("anchor").rlike(r"^[a-z0-9-]+$")).alias("n_bad")
    )
    headings = parts.select(F.col(file).alias("_file"), F.explode(F.regexp_extract_all(content, F.lit(r"(?m)^### (.+)$"), F.lit(1))).alias("text"))
    broken = links.groupBy("_file", "text").agg(F.min("at").alias("at")).join(headings.distinct(), ["_file", "text"], "left_anti")

    def shown(rows: DataFrame, name: str) -> DataFrame:
        return _first(rows, "at", 3).select("_file", F.array_join(q._examples(F.col("shown")), " | ").alias(name))

    rows = totals.join(_examples_of(context), "_file", "left").join(of_links, "_file", "left").join(shown(bad, "bad_shown"), "_file", "left")
    rows = rows.join(broken.groupBy("_file").agg(F.count("*").alias("n_broken")), "_file", "left").join(shown(broken, "broken_shown"), "_file", "left")
    number = lambda name: F.coalesce(F.col(name), F.lit(0))

    def found(n: str, examples: str | None = None) -> Column:
        text = F.concat(F.lit("found "), number(n).cast("string"))
        return text if examples is None else F.concat(text, F.lit(": "), F.coalesce(F.col(examples), F.lit("")))

    starts, closed, indexed = F.col("starts"), F.col("n_fences") >= 2, F.col("has_index")
    missing = F.concat_ws(", ", *[F.when(~F.col(f"field_{i}"), f) for i, f in enumerate(q.REQUIRED_FIELDS)])
    present = lambda c: F.when(c, "present").otherwise("missing")
    none = F.lit("no index")
    results = {
        "has_metadata_header": (
            starts & closed,
            F.when(~starts, "no metadata block at the start").when(~closed, "metadata block is not closed").otherwise("present"),
        ),
        "has_index": (indexed, present(indexed)),
        "has_articles": (F.col("has_articles"), present(F.col("has_articles"))),
        "paragraphs_formatted": (F.lit(True), found("n_paragraphs")),
        "no_unformatted_paragraphs": (F.col("n_loose") == 0, found("n_loose", "loose_shown")),
        "letters_formatted": (F.lit(True), found("n_letters")),
        "letters_indented": (F.col("n_flat") == 0, found("n_flat", "flat_shown")),
        "references_not_bold": (F.col("n_bold") == 0, found("n_bold", "bold_shown")),
        "index_links_valid": (
            ~indexed | ((number("n_links") > 0) & (number("n_bad") == 0)),
            F.when(~indexed, none).when(number("n_links") == 0, "the index holds no links").otherwise(found("n_bad", "bad_shown")),
        ),
        "index_links_working": (~indexed | (number("n_broken") == 0), F.when(~indexed, none).otherwise(found("n_broken", "broken_shown"))),
        "metadata_complete": (starts & (missing == ""), F.when(~starts, "no metadata block").otherwise(F.concat(F.lit("missing: "), missing))),
        "articles_have_context": (
            (F.col("n_headings") > 0) & (F.col("n_contexts") >= F.col("n_headings")),
            F.concat(F.col("n_contexts").cast("string"), F.lit("/"), F.col("n_headings").cast("string")),
        ),
        "no_extra_spaces": (F.col("n_spaces") == 0, found("n_spaces")),
        "no_extra_newlines": (F.col("n_breaks") == 0, found("n_breaks")),
    }
    listed = [
        F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), results[r.id][0].alias("passed"), results[r.id][1].alias("detail"))
        for r in q.DOCUMENT_RULES
    ]
    return rows.select(F.col("_file").alias(file), F.explode(F.array(*listed)).alias("r")).select(file, "r.*")
