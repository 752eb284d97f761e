"""Nested results: work lists, views with arrays of children, export packages.

Children are always aggregated before they meet their parent, so two child tables never
multiply. Arrays come from structs that start with their order key.

A package is one act with its children. So that no act, however long, is gathered in one
row, its children are packed in order into parts by a running sum of their bytes: a part
holds the children that begin within `PART_BYTES` of it, so it is larger than that by less
than one child. (act_id, part) is the key of all packages. What belongs to the act itself, such as its
issues, is in part 0 only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import has_labels
from ..operators.search import with_children
from ..operators.stats import child_counts

OPEN = ("pending", "processing", "error")
PART_BYTES = 16 << 20
CHUNK = 1_000  # ordinals whose sizes are added up in one task
ISSUE_FIELDS = ("issue_id", "name", "description", "confidence", "remote_id")


def _array_of(fields: list[str], order: list[str], *, unique: bool = False) -> Column:
    """Ordered array of structs; the order key is sorted on and dropped again.

    ``unique`` drops repeated structs while collecting, map-side, instead of by a
    shuffle of its own.
    """
    sortable = F.struct(F.struct(*order).alias("k"), F.struct(*fields).alias("v"))
    collected = F.collect_set(sortable) if unique else F.collect_list(sortable)
    return F.transform(F.array_sort(collected), lambda x: x["v"])


def _in_bytes(rows: DataFrame, part_bytes: int) -> DataFrame:
    """Add ``part`` to children (act_id, rank of their kind, ordinal, id, bytes): a running sum of bytes, cut.

    Sums run within chunks of ordinals and over the chunks' totals, so a long act is many tasks.
    """
    chunk = F.floor(F.coalesce("ordinal", F.lit(0)) / CHUNK).alias("chunk")
    rows = rows.withColumn("chunk", chunk)
    keys = ["act_id", "rank", "chunk"]
    totals = rows.groupBy(*keys).agg(F.sum("bytes").alias("total"))
    earlier = Window.partitionBy("act_id").orderBy("rank", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("ordinal"), "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(totals, keys)
    part = F.floor((F.col("base") + F.col("at")) / part_bytes).cast("long")
    return placed.withColumn("part", part).drop("chunk", "bytes", "at", "base")


def _in_parts(heads: DataFrame, children: dict[str, tuple[DataFrame, list[str], list[str], str | None]], part_bytes: int, only_first: tuple[str, ...] = ()) -> DataFrame:
    """Heads with their children as ordered arrays per (act_id, part); a head without children is part 0.

    ``children``: name -> (rows, fields, order, the text column that makes a row's size). All
    kinds go through one union and one aggregate. Arrays in ``only_first`` stay in part 0.
    """
    rows = None
    for rank, (name, (table, fields, order, text)) in enumerate(children.items()):
        size = F.coalesce(F.octet_length(text), F.lit(0)) + 64
        one = table.select("act_id", F.lit(rank).alias("rank"), "ordinal", F.col(order[-1]).alias("id"), size.cast("long").alias("bytes"), F.struct(*[F.col(o) for o in order]).alias(f"k_{name}"), F.struct(*fields).alias(f"v_{name}"))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)

    def array(name: str) -> Column:
        held = F.when(F.col(f"v_{name}").isNotNull(), F.struct(F.col(f"k_{name}").alias("k"), F.col(f"v_{name}").alias("v")))
        return F.transform(F.array_sort(F.collect_list(held)), lambda x: x["v"]).alias(name)

    parts = _in_bytes(rows, part_bytes).groupBy("act_id", "part").agg(*[array(n) for n in children])
    joined = heads.join(parts, "act_id", "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    for name in (*children, *only_first):
        joined = _or_empty(joined, name)
    for name in only_first:
        joined = joined.withColumn(name, F.when(F.col("part") == 0, F.col(name)).otherwise(F.slice(name, 1, 0)))
    return joined


def pending_ai_processing(acts: DataFrame, articles: DataFrame, annexes: DataFrame) -> DataFrame:
    """Acts, articles and annexes not yet completed, with a label that is NULL if a part is."""
    tail = ("ai_status", "ai_processed_at", "ai_error")
    text = lambda c: F.col(c).cast("string")
    of_act = F.concat(F.lit(" din "), F.col("act_type"), F.lit(" "), F.col("act_number"))
    names = acts.select("act_id", "act_type", "act_number")
    act_rows = acts.where(F.col("ai_status").isin(*OPEN)).select(
        F.lit("act").alias("kind"),
        F.col("act_id").alias("id"),
        F.concat("act_type", F.lit(" "), "act_number", F.lit("/"), text("act_year")).alias("label"),
        *tail,
    )
    article_rows = articles.where(F.col("ai_status").isin(*OPEN)).join(names, "act_id").select(
        F.lit("article").alias("kind"),
        F.col("article_id").alias("id"),
        F.concat(F.lit("Art. "), text("article_number"), of_act).alias("label"),
        *tail,
    )
    annex_rows = annexes.where(F.col("ai_status").isin(*OPEN)).join(names, "act_id").select(
        F.lit("annex").alias("kind"),
        F.col("annex_id").alias("id"),
        F.concat(F.lit("Anexa "), F.coalesce(F.col("annex_nr"), text("ordinal")), of_act).alias("label"),
        *tail,
    )
    return act_rows.unionByName(article_rows).unionByName(annex_rows)


def oldest_first(view: DataFrame) -> DataFrame:
    return view.orderBy(F.col("ai_processed_at").asc_nulls_first(), "kind", "id")


def pending_export(acts: DataFrame, articles: DataFrame, annexes: DataFrame, act_issues: DataFrame) -> DataFrame:
    """AI-completed acts whose export is pending or failed, with distinct child counts."""
    ready = acts.where((F.col("ai_status") == "completed") & F.col("export_status").isin("pending", "error"))
    return child_counts(
        ready,
        {"articles": (articles, "article_id"), "annexes": (annexes, "annex_id"), "issues": (act_issues, "issue_id")},
        "act_id",
    )


def issues_of(junction: DataFrame, issues: DataFrame, key: str, *, order: list[str] | None = None) -> DataFrame:
    """(key, issues): each entity's issues as an ordered array.

    Repeated pairs are dropped while collecting, so an array has at most one entry per issue.
    """
    pairs = junction.select(key, "issue_id").join(issues.select(*ISSUE_FIELDS), "issue_id")
    array = _array_of(list(ISSUE_FIELDS), order or ["name", "issue_id"], unique=True)
    return pairs.groupBy(key).agg(array.alias("issues"))


def _or_empty(df: DataFrame, column: str) -> DataFrame:
    kind = df.schema[column].dataType
    return df.withColumn(column, F.coalesce(F.col(column), F.array().cast(kind)))


def articles_with_issues(articles: DataFrame, article_issues: DataFrame, issues: DataFrame) -> DataFrame:
    linked = issues_of(article_issues, issues, "article_id")
    return _or_empty(articles.join(linked, "article_id", "left"), "issues")


def acts_with_categories(acts: DataFrame, act_categories: DataFrame, categories: DataFrame) -> DataFrame:
    """Acts with their active categories ordered by (sort_order, name)."""
    fields = ["category_id", "name", "slug", "color", "icon"]
    active = categories.where(F.col("is_active")).select(*fields, "sort_order")
    pairs = act_categories.select("act_id", "category_id").join(active, "category_id")
    arrays = pairs.groupBy("act_id").agg(_array_of(fields, ["sort_order", "name"], unique=True).alias("categories"))
    columns = ["act_id", "act_type", "act_number", "act_year", "title"]
    return _or_empty(acts.select(*columns).join(arrays, "act_id", "left"), "categories")


def category_names(acts: DataFrame, act_categories: DataFrame, categories: DataFrame) -> DataFrame:
    """Act label and the array of its active categories' names."""
    label = F.concat("act_type", F.lit(" "), "act_number", F.lit("/"), F.col("act_year").cast("string"))
    nested = acts_with_categories(acts, act_categories, categories)
    return nested.select(
        "act_id", label.alias("label"), "title", F.transform("categories", lambda c: c["name"]).alias("categories")
    )


ARTICLE_FIELDS = ["article_id", "article_number", "ordinal", "text", "summary", "remote_id", "issues"]
ANNEX_FIELDS = ["annex_id", "annex_nr", "ordinal", "title", "content", "summary", "remote_id", "issues"]


def export_rows(
    acts: DataFrame, articles: DataFrame, annexes: DataFrame, issues: DataFrame, article_issues: DataFrame, annex_issues: DataFrame
) -> DataFrame:
    """The export package in long form: one row per child of a completed act.

    (act_id, kind, ordinal, id, payload JSON). No row grows with the size of its act.
    """
    done = acts.where(F.col("ai_status") == "completed").select("act_id")
    rows = articles_with_issues(articles.join(done, "act_id", "left_semi"), article_issues, issues)
    article_part = rows.select(
        "act_id",
        F.lit("article").alias("kind"),
        F.col("ordinal").cast("long").alias("ordinal"),
        F.col("article_id").alias("id"),
        F.to_json(F.struct(*ARTICLE_FIELDS), {"ignoreNullFields": "false"}).alias("payload"),
    )
    linked = issues_of(annex_issues, issues, "annex_id")
    rows = _or_empty(annexes.join(done, "act_id", "left_semi").join(linked, "annex_id", "left"), "issues")
    annex_part = rows.select(
        "act_id",
        F.lit("annex").alias("kind"),
        F.col("ordinal").cast("long").alias("ordinal"),
        F.col("annex_id").alias("id"),
        F.to_json(F.struct(*ANNEX_FIELDS), {"ignoreNullFields": "false"}).alias("payload"),
    )
    return article_part.unionByName(annex_part)


def export_package(
    acts: DataFrame,
    articles: DataFrame,
    annexes: DataFrame,
    issues: DataFrame,
    act_issues: DataFrame,
    article_issues: DataFrame,
    annex_issues: DataFrame,
    *,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Completed acts with ordered arrays of articles and annexes (each with issues) and act issues; a row per part."""
    done = acts.where(F.col("ai_status") == "completed")
    keys = done.select("act_id")
    per_article = articles_with_issues(articles.join(keys, "act_id", "left_semi"), article_issues, issues)
    linked = issues_of(annex_issues, issues, "annex_id")
    per_annex = _or_empty(annexes.join(keys, "act_id", "left_semi").join(linked, "annex_id", "left"), "issues")
    per_issues = issues_of(act_issues, issues, "act_id").withColumnRenamed("issues", "act_issues")
    head = done.select("act_id", "act_type", "act_number", "act_year", "title", "summary", "remote_id")
    children = {
        "articles": (per_article, ARTICLE_FIELDS, ["ordinal", "article_id"], "text"),
        "annexes": (per_annex, ANNEX_FIELDS, ["ordinal", "annex_id"], "content"),
    }
    return _in_parts(head.join(per_issues, "act_id", "left"), children, part_bytes, ("act_issues",))


def package_parts(rows: DataFrame, *, part_bytes: int = PART_BYTES) -> DataFrame:
    """Export rows packed into documents (act_id, part, kinds, ids, payloads) of about ``part_bytes`` of payload each."""
    rank = F.when(F.col("kind") == "article", 0).otherwise(1)
    sized = rows.select("act_id", "kind", rank.alias("rank"), "ordinal", "id", F.octet_length("payload").cast("long").alias("bytes"), "payload")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "ordinal", "id", "kind", "payload")))
    packed = _in_bytes(sized, part_bytes).groupBy("act_id", "part").agg(ordered.alias("c"))
    columns = [F.col(f"c.{n}").alias(f"{n}s") for n in ("kind", "id", "payload")]
    return packed.select("act_id", "part", *columns)


def entity_issues(
    act_issues: DataFrame, articles: DataFrame, article_issues: DataFrame, annexes: DataFrame, annex_issues: DataFrame
) -> DataFrame:
    """Distinct (act_id, issue_id) over the act, its articles and its annexes."""
    direct = act_issues.select("act_id", "issue_id")
    by_article = article_issues.join(articles.select("article_id", "act_id"), "article_id").select("act_id", "issue_id")
    by_annex = annex_issues.join(annexes.select("annex_id", "act_id"), "annex_id").select("act_id", "issue_id")
    return direct.unionByName(by_article).unionByName(by_annex).distinct()


def act_package_counts(
    acts: DataFrame, articles: DataFrame, annexes: DataFrame, all_issues: DataFrame
) -> DataFrame:
    """Totals an export package reports per act: articles, annexes, processed ones, distinct issues."""

    def counts(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("act_id").agg(
            F.count("*").alias(f"total_{name}"), F.count_if(F.col("ai_status") == "completed").alias(f"processed_{name}")
        )

    per_issue = all_issues.groupBy("act_id").agg(F.count("*").alias("total_issues"))
    joined = (
        acts.select("act_id")
        .join(counts(articles, "articles"), "act_id", "left")
        .join(counts(annexes, "annexes"), "act_id", "left")
        .join(per_issue, "act_id", "left")
    )
    return joined.na.fill(0)


def _shown(content: str, chars: int | None) -> Column:
    """The whole content, unless a caller asks for its first ``chars`` characters."""
    return F.col(content) if chars is None else F.substring(content, 1, chars)


def act_package(
    acts: DataFrame,
    articles: DataFrame,
    annexes: DataFrame,
    issues: DataFrame,
    act_issues: DataFrame,
    article_issues: DataFrame,
    annex_issues: DataFrame,
    *,
    exported_at=None,
    annex_chars: int | None = None,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The service form of a package: completed children with issue ids, unique issues, totals.

    (act_id, part, package struct). Acts that are completed and not exported yet. Issues are in part 0.
    """
    ready = acts.where((F.col("ai_status") == "completed") & F.col("export_status").isin("pending", "error"))
    keys = ready.select("act_id")
    mine = lambda t: t.join(keys, "act_id", "left_semi")
    own_articles, own_annexes = mine(articles), mine(annexes)

    def ids(junction: DataFrame, key: str) -> DataFrame:
        return junction.groupBy(key).agg(F.array_sort(F.collect_set("issue_id")).alias("issue_ids"))

    done = lambda t: t.where(F.col("ai_status") == "completed")
    per_article = _or_empty(done(own_articles).join(ids(article_issues, "article_id"), "article_id", "left"), "issue_ids")
    per_annex = _or_empty(done(own_annexes).join(ids(annex_issues, "annex_id"), "annex_id", "left"), "issue_ids")
    per_annex = per_annex.withColumn("content", _shown("content", annex_chars))
    all_issues = entity_issues(mine(act_issues), own_articles, article_issues, own_annexes, annex_issues)
    full = all_issues.join(issues, "issue_id")
    per_issues = full.groupBy("act_id").agg(
        _array_of(["issue_id", "name", "description", "source", "confidence"], ["issue_id"]).alias("issues")
    )
    counts = act_package_counts(ready, own_articles, own_annexes, all_issues)
    heads = ready.join(per_issues, "act_id", "left").join(counts, "act_id")
    children = {
        "articles": (per_article, ["article_id", "article_number", "article_label", "text", "summary", "issue_ids"], ["ordinal", "article_id"], "text"),
        "annexes": (per_annex, ["annex_id", "annex_nr", "content", "summary", "issue_ids"], ["ordinal", "annex_id"], "content"),
    }
    packed = _in_parts(heads, children, part_bytes, ("issues",))
    act = F.struct("act_id", "act_number", "act_year", "title", "act_type", "issuer", "act_date", "url", "summary", "created_at")
    totals = F.struct(
        F.lit(exported_at).cast("timestamp").alias("exported_at"),
        "total_articles",
        "processed_articles",
        "total_annexes",
        "processed_annexes",
        "total_issues",
    )
    package = F.struct(act.alias("act"), "articles", "annexes", "issues", totals.alias("metadata"))
    return packed.select("act_id", "part", package.alias("package"))


def update_package(
    acts: DataFrame, articles: DataFrame, annexes: DataFrame, *, annex_chars: int | None = None, part_bytes: int = PART_BYTES
) -> DataFrame:
    """New completed children of exported acts: (act_id, part, remote_id, new_articles, new_annexes)."""
    exported = acts.where(F.col("export_status").isin("exported", "completed") & F.col("remote_id").isNotNull())
    fresh = lambda t: t.where((F.col("ai_status") == "completed") & F.col("remote_id").isNull())
    new_articles, new_annexes = fresh(articles), fresh(annexes)
    chosen = with_children(exported, [new_articles, new_annexes], "act_id").select("act_id", "remote_id")
    keys = chosen.select("act_id")
    own = lambda t: t.join(keys, "act_id", "left_semi")
    children = {
        "new_articles": (own(new_articles), ["article_id", "article_number", "text", "summary"], ["ordinal", "article_id"], "text"),
        "new_annexes": (own(new_annexes).withColumn("content", _shown("content", annex_chars)), ["annex_id", "annex_nr", "content", "summary"], ["ordinal", "annex_id"], "content"),
    }
    return _in_parts(chosen, children, part_bytes)


def export_for_analysis(
    acts: DataFrame, articles: DataFrame, *, include_metadata: bool = True, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Act object (optional), its articles in id order, and label coverage of the act; one row per act and part."""
    fields = [c for c in articles.columns if c not in ("act_id", "created_at", "updated_at")]
    per_act = articles.groupBy("act_id").agg(
        F.count("*").alias("total"), F.count_if(has_labels("issue", "explanation")).alias("analyzed")
    )
    heads = acts.join(per_act, "act_id", "left").na.fill({"total": 0, "analyzed": 0})
    joined = _in_parts(heads, {"articles": (articles, fields, ["article_id"], "text")}, part_bytes)
    percent = F.when(F.col("total") > 0, F.round(F.col("analyzed") * 100.0 / F.col("total"), 2)).otherwise(0.0)
    stats = F.struct("total", "analyzed", percent.alias("coverage_percent")).alias("stats")
    if not include_metadata:
        return joined.select("act_id", "part", "articles", stats)
    known = ("act_id", "act_type", "act_number", "act_year", "act_date", "title", "url", "issuer", "gazette_nr", "gazette_date", "gazette_year")
    return joined.select("act_id", "part", F.struct(*[c for c in known if c in acts.columns]).alias("act"), "articles", stats)


def export_worklist(
    acts: DataFrame, articles: DataFrame, act_issues: DataFrame, which: str, *, limit: int = 50
) -> DataFrame:
    """'pending', 'completed' or 'error' acts with article and issue counts.

    The page of acts is taken first; only its children are counted.
    """
    status = F.col("export_status")
    if which == "pending":
        chosen = acts.where((F.col("ai_status") == "completed") & status.isin("pending", "error"))
        order = [F.col("act_id").desc()]
    elif which == "completed":
        chosen = acts.where(status.isin("exported", "completed"))
        order = [F.col("export_at").desc_nulls_first(), F.col("act_id").desc()]
    else:
        chosen = acts.where(status == "error")
        order = [F.col("act_id").desc()]
    page = chosen.orderBy(*order).limit(limit)
    return child_counts(page, {"articles": (articles, "article_id"), "issues": (act_issues, "issue_id")}, "act_id")


def ai_worklist(articles: DataFrame, article_issues: DataFrame, which: str, *, limit: int = 50) -> DataFrame:
    """'pending' (newest id first) or 'error' (latest attempt first) articles with issue counts."""
    chosen = articles.where(F.col("ai_status") == which)
    order = [F.col("article_id").desc()]
    if which == "error":
        order = [F.col("ai_processed_at").desc_nulls_first(), *order]
    page = chosen.orderBy(*order).limit(limit)
    counted = child_counts(page, {"issues": (article_issues, "issue_id")}, "article_id")
    return counted.withColumn("has_summary", F.coalesce(F.col("summary"), F.lit("")) != "")


