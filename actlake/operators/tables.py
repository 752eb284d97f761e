"""Changes to tables, as new contents computed from old ones.

Parquet tables have no UPDATE, so each operator returns the table after the change (and
where useful the rows rejected or counted). Writing it back is the caller's step: with
`spark.sql.sources.partitionOverwriteMode=dynamic` only touched partitions are replaced.
Key sets are reduced to distinct keys before they join, so that repeated requests for
one key do not multiply rows or pile up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_result_filename
from .singles import beside, single


def upsert(
    target: DataFrame,
    source: DataFrame,
    key: str | list[str],
    *,
    keep: tuple[str, ...] = ("act_id", "created_at"),
    version: str | None = "version",
    touched: str | None = None,
    ts=None,
) -> DataFrame:
    """Matching rows take every source value except ``keep`` columns; others are inserted with version 1.

    ``source`` must have one row per key. A matched row's version grows by one.
    """
    keys = [key] if isinstance(key, str) else list(key)
    marked_t = target.withColumn("_t", F.lit(True)).alias("t")
    marked_s = source.withColumn("_s", F.lit(True)).alias("s")
    joined = marked_t.join(marked_s, keys, "full")
    in_both = F.col("_t").isNotNull() & F.col("_s").isNotNull()
    columns = []
    for name in target.columns:
        if name in keys:
            columns.append(F.col(name))
        elif name == version:
            columns.append(
                F.when(in_both, F.col(f"t.{name}") + 1)
                .when(F.col("_t").isNotNull(), F.col(f"t.{name}"))
                .otherwise(1)
                .cast(target.schema[name].dataType)
                .alias(name)
            )
        elif touched and name == touched:
            columns.append(F.when(F.col("_s").isNotNull(), F.lit(ts)).otherwise(F.col(f"t.{name}")).alias(name))
        elif name not in source.columns:
            columns.append(F.col(f"t.{name}"))
        elif name in keep:
            columns.append(F.coalesce(f"t.{name}", f"s.{name}").alias(name))
        else:
            columns.append(F.when(F.col("_s").isNotNull(), F.col(f"s.{name}")).otherwise(F.col(f"t.{name}")).alias(name))
    return joined.select(*columns)


def insert_if_absent(target: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(inserted, rejected): rows whose key the target does not, or does, hold already."""
    held = target.select(key).distinct()
    return rows.join(held, key, "left_anti"), rows.join(held, key, "left_semi")


def partial_update(target: DataFrame, patch: DataFrame, key: str, *, touched: str | None = None, ts=None) -> DataFrame:
    """Set only the fields a patch row provides.

    A patch column ``c`` counts as provided where ``has_c`` is true, or, without a
    ``has_c`` column, where it is not NULL. One patch row per key.
    """
    names = [c for c in patch.columns if c in target.columns and c != key]
    joined = target.alias("t").join(patch.withColumn("_hit", F.lit(True)).alias("p"), key, "left")
    columns = []
    for name in target.columns:
        if name in names:
            given = F.col(f"p.has_{name}") if f"has_{name}" in patch.columns else F.col(f"p.{name}").isNotNull()
            columns.append(
                F.when(F.coalesce(given, F.lit(False)), F.col(f"p.{name}")).otherwise(F.col(f"t.{name}")).alias(name)
            )
        elif touched and name == touched:
            columns.append(F.when(F.col("_hit"), F.lit(ts)).otherwise(F.col(f"t.{name}")).alias(name))
        else:
            columns.append(F.col(name) if name == key else F.col(f"t.{name}"))
    return joined.select(*columns)


def batch_update_labels(
    articles: DataFrame, updates: DataFrame, *, key: str = "article_id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, missing ids, counts). A later update of one article wins over an earlier one.

    ``updates``: key, seq, has_issue, issue, has_explanation, explanation.
    """

    def last(field: str) -> Column:
        given = F.col(f"has_{field}")
        return F.max_by(F.when(given, F.col(field)), F.when(given, F.col("seq"))).alias(field)

    patch = updates.groupBy(key).agg(
        last("issue"),
        F.max("has_issue").alias("has_issue"),
        last("explanation"),
        F.max("has_explanation").alias("has_explanation"),
    )
    known = articles.select(key).distinct()
    missing = updates.join(known, key, "left_anti").select(key)
    total = updates.agg(F.count("*").alias("total"))
    n_missing = missing.agg(F.count("*").alias("n_missing"))
    counts = beside(total, n_missing).select((F.col("total") - F.col("n_missing")).alias("updated"), "total", "n_missing")
    return partial_update(articles, patch, key), missing, counts


def update_labels(articles: DataFrame, updates: DataFrame, *, key: str = "article_id") -> DataFrame:
    """Overwrite both label columns, NULL included, for the listed articles."""
    patch = updates.select(
        key, "issue", "explanation", F.lit(True).alias("has_issue"), F.lit(True).alias("has_explanation")
    )
    return partial_update(articles, patch, key)


def delete_rows(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def delete_cascade(
    tables: dict[str, DataFrame], ids: DataFrame, *, key: str = "act_id", set_null: dict[str, tuple[str, DataFrame]] | None = None
) -> dict[str, DataFrame]:
    """Remove acts from every table that holds their key.

    ``set_null`` maps a table to (column, rows that vanish): the column becomes NULL where
    it names a vanished row, as change rows do with their article.
    """
    gone = ids.select(key).distinct()
    result = {name: table.join(gone, key, "left_anti") for name, table in tables.items()}
    for name, (column, vanished) in (set_null or {}).items():
        source = result.get(name)
        lost = vanished.join(gone, key, "left_semi").select(F.col(column).alias("_lost")).distinct()
        # of vanished rows only those that the table names, so that a key very many rows share meets a small table
        lost = lost.join(source.select(F.col(column).alias("_lost")).distinct(), "_lost", "left_semi")
        joined = source.join(lost, source[column] == F.col("_lost"), "left")
        result[name] = joined.withColumn(column, F.when(F.col("_lost").isNull(), F.col(column))).drop("_lost")
    return result


def replace_children(children: DataFrame, new: DataFrame, key: str = "act_id") -> DataFrame:
    """Drop the old children of every parent that has new ones, and add the new ones."""
    parents = new.select(key).distinct()
    return children.join(parents, key, "left_anti").unionByName(new.select(*children.columns))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` before they are grouped by them.

    A file read in few tasks may hold more groups than a task can keep; where keys hardly repeat, grouping
    before the shuffle saves nothing either.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def link_pairs(pairs: DataFrame, requested: DataFrame, keys: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(pairs after the change, counts of added and skipped requests)."""
    a, b = keys
    wanted = dealt(requested, a, b).groupBy(a, b).agg(F.count("*").alias("_n"))
    held = dealt(pairs.select(a, b), a, b).distinct().withColumn("_held", F.lit(True))
    marked = wanted.join(held, [a, b], "left")
    fresh = marked.where(F.col("_held").isNull())
    added = F.count_if(F.col("_held").isNull())
    counts = marked.agg(added.alias("added"), (F.coalesce(F.sum("_n"), F.lit(0)) - added).alias("skipped"))
    return pairs.unionByName(fresh.select(a, b), allowMissingColumns=True), counts


def unlink_pairs(pairs: DataFrame, requested: DataFrame, keys: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(pairs after the change, count of removed pairs)."""
    a, b = keys
    wanted = requested.select(a, b).distinct()
    removed = pairs.join(wanted, [a, b], "left_semi").agg(F.count("*").alias("removed"))
    return pairs.join(wanted, [a, b], "left_anti"), removed


def replace_pairs(
    pairs: DataFrame, requested: DataFrame, categories: DataFrame, *, act: str = "act_id", category: str = "category_id"
) -> DataFrame:
    """For acts named in ``requested``: drop pairs with active categories, then add the requested ones."""
    acts = requested.select(act).distinct()
    active = categories.where(F.col("is_active")).select(category)
    current = pairs.join(active, category, "left_semi").join(acts, act, "left_semi").select(act, category)
    kept = pairs.join(current.distinct(), [act, category], "left_anti")
    wanted = requested.where(F.col(category).isNotNull())
    return link_pairs(kept, wanted, (act, category))[0]


def sync_categories(local: DataFrame, remote: DataFrame, *, ts=None) -> DataFrame:
    """The local table after a sync, with the ``action`` taken on each row.

    Actions: created, updated (a value differs or the row was inactive), touched,
    deactivated (gone remotely, except remote id 0), kept. An empty feed deactivates nothing.
    """
    compared = ("name", "description", "color", "icon")
    l, r = local.alias("l"), remote.withColumn("_r", F.lit(True)).alias("r")
    has_feed = single(remote.agg(F.count("*") > 0))
    joined = l.join(r, "remote_id", "full").withColumn("_has_feed", has_feed)
    same = F.col("l.is_active")
    for name in compared:
        same = same & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    here, there = F.col("l.name").isNotNull(), F.col("_r").isNotNull()
    action = (
        F.when(there & ~here, "created")
        .when(there & ~F.coalesce(same, F.lit(False)), "updated")
        .when(there, "touched")
        .when(F.coalesce(F.col("l.is_active"), F.lit(False)) & (F.col("remote_id") != 0) & F.col("_has_feed"), "deactivated")
        .otherwise("kept")
    )
    joined = joined.withColumn("action", action)
    written = F.col("action").isin("created", "updated")
    columns = [F.col("remote_id")]
    for name in local.columns:
        if name == "remote_id":
            continue
        if name in (*compared, "slug"):
            columns.append(F.when(written, F.col(f"r.{name}")).otherwise(F.col(f"l.{name}")).alias(name))
        elif name == "is_active":
            columns.append(
                F.when(F.col("action") == "deactivated", False).when(there, True).otherwise(F.col("l.is_active")).alias(name)
            )
        elif name == "synced_at":
            columns.append(F.when(F.col("action") != "kept", F.lit(ts).cast("timestamp")).otherwise(F.col("l.synced_at")).alias(name))
        elif name == "category_id":
            # a created row's id comes from its remote id, so a repeated sync gives it again
            fresh = F.xxhash64("remote_id").cast(local.schema[name].dataType)
            columns.append(F.when(F.col("action") == "created", fresh).otherwise(F.col(f"l.{name}")).alias(name))
        elif name == "sort_order":
            columns.append(F.when(F.col("action") == "created", F.lit(0).cast(local.schema[name].dataType)).otherwise(F.col(f"l.{name}")).alias(name))
        elif name == "created_at":
            columns.append(F.when(F.col("action") == "created", F.lit(ts).cast("timestamp")).otherwise(F.col(f"l.{name}")).alias(name))
        else:
            columns.append(F.col(f"l.{name}"))
    return joined.select(*columns, "action")


def sync_act_categories(
    pairs: DataFrame, requested: DataFrame, categories: DataFrame, *, act: str = "act_id"
) -> tuple[DataFrame, DataFrame]:
    """Map arrays of remote ids to active local categories and link them.

    Returns (pairs, matched count per act); ids that match nothing are ignored.
    """
    ids = requested.select(act, F.explode("remote_ids").alias("remote_id"))
    active = categories.where(F.col("is_active")).select("remote_id", "category_id")
    matched = ids.join(active, "remote_id").select(act, "category_id")
    counts = matched.groupBy(act).agg(F.count("*").alias("n_matched"))
    counts = requested.select(act).distinct().join(counts, act, "left").na.fill({"n_matched": 0})
    return link_pairs(pairs, matched, (act, "category_id"))[0], counts


def backfill(df: DataFrame, target: str = "summary", source: str = "explanation") -> DataFrame:
    return df.withColumn(target, F.coalesce(target, source))


def touch(df: DataFrame, changed: Column, ts, *, column: str = "updated_at") -> DataFrame:
    return df.withColumn(column, F.when(changed, F.lit(ts)).otherwise(F.col(column)))


# ---------------------------------------------------------------- export answers


def apply_export_responses(acts: DataFrame, responses: DataFrame, *, ts=None, act: str = "act_id") -> DataFrame:
    """Acts after their export: 200, 201 and 409 are exported with a remote id, the rest are errors.

    ``responses``: act, status_code, body (JSON), error (when there was no answer).
    """
    body = F.from_json("body", "id string, legislation_id string, existing_id string")
    answered = responses.select(
        act,
        F.col("status_code").isin(200, 201, 409).alias("_ok"),
        F.when(F.col("status_code") == 409, body["existing_id"])
        .otherwise(F.coalesce(F.nullif(body["id"], F.lit("")), body["legislation_id"]))
        .alias("_remote"),
        F.coalesce(
            "error",
            F.concat(
                F.when(F.col("status_code") >= 500, "Server error ").otherwise("API error "),
                F.col("status_code").cast("string"),
                F.lit(": "),
                F.substring(F.coalesce("body", F.lit("")), 1, 200),
            ),
        ).alias("_error"),
    )
    joined = acts.join(answered.withColumn("_hit", F.lit(True)), act, "left")
    ok, hit = F.coalesce(F.col("_ok"), F.lit(False)), F.coalesce(F.col("_hit"), F.lit(False))
    return joined.withColumns(
        {
            "export_status": F.when(hit & ok, "exported").when(hit, "error").otherwise(F.col("export_status")),
            "export_at": F.when(hit & ok, F.lit(ts).cast("timestamp")).otherwise(F.col("export_at")),
            "export_error": F.when(hit & ok, F.lit(None)).when(hit, F.col("_error")).otherwise(F.col("export_error")),
            "remote_id": F.when(hit & ok, F.col("_remote").try_cast("int")).otherwise(F.col("remote_id")),
        }
    ).select(*acts.columns)


def mark_children_exported(children: DataFrame, acts: DataFrame, *, act: str = "act_id", only_new: bool = False) -> DataFrame:
    """Completed children take their act's remote id; ``only_new`` leaves ids already set."""
    ids = acts.select(act, F.col("remote_id").alias("_remote")).where(F.col("_remote").isNotNull())
    joined = children.join(ids, act, "left")
    target = (F.col("ai_status") == "completed") & F.col("_remote").isNotNull()
    if only_new:
        target = target & F.col("remote_id").isNull()
    value = F.when(F.coalesce(target, F.lit(False)), F.col("_remote")).otherwise(F.col("remote_id"))
    return joined.withColumn("remote_id", value).select(*children.columns)


def apply_update_responses(children: DataFrame, acts: DataFrame, responses: DataFrame, *, act: str = "act_id") -> DataFrame:
    """After an update was accepted (200 or 204), its new children take the act's remote id."""
    accepted = responses.where(F.col("status_code").isin(200, 204)).select(act).distinct()
    return mark_children_exported(children, acts.join(accepted, act, "left_semi"), act=act, only_new=True)


# ---------------------------------------------------------------- result files


def retain_latest(files: DataFrame, *, name: str = "name", as_of=None) -> DataFrame:
    """Every parsed CSV with keep = newest of its act, and its age in days.

    The newest file per act is a map-side maximum that is joined back, not a sort of all
    files of an act.
    """
    # unnested with inline, so that the filter after it does not make Spark parse names twice
    parsed = files.where(F.col(name).endswith(".csv")).select("*", F.inline(F.array(parse_result_filename(name))))
    parsed = parsed.where(F.col("act").isNotNull())
    newest = parsed.groupBy("act").agg(F.max(F.struct("ts", name)).alias("_newest"))
    joined = parsed.join(newest, "act").withColumn("keep", F.struct("ts", name) == F.col("_newest")).drop("_newest")
    if as_of is not None:
        joined = joined.withColumn("age_days", F.floor((F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("ts")) / 86400).cast("int"))
    return joined


def files_to_delete(files: DataFrame, *, name: str = "name", older_than_days: int | None = None, as_of=None) -> DataFrame:
    """Superseded CSV files and their Markdown sidecars, as a list; nothing is deleted here."""
    old = retain_latest(files, name=name, as_of=as_of).where(~F.col("keep"))
    if older_than_days is not None:
        old = old.where(F.col("age_days") > older_than_days)
    stems = old.select(F.regexp_replace(name, r"\.csv$", "").alias("_stem"))
    sidecars = files.withColumn("_stem", F.regexp_extract(name, r"^(.*)\.md$", 1)).join(stems, "_stem", "left_semi")
    return old.select(name).unionByName(sidecars.select(name))


def storage_stats(files: DataFrame, *, name: str = "name", size: str = "bytes") -> DataFrame:
    """One row: files by extension, bytes, mean, superseded files and the bytes they hold."""
    csv, md = F.col(name).endswith(".csv"), F.col(name).endswith(".md")
    all_files = files.where(csv | md)
    old = retain_latest(files, name=name).where(~F.col("keep"))
    stem = F.regexp_replace(name, r"\.(csv|md)$", "")
    superseded = old.select(F.regexp_replace(name, r"\.csv$", "").alias("_stem"))
    # a superseded table and its sidecar share their stem, so one join finds both
    wasted = all_files.withColumn("_stem", stem).join(superseded, "_stem", "left_semi").agg(
        F.count_if(csv).alias("n_superseded"), F.coalesce(F.sum(size), F.lit(0)).alias("wasted_bytes")
    )
    totals = all_files.agg(
        F.count_if(csv).alias("n_csv"),
        F.count_if(md).alias("n_md"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
        F.round(F.avg(size), 2).alias("mean_bytes"),
    )
    joined = beside(totals, wasted)
    percent = F.round(F.col("wasted_bytes") * 100.0 / F.col("total_bytes"), 1)
    return joined.withColumn("saving_percent", F.when(F.col("total_bytes") > 0, percent).otherwise(0.0))
