import datetime

from pyspark.sql import functions as F

from actlake.operators import search, stats, tables
from actlake.plans.handoff import TEXT_MARK, build_prompts, parse_issue_responses, register_issues
from actlake.plans.views import acts_with_categories, export_package, pending_ai_processing
from actlake.session import ensure_checkpoint_dir
from actlake.operators.search import ordered, page_after
from actlake.streaming.jobs import first_of_each

TS = datetime.datetime(2025, 1, 1)
LOCAL = "category_id long, remote_id int, name string, slug string, description string, color string, icon string, sort_order int, is_active boolean, synced_at timestamp"
REMOTE = "remote_id int, name string, slug string, description string, color string, icon string"


def test_sync_categories(spark):
    old = datetime.datetime(2020, 1, 1)
    local = spark.createDataFrame(
        [(i, r, n, n, None, None, None, 1, a, old) for i, r, n, a in [(1, 0, "none", True), (2, 1, "same", True), (3, 2, "old name", True), (4, 3, "asleep", False), (5, 4, "gone", True), (6, 5, "gone before", False)]],
        LOCAL,
    )
    remote = spark.createDataFrame([(1, "same", "s", None, None, None), (2, "new name", "n", None, None, None), (3, "asleep", "a", None, None, None), (9, "fresh", "f", None, None, None)], REMOTE)
    got = {r.remote_id: (r.action, r.name, r.is_active, r.synced_at) for r in tables.sync_categories(local, remote, ts=TS).collect()}
    assert got == {
        0: ("kept", "none", True, old), 1: ("touched", "same", True, TS), 2: ("updated", "new name", True, TS), 3: ("updated", "asleep", True, TS),
        4: ("deactivated", "gone", False, TS), 5: ("kept", "gone before", False, old), 9: ("created", "fresh", True, TS),
    }
    ids = {r.remote_id: (r.category_id, r.sort_order) for r in tables.sync_categories(local, remote, ts=TS).collect()}
    assert ids[1] == (2, 1) and ids[9][0] is not None and ids[9][1] == 0
    assert ids == {r.remote_id: (r.category_id, r.sort_order) for r in tables.sync_categories(local, remote, ts=TS).collect()}
    nothing = tables.sync_categories(local, remote.limit(0), ts=TS)
    assert {r.action for r in nothing.collect()} == {"kept"}


def test_batch_update_labels(spark):
    articles = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "article_id long, issue string, explanation string")
    updates = spark.createDataFrame(
        [(0, 1, True, "first", False, None), (1, 1, True, None, False, None), (2, 2, False, None, True, "why"), (3, 9, True, "z", True, "z")],
        "seq long, article_id long, has_issue boolean, issue string, has_explanation boolean, explanation string",
    )
    changed, missing, counts = tables.batch_update_labels(articles, updates)
    assert sorted(tuple(r) for r in changed.collect()) == [(1, None, "x"), (2, "b", "why")]
    assert [r.article_id for r in missing.collect()] == [9]
    assert tuple(counts.first()) == (3, 4, 1)


def test_retention(spark):
    names = ["A_1_20250101_000000.csv", "A_1_20250103_000000.csv", "A_1_20250102_000000.csv", "A_1_20250101_000000.md", "B_20250101_000000.csv", "odd.csv"]
    files = spark.createDataFrame([(n, 10) for n in names], "name string, bytes long")
    kept = {r.name: r.keep for r in tables.retain_latest(files).collect()}
    assert kept == {names[0]: False, names[1]: True, names[2]: False, names[4]: True}
    assert {r.name for r in tables.files_to_delete(files).collect()} == {names[0], names[2], names[3]}
    recent = tables.files_to_delete(files, older_than_days=8, as_of=datetime.datetime(2025, 1, 10, 12))
    assert {r.name for r in recent.collect()} == {names[0], names[3]}
    s = tables.storage_stats(files).first()
    assert (s.n_csv, s.n_md, s.total_bytes, s.n_superseded, s.wasted_bytes, s.saving_percent) == (5, 1, 60, 2, 30, 50.0)


def view_tables(spark):
    acts = spark.createDataFrame(
        [(1, "LEGE", "5", 2020, "t", None, None, "completed", None, None), (2, "LEGE", None, 2021, "u", None, None, "pending", None, None)],
        "act_id long, act_type string, act_number string, act_year int, title string, summary string, remote_id int, ai_status string, ai_processed_at timestamp, ai_error string",
    )
    articles = spark.createDataFrame(
        [(10, 1, "1", 1, "x", None, None, "completed", None, None), (11, 1, None, 2, "y", None, None, "pending", TS, None)],
        "article_id long, act_id long, article_number string, ordinal int, text string, summary string, remote_id int, ai_status string, ai_processed_at timestamp, ai_error string",
    )
    annexes = spark.createDataFrame(
        [(20 + i, 1, None, i, "a", f"c{i}", None, None, "completed", None, None) for i in (3, 1, 2)],
        "annex_id long, act_id long, annex_nr string, ordinal int, title string, content string, summary string, remote_id int, ai_status string, ai_processed_at timestamp, ai_error string",
    )
    issues = spark.createDataFrame([(7, "n", "d", 0.5, None)], "issue_id long, name string, description string, confidence double, remote_id int")
    return acts, articles, annexes, issues


def test_package_has_no_fan_out(spark):
    acts, articles, annexes, issues = view_tables(spark)
    pairs = lambda key, rows: spark.createDataFrame(rows, f"{key} long, issue_id long")
    packed = export_package(acts, articles, annexes, issues, pairs("act_id", [(1, 7)]), pairs("article_id", [(10, 7), (10, 7)]), pairs("annex_id", []))
    row = packed.first()
    assert packed.count() == 1
    assert [a.article_id for a in row.articles] == [10, 11] and [a.ordinal for a in row.annexes] == [1, 2, 3]
    assert [len(a.issues) for a in row.articles] == [1, 0] and len(row.act_issues) == 1


def test_long_acts_come_in_parts(spark):
    acts, articles, annexes, issues = view_tables(spark)
    none = lambda key: spark.createDataFrame([], f"{key} long, issue_id long")
    long_act = spark.range(2500).selectExpr("id + 1000 AS article_id", "1L AS act_id", "CAST(id AS INT) AS ordinal", "repeat('é', CAST(id % 7 AS INT) * 10) AS text")
    articles = articles.unionByName(long_act, allowMissingColumns=True)
    linked = spark.createDataFrame([(1, 7)], "act_id long, issue_id long")
    packed = export_package(acts, articles, annexes, issues, linked, none("article_id"), none("annex_id"), part_bytes=5000)
    rows = packed.where("act_id = 1").orderBy("part").collect()
    size = lambda r: sum(64 + len((c["text"] if "text" in c else c["content"] or "").encode()) for c in [*r.articles, *r.annexes])
    sizes = [size(r) for r in rows]
    assert [r.part for r in rows] == list(range(len(rows))) and len(rows) > 50
    assert max(sizes) < 5000 + 64 + 140 and sum(sizes[:-1]) > 4800 * (len(rows) - 1)
    every = [a.ordinal for r in rows for a in r.articles]
    assert every == sorted(every) and len(every) == articles.where("act_id = 1").count()
    assert [a.ordinal for r in rows for a in r.annexes] == [1, 2, 3]
    assert [len(r.act_issues) for r in rows] == [1] + [0] * (len(rows) - 1)


def test_pending_labels_are_null_if_a_part_is(spark):
    acts, articles, annexes, _ = view_tables(spark)
    rows = {(r.kind, r.id): r.label for r in pending_ai_processing(acts, articles, annexes).collect()}
    assert rows == {("act", 2): None, ("article", 11): None}


def test_acts_without_categories(spark):
    acts = view_tables(spark)[0]
    categories = spark.createDataFrame([(1, "a", "a", None, None, 2, True), (2, "b", "b", None, None, 1, True), (3, "c", "c", None, None, 0, False)], "category_id long, name string, slug string, color string, icon string, sort_order int, is_active boolean")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 1)], "act_id long, category_id long")
    got = {r.act_id: [c.name for c in r.categories] for r in acts_with_categories(acts, pairs, categories).collect()}
    assert got == {1: ["b", "a"], 2: []}


def test_issue_answers(spark):
    bodies = ['{"issues":[{"title":"' + "x" * 300 + '"},{"description":"d","confidence":0.5}]}', "no json", '{"issues":[]}', '{"issues":[{"title":"n"},{"title":"fresh"},{"title":"fresh","description":"later"}]}']
    responses = spark.createDataFrame(list(enumerate(bodies)), "article_id long, body string")
    rows = parse_issue_responses(responses).orderBy("article_id", "pos").collect()
    assert [(r.article_id, len(r.name), r.description, r.confidence) for r in rows[:2]] == [(0, 256, "", 0.8), (0, 0, "d", 0.5)]
    assert len(rows) == 5
    issues = view_tables(spark)[3]
    links = spark.createDataFrame([(3, 7)], "article_id long, issue_id long")
    every, linked = register_issues(issues, parse_issue_responses(responses.where("article_id = 3")), links)
    assert sorted((r.name, r.description) for r in every.collect()) == [("fresh", ""), ("n", "d")]
    assert linked.count() == 2


def test_hot_key_statistics(spark):
    """One act and one title hold most rows; the counts are exact."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") + 100).alias("act_id"), F.lit("topic").alias("issue"), F.lit(None).cast("string").alias("explanation"))
    got = stats.label_coverage(rows).where("act_id = 1").first()
    assert (got.n_articles, got.n_labelled, got.coverage) == (20_000, 20_000, 100.0)


def test_checkpoint_dir_is_respected(spark):
    first = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == first == spark.sparkContext.getCheckpointDir()


def test_first_of_each_bounds_its_state(spark):
    stream = spark.readStream.format("rate").load().withColumnRenamed("timestamp", "ts")
    plan = first_of_each(stream, ["value"])._jdf.queryExecution().analyzed().toString()
    assert "WithinWatermark" in plan and "EventTimeWatermark" in plan


def test_table_audit(spark):
    spark.range(1).createOrReplaceTempView("acts_for_audit")
    rows = {r.table_name: r.present for r in stats.table_audit(spark, ("acts_for_audit", "missing_table")).collect()}
    assert rows == {"acts_for_audit": True, "missing_table": False}


def test_pages_by_key(spark):
    rows = [(i, (None, "a", "b")[i % 3], None if i % 4 == 0 else i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, name string, rank int")
    for keys in (("name", "-rank", "id"), ("<name", "rank", "-id"), ("-name", "<rank", "id")):
        want = [r.id for r in ordered(df, *keys).collect()]
        got, after = [], None
        while page := page_after(df, *keys, after=after, limit=7).collect():
            got += [r.id for r in page]
            after = page[-1]
        assert got == want


def test_large_pages_are_not_gathered_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(search, "ONE_TASK", 3)
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7) for i in range(50)], "id long, v long").repartition(4)
    for keys in (("v", "-id"), ("-v", "id"), ("<v", "id")):
        want, got, after = [r.id for r in ordered(df, *keys).collect()], [], None
        while page := ordered(found := page_after(df, *keys, after=after, limit=12, max_limit=12), *keys).collect():
            assert "Limit" not in found._jdf.queryExecution().executedPlan().toString()
            assert len(page) == min(12, 50 - len(got))
            got, after = got + [r.id for r in page], page[-1]
        assert got == want


def test_pairs_are_grouped_after_they_are_dealt(spark):
    """No task keeps the groups of a whole file: below the shuffles nothing is aggregated."""
    pairs, wanted = (spark.range(40).selectExpr(f"id % {n} AS act_id", "id % 3 AS category_id") for n in (4, 9))
    after, counts = tables.link_pairs(pairs, wanted, ("act_id", "category_id"))
    assert after.count() == 40 + 5 and [tuple(r) for r in counts.collect()] == [(5, 35)]
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    for below in plan.split("REPARTITION_BY_NUM")[1:]:
        assert below.lstrip().splitlines()[1].count("Aggregate") == 0


def test_cascade_joins_only_named_rows(spark):
    """Rows that vanish meet the table's distinct values first, and only what both have is joined to its rows."""
    acts = spark.range(20).selectExpr("id AS act_id")
    articles = spark.range(200).selectExpr("id % 20 AS act_id", "id AS article_id")
    changes = spark.range(1000).selectExpr("id % 30 AS act_id", "CASE WHEN id % 7 > 0 THEN id % 3 END AS article_id")
    left = tables.delete_cascade({"acts": acts, "changes": changes}, acts.where("act_id = 1"), set_null={"changes": ("article_id", articles)})["changes"]
    rows = [(r.act_id, r.article_id) for r in left.collect()]
    want = [(i % 30, i % 3 if i % 7 and i % 3 != 1 else None) for i in range(1000) if i % 30 != 1]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert "LeftSemi" in left._jdf.queryExecution().optimizedPlan().toString().partition("LeftOuter")[2]


def test_prompts_are_cut_before_the_join(spark):
    articles = spark.createDataFrame([(1, 1, "abcdefghij" * 2 + "k"), (2, 1, None), (3, 1, "")], "article_id long, act_id long, text string")
    acts = spark.createDataFrame([(1, "LEGE", "7", 2024)], "act_id long, act_type string, act_number string, act_year int")
    prompts = build_prompts(articles, acts, piece_chars=10)
    shown = {(r.article_id, r.piece): r.issue_prompt.partition(TEXT_MARK)[2].partition("\n\n")[0] for r in prompts.collect()}
    assert shown == {(1, 0): "abcdefghij", (1, 1): "abcdefghij", (1, 2): "k", (2, 0): "", (3, 0): ""}
    # what stands above the join no longer cuts a text
    above = prompts._jdf.queryExecution().optimizedPlan().toString().partition("Join")[0]
    assert "substring(" not in above
