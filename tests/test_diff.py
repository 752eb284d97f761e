import os
import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from actlake.functions.similarity import common_prefix, decided, levenshtein_similarity, character_bound, decision, edge_bound, is_significant, similarity
from actlake.operators.diff import change_log, diff_articles, diff_summary, next_versions, relabel_payload, relabel_queue

SCHEMA = "act_id long, article_id long, ordinal int, article_number string, text string, issue string, explanation string, article_label string"


def frame(spark, rows):
    return spark.createDataFrame([(a, i, o, n, t, f"i{i}", None, None) for a, i, o, n, t in rows], SCHEMA)


def brute(old, new, threshold):
    """The matching written as a plain loop over lists."""

    def last(rows, key):
        out = {}
        for r in sorted(rows, key=lambda r: (r[2] or 0, r[1])):
            if key(r):
                out[key(r)] = r
        return out

    pairs, result = [], set()
    by_old, by_new = last(old, lambda r: (r[0], r[3]) if r[3] else None), last(new, lambda r: (r[0], r[3]) if r[3] else None)
    pairs += [(by_old[k], by_new[k]) for k in by_old if k in by_new]
    done_old, done_new = {p[0][1] for p in pairs}, {p[1][1] for p in pairs}
    rest = lambda rows, done: [r for r in rows if r[1] not in done]
    by_old, by_new = last(rest(old, done_old), lambda r: (r[0], r[2]) if r[2] else None), last(rest(new, done_new), lambda r: (r[0], r[2]) if r[2] else None)
    pairs += [(by_old[k], by_new[k]) for k in by_old if k in by_new]
    for o, n in pairs:
        a, b = o[4] or "", n[4] or ""
        ratio = 0.0 if not a or not b else SequenceMatcher(None, a, b, False).ratio()
        result.add(("modified" if a != b and ratio < threshold else "unchanged", o[1], n[1]))
    used_old, used_new = {p[0][1] for p in pairs}, {p[1][1] for p in pairs}
    result |= {("deleted", r[1], None) for r in old if r[1] not in used_old}
    result |= {("added", None, r[1]) for r in new if r[1] not in used_new}
    return result


OLD = [
    (1, 1, 1, "1", "the text of article one stays"),
    (1, 2, 2, "2", "short change in a fairly long sentence that goes on"),
    (1, 3, 3, "3", "moved"),
    (1, 4, 4, None, "no number, same ordinal"),
    (1, 5, 5, "5", "removed"),
    (1, 6, 6, "6", "shadowed"),
    (1, 7, 7, "6", "duplicate number"),
    (1, 8, 8, "8", None),
    (2, 9, 1, "1", "other act"),
]
NEW = [
    (1, 101, 1, "1", "entirely different words here"),
    (1, 102, 2, "2", "short change in a fairly long sentence that goes on."),
    (1, 103, 9, "3", "moved"),
    (1, 104, 4, "", "no number, same ordinal"),
    (1, 107, 7, "6", "duplicate number"),
    (1, 108, 8, "8", ""),
    (1, 110, 10, "10", "inserted"),
    (3, 111, 1, "1", "new act"),
]


def collected(diff):
    return {(r.change_type, r.old_article_id, r.new_article_id) for r in diff.collect()}


def test_diff_cases(spark):
    old, new = frame(spark, OLD), frame(spark, NEW)
    for threshold in (0.95, 1.0):
        diff = diff_articles(old, new, threshold=threshold)
        assert collected(diff) == brute(OLD, NEW, threshold)
    kinds = {(r.new_article_id or r.old_article_id): r.change_type for r in diff_articles(old, new).collect()}
    assert kinds[101] == "modified" and kinds[102] == "unchanged" and kinds[103] == "unchanged"
    assert kinds[6] == "deleted" and kinds[107] == "unchanged" and kinds[108] == "unchanged" and kinds[110] == "added"


def test_diff_is_a_partition_of_both_sides(spark):
    rng = random.Random(5)
    words = ["lege", "apa", "art", "text", "nou", "vechi"]
    make = lambda base: [
        (a, base + a * 100 + i, rng.randint(1, 12), rng.choice([None, "", str(rng.randint(1, 9))]), " ".join(rng.choices(words, k=8)))
        for a in range(1, 6)
        for i in range(12)
    ]
    old, new = make(0), make(100_000)
    diff = diff_articles(frame(spark, old), frame(spark, new))
    rows = diff.collect()
    assert sorted(r.old_article_id for r in rows if r.old_article_id is not None) == sorted(r[1] for r in old)
    assert sorted(r.new_article_id for r in rows if r.new_article_id is not None) == sorted(r[1] for r in new)
    assert collected(diff) == brute(old, new, 0.95)


def test_summary_versions_and_log(spark):
    diff = diff_articles(frame(spark, OLD), frame(spark, NEW))
    summary = {r.act_id: r for r in diff_summary(diff).collect()}
    assert (summary[1].n_added, summary[1].n_modified, summary[1].n_deleted, summary[1].n_relabel) == (1, 1, 2, 2)
    stored = spark.createDataFrame([(1, 4), (2, 1)], "act_id long, version int")
    versions = {r.act_id: (r.version, r.kind, r.n_articles) for r in next_versions(diff_summary(diff), stored).collect()}
    assert versions == {1: (5, "update_partial", 7), 2: (2, "update_full", 0), 3: (1, "initial", 1)}
    log = change_log(diff)
    assert log.where("change_type = 'unchanged'").count() == 0
    assert log.count() == sum(r.n_changes for r in summary.values())
    queue = relabel_queue(log)
    assert {r.change_type for r in queue.collect()} == {"added", "modified"}
    payload = {r.article_id: r.p for r in queue.select("article_id", relabel_payload(queue).alias("p")).collect()}
    assert '"old"' not in payload[110] and '"old"' in payload[101] and '"new"' in payload[101]


def test_similarity_matches_reference_measure(spark):
    rng = random.Random(3)
    base = "".join(rng.choices("abcde ", k=501))
    pairs = [("", "a"), ("a", ""), (None, "a"), ("abc", "abc"), ("abcd", "bcde"), (base, base[:250] + "x" + base[251:]), (base, base[::-1])]
    df = spark.createDataFrame(pairs, "a string, b string")
    for junk in (False, True):
        got = [r.x for r in df.select(similarity("a", "b", junk).alias("x")).collect()]
        want = [SequenceMatcher(None, a, b, junk).ratio() if a and b else 0.0 for a, b in pairs]
        assert got == want
    significant = [r.x for r in df.select(is_significant("a", "b", 0.95).alias("x")).collect()]
    assert significant == [(a or "") != (b or "") and (SequenceMatcher(None, a or "", b or "", False).ratio() if a and b else 0.0) < 0.95 for a, b in pairs]


def test_first_import_is_not_one_task(spark):
    """Added rows join under their own ids: with an empty old side they still spread."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        new = spark.range(4000).select(
            F.lit(1).cast("long").alias("act_id"), F.col("id").alias("article_id"), F.col("id").cast("int").alias("ordinal"),
            F.col("id").cast("string").alias("article_number"), F.lit("t").alias("text"),
        )
        diff = diff_articles(new.limit(0), new, threshold=1.0, with_similarity=False)
        sizes = [r.n for r in diff.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 4000 and max(sizes) < 1500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_decisions_agree_with_the_ratio(spark):
    chance = random.Random(8)
    pairs = [("", ""), ("", "a"), (None, "a"), ("same", "same"), ("😀" * 50, "😀" * 50 + "é")]
    for _ in range(600):
        a = "".join(chance.choice("abcde ") for _ in range(chance.randrange(0, 160)))
        b = list(a)
        for _ in range(chance.randrange(0, 12)):
            at = chance.randrange(0, len(b) + 1)
            b[at : at + chance.randrange(0, 3)] = chance.choice(["", "x", "abc", " "])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", decision("a", "b").alias("d"), is_significant("a", "b").alias("s"), character_bound("a", "b").alias("high"), edge_bound("a", "b").alias("low")).collect()
    decided = {"similar": 0, "significant": 0, "open": 0}
    for r in rows:
        a, b = r.a or "", r.b or ""
        ratio = SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else float(a == b)
        assert r.s == (ratio < 0.95)
        if a and b:
            assert r.low <= ratio <= r.high
        decided[r.d] += 1
        assert r.d == "open" or (r.d == "significant") == (ratio < 0.95)
    assert min(decided.values()) > 20
    edits = df.select(is_significant("a", "b", measure="edits"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in edits


def test_edits_of_long_texts_are_bounded(spark):
    """Middles, bands and missing blocks decide as whole edit distances do, and reversed long texts need none."""
    chance = random.Random(5)
    words = ["".join(chance.choices("abcdefghijé😀", k=chance.randrange(2, 9))) for _ in range(300)]
    pairs = []
    for n in (0, 1, 30, 300):
        for turn in range(40):
            a = " ".join(chance.choices(words, k=n))
            b = list(a)
            for _ in range(turn * len(a) // 300):
                at = chance.randrange(0, len(b) + 1)
                b[at : at + chance.randrange(0, 2)] = chance.choice(["", "x", " "])
            pairs.append((a, "".join(b) if turn else a[::-1]))
    df = spark.createDataFrame([*pairs, (None, "a"), ("a" * 1000, "b" + "a" * 998)], "a string, b string")
    exact = (F.col("a") != F.col("b")) & (levenshtein_similarity("a", "b") < 0.95)
    found = df.select("a", "b", decision("a", "b").alias("d"), decision("a", "b", plain=True).alias("p"), is_significant("a", "b", measure="edits").alias("s"), exact.alias("e"))
    rows = found.collect()
    assert [r.d for r in rows] == [r.p for r in rows] and {r.d for r in rows} == {"similar", "significant", "open"}
    assert all(r.s == r.e for r in rows if r.d == "open")
    text = " ".join(chance.choices(words, k=30_000))
    far = spark.createDataFrame([(text, text[::-1])], "a string, b string").select(decision("a", "b").alias("d"), is_significant("a", "b", measure="edits").alias("s"))
    began = time.monotonic()
    assert tuple(far.first()) == ("significant", True)
    assert time.monotonic() - began < 20


def edited(chance, a, edits):
    b = list(a)
    for _ in range(edits):
        at = chance.randrange(0, len(b) + 1)
        b[at : at + chance.randrange(0, 3)] = chance.choice(["", "x", "abc", " "])
    return "".join(b)


def test_many_edits_of_a_long_text_take_few_passes(spark):
    """Edits that stand apart need no table of both texts, however long these are."""
    chance = random.Random(3)
    text = " ".join("".join(chance.choices("abcdefghijklou", k=chance.randrange(2, 9))) for _ in range(10_000))
    rows = spark.createDataFrame([(text, text.replace("ou", "u"))], "a string, b string")
    began = time.monotonic()
    row = rows.select(decided("a", "b").alias("d"), is_significant("a", "b", measure="edits").alias("s")).first()
    assert (row.d.decision, row.d.edits, row.s) == ("open", text.count("ou"), False) and row.d.edits > 200
    assert time.monotonic() - began < 15


def test_edits_tell_the_side_of_the_threshold(spark):
    chance = random.Random(11)
    pairs = []
    for n in (1, 3, 12, 40, 41, 100, 300):
        for turn in range(60):
            a = "".join(chance.choices("abcou é😀", k=n))
            pairs.append((a, edited(chance, a, turn * n // 600 + turn % 3)))
            pairs.append((a, a.replace("ou", "u")))
    df = spark.createDataFrame(pairs, "a string, b string")
    for threshold in (0.6, 0.9, 0.95):
        exact = (F.col("a") != F.col("b")) & (levenshtein_similarity("a", "b") < threshold)
        found = df.select("a", "b", decided("a", "b", threshold).alias("d"), decision("a", "b", threshold, plain=True).alias("p"), exact.alias("e"))
        rows = found.selectExpr("*", f"1 - d.edits / greatest(length(a), length(b)) < {threshold} AS s", "levenshtein(a, b) AS n").collect()
        assert all(r.d.decision == r.p for r in rows) and {r.p for r in rows} == {"similar", "significant", "open"}
        assert all(r.s == r.e and r.d.edits >= r.n for r in rows if r.p == "open")
        assert sum(r.d.edits == r.n for r in rows if r.p == "open") > 20


def test_the_edge_bound_is_met_exactly(spark):
    pairs = [("a" * n + "x" * m, "a" * n + "y" * k) for n in range(0, 60, 3) for m in range(4) for k in range(4)]
    df = spark.createDataFrame([*pairs, *[(a[::-1], b[::-1]) for a, b in pairs], (None, "a")], "a string, b string")
    for threshold in (0.5, 0.9, 0.95):
        by_edge = (F.col("a") != F.col("b")) & (F.length("a") > 0) & (F.length("b") > 0) & (edge_bound("a", "b") >= threshold)
        rows = df.select((decision("a", "b", threshold) == "similar").alias("d"), (by_edge | (F.col("a") == F.col("b"))).alias("e"), common_prefix("a", "b").alias("n"), "a", "b").collect()
        assert all(r.d == r.e for r in rows if r.a is not None)
        assert all(r.n == (None if r.a is None else len(os.path.commonprefix([r.a, r.b]))) for r in rows)
