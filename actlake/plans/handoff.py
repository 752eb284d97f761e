"""Tables before and after a labelling service: prompts out, answers in, status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_column
from ..operators.tables import link_pairs, partial_update

# --- instructions sent with a text; only the field names are fixed, the answers are parsed by them ---
ISSUE_TASK = "Below is a passage of a Romanian legal act. Name the matters a compliance officer would want to know."
ISSUE_INSTRUCTIONS = """Answer with one JSON object and nothing else. Its field "issues" is a list; every entry has the fields
"title" (a short name), "description" (what it is about, in one or two sentences) and "confidence" (a number from 0 to 1).
Duties, permissions, prohibitions, sanctions, time limits and unclear wording all count as matters."""
SUMMARY_TASK = "Below is a passage of a Romanian legal act. Restate it briefly, in Romanian, for readers without legal training."
SUMMARY_INSTRUCTIONS = """Stay below {max_length} characters and within what the passage says. Put duties, rights and limits first."""
TEXT_MARK = "Passage:\n"
PIECE_CHARS = 4000  # what the service takes at once
ISSUE_SCHEMA = "issues array<struct<title: string, description: string, confidence: double>>"


def act_context(act_type="act_type", number="act_number", year="act_year") -> Column:
    """``TYPE nr/year``."""
    return F.concat_ws("", as_column(act_type), F.lit(" "), as_column(number), F.lit("/"), as_column(year).cast("string"))


def _prompt(task: str, text: Column, context: Column, instructions: str) -> Column:
    shown = F.concat(F.lit("Context: "), context)
    return F.concat_ws(
        "\n\n",
        F.lit(task),
        shown,
        F.concat(F.lit(TEXT_MARK), text),
        F.lit(instructions),
    )


def build_prompts(
    articles: DataFrame, acts: DataFrame, *, text: str = "text", max_length: int = 500, piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """(article_id, piece, issue_prompt, summary_prompt). Long texts are sent in pieces, numbered from 0; none is cut off."""
    pieces = F.greatest(F.ceil(F.char_length(text) / piece_chars), F.lit(1)).cast("int")
    # cut before the join, so that a row holds its piece and not the whole text once more
    numbers = F.sequence(F.lit(0), F.coalesce(pieces, F.lit(1)) - 1)
    cut = F.transform(numbers, lambda n: F.substring(F.col(text), n * piece_chars + 1, F.lit(piece_chars)))
    joined = articles.select("article_id", "act_id", F.posexplode(cut).alias("piece", "part")).join(
        acts.select("act_id", act_context().alias("context")), "act_id"
    )
    part = F.col("part")
    return joined.select(
        "article_id",
        "piece",
        _prompt(ISSUE_TASK, part, F.col("context"), ISSUE_INSTRUCTIONS).alias("issue_prompt"),
        _prompt(SUMMARY_TASK, part, F.col("context"), SUMMARY_INSTRUCTIONS.format(max_length=max_length)).alias("summary_prompt"),
    )


def parse_issue_responses(
    responses: DataFrame,
    *,
    key: str = "article_id",
    body: str = "body",
    schema: str = ISSUE_SCHEMA,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per issue in the answers: (key, kept columns, pos, name, description, confidence).

    Title cut to 256 characters, missing values defaulted; an answer that is no JSON gives none.
    """
    parsed = responses.select(key, *keep, F.from_json(body, schema).alias("p"))
    long = parsed.select(key, *keep, F.posexplode("p.issues").alias("pos", "i"))
    return long.select(
        key,
        *keep,
        "pos",
        F.substring(F.coalesce("i.title", F.lit("")), 1, 256).alias("name"),
        F.coalesce("i.description", F.lit("")).alias("description"),
        F.coalesce("i.confidence", F.lit(0.8)).alias("confidence"),
    )


def register_issues(
    issues: DataFrame, extracted: DataFrame, links: DataFrame, *, key: str = "article_id"
) -> tuple[DataFrame, DataFrame]:
    """(issues, links) after adding extracted issues by title.

    Of several with one title, the first (by key, then position) gives description and
    score. Ids of new issues are hashes of the title, so a rerun gives the same ones.
    One aggregate per title with map-side combine; a title a third of all answers carry
    costs one partial row per task.
    """
    first = F.min_by(F.struct("description", "confidence"), F.struct(key, "pos")).alias("first")
    by_title = extracted.groupBy("name").agg(first)
    fresh = by_title.join(issues.select("name").distinct(), "name", "left_anti")
    columns = {
        "issue_id": F.xxhash64("name"),
        "name": F.col("name"),
        "description": F.col("first.description"),
        "source": F.lit("ai"),
        "confidence": F.round("first.confidence", 2),
    }
    added = fresh.select(*[c.cast(issues.schema[n].dataType).alias(n) for n, c in columns.items() if n in issues.columns])
    every = issues.unionByName(added, allowMissingColumns=True)
    pairs = extracted.select(key, "name").distinct().join(every.select("issue_id", "name"), "name").select(key, "issue_id")
    return every, link_pairs(links, pairs, (key, "issue_id"))[0]


def apply_ai_results(entities: DataFrame, results: DataFrame, *, key: str = "article_id", ts=None) -> DataFrame:
    """``results``: key, error, summary. No error -> completed; else error, message cut to 500."""
    ok = F.col("error").isNull()
    patch = results.select(
        key,
        F.when(ok, "completed").otherwise("error").alias("ai_status"),
        F.lit(True).alias("has_ai_status"),
        F.when(ok, F.lit(ts).cast("timestamp")).alias("ai_processed_at"),
        ok.alias("has_ai_processed_at"),
        F.substring("error", 1, 500).alias("ai_error"),
        F.lit(True).alias("has_ai_error"),
        F.col("summary"),
        ok.alias("has_summary"),
    )
    return partial_update(entities, patch, key)


def reset_status(entities: DataFrame, ids: DataFrame, *, key: str = "article_id") -> DataFrame:
    patch = ids.select(key).distinct().select(
        key,
        F.lit("pending").alias("ai_status"),
        F.lit(None).cast("string").alias("ai_error"),
        F.lit(True).alias("has_ai_error"),
        F.lit(None).cast("timestamp").alias("ai_processed_at"),
        F.lit(True).alias("has_ai_processed_at"),
    )
    return partial_update(entities, patch, key)


def links_lifecycle(events: DataFrame, *, key: str = "link_id", at: str = "ts") -> DataFrame:
    """Current state per link from its events: latest status, its act count, its error cut to 500.

    `max_by` keeps one row per link and task, however many events a link has.
    """
    last = F.max_by(F.struct("status", "act_count", "error"), F.struct(F.col(at), F.col("event_id"))).alias("last")
    state = events.groupBy(key).agg(last, F.min(at).alias("created_at"), F.max(at).alias("updated_at"))
    return state.select(
        key,
        "last.status",
        "last.act_count",
        F.substring("last.error", 1, 500).alias("error"),
        "created_at",
        "updated_at",
    )
