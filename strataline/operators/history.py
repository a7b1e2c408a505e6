"""From raw commits to history rows: skip, classify, explode, enrich."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import columns as C
from strataline.schema import HISTORY, GitConfig


def is_skipped(config: GitConfig = GitConfig()) -> Column:
    """True for commits of bots, with a skipped subject, with several parents, or of lock files only."""
    author = F.lower(F.coalesce("author", F.lit("")))
    bots = [author.contains(b.lower()) for b in config.skip_bot_authors]
    subjects = [F.coalesce("subject", F.lit("")).rlike(f"(?i){p}") for p in config.skip_message_patterns]
    locks = (F.size("files") > 0) & F.forall("files", lambda f: C.is_lock_file(f["path"]))
    return reduce(lambda a, b: a | b, [*bots, *subjects, F.size("parents") > 1, locks])


def kept_commits(raw: DataFrame, config: GitConfig = GitConfig()) -> DataFrame:
    """Commits that are not skipped; if max_commits is set, the newest so many of them, as a log begins with the newest."""
    kept = raw.where(~is_skipped(config))
    return kept.orderBy(F.desc("seq")).limit(config.max_commits) if config.max_commits else kept


def summary_text(files: Column) -> Column:
    head = F.concat(F.lit("Commit by "), F.col("author"), F.lit(" on "), F.col("date"), F.lit(': "'), F.col("subject"), F.lit('"'))
    listed = F.transform(files, lambda f: F.concat(F.lit("  "), f["path"], F.lit(" (+"), f["additions"].cast("string"), F.lit("/-"), f["deletions"].cast("string"), F.lit(")")))
    dirs = F.array_distinct(F.filter(F.transform(files, lambda f: C.dirname(f["path"])), lambda d: d != "."))
    lines = F.concat(
        F.array(head),
        F.when(F.col("body") != "", F.array("body")).otherwise(F.array().cast("array<string>")),
        F.when(F.size(files) > 0, F.concat(F.array(F.lit(""), F.lit("Files changed:")), listed)).otherwise(F.array().cast("array<string>")),
        F.when(F.size(dirs) > 0, F.array(F.concat(F.lit("Directories affected: "), F.array_join(dirs, ", ")))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_join(lines, "\n")


def _sum(files: Column, name: str) -> Column:
    return F.aggregate(files, F.lit(0), lambda s, f: s + F.coalesce(f[name], F.lit(0)))


def chunk_commits(raw: DataFrame, config: GitConfig = GitConfig()) -> DataFrame:
    """History rows of raw commits: one summary each, one diff per file, one group per merge.

    The texts carry no embedding prefix; embedders add theirs. Null nested files count as none.
    """
    empty = F.array().cast("array<struct<path:string,additions:int,deletions:int,status:string>>")
    base = raw.withColumn("files", F.coalesce("files", empty)).withColumn("body", F.coalesce("body", F.lit("")))
    files = F.col("files")
    base = base.select(
        "*", C.to_ts("date").alias("ts"), C.commit_type("subject").alias("commit_type"), C.commit_scope("subject").alias("scope"), C.branch_of("refs", "subject").alias("branch"),
        C.decision_class("subject", F.transform(files, lambda f: f["path"])).alias("decision_class"), _sum(files, "additions").alias("adds"), _sum(files, "deletions").alias("dels"),
    )
    shared = ["sha", "author", "email", "date", "subject", "commit_type", "scope", "branch", "decision_class", "ts", "seq"]

    def row(kind: str, text: Column, path: Column, n: Column, adds: Column, dels: Column, pos: Column, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("chunk_type"), text.alias("text"), path.alias("file_path"), n.cast("int").alias("files_changed"), adds.cast("int").alias("additions"), dels.cast("int").alias("deletions"), pos.cast("int").alias("pos"), body.alias("body"))

    def whole(kind: str, text: Column) -> Column:
        return row(kind, text, F.lit(""), F.size("files"), F.col("adds"), F.col("dels"), F.lit(0), F.col("body"))

    # a commit is read once for all of its rows; the texts of diffs are made when rows are single
    out = F.array(whole("commit_summary", summary_text(files)))
    if config.include_file_chunks:
        patch = lambda f: F.try_element_at("diffs", f["path"])
        out = F.concat(out, F.transform(files, lambda f, i: row("file_diff", patch(f), f["path"], F.lit(1), f["additions"], f["deletions"], i, F.lit(""))))
    if config.include_merge_groups:
        head = F.concat(F.lit("Merge commit by "), F.col("author"), F.lit(" on "), F.col("date"), F.lit(': "'), F.col("subject"), F.lit('"'))
        counts = F.concat(F.lit("Files changed: "), F.size("files").cast("string"), F.lit(" (+"), F.col("adds").cast("string"), F.lit("/-"), F.col("dels").cast("string"), F.lit(")"))
        text = F.concat_ws("\n", head, F.when(F.col("body") != "", F.col("body")), F.concat(F.lit("Parents: "), F.array_join("parents", ", ")), counts)
        merge = F.array(whole("merge_group", text))
        out = F.concat(out, F.when(F.size("parents") > 1, merge).otherwise(F.slice(merge, 1, 0)))
    rows = base.select(*shared, F.explode(out).alias("r")).select(*shared, "r.*")
    diff = C.capped(F.coalesce("text", F.lit("")), config.max_diff_chars_per_file)
    at = F.concat(F.substring("sha", 1, 8), F.lit(" by "), F.col("author"))
    text = F.when(F.col("chunk_type") != "file_diff", F.col("text")).when(diff != "", F.concat(F.lit("Diff for "), F.col("file_path"), F.lit(" in commit "), at, F.lit(":\n"), diff)).otherwise(
        F.concat(F.col("file_path"), F.lit(" changed (+"), F.col("additions").cast("string"), F.lit("/-"), F.col("deletions").cast("string"), F.lit(") in commit "), at)
    )
    rows = rows.withColumns({"text": text, "id": C.short_id(F.col("sha"), F.col("chunk_type"), F.col("file_path"))})
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in HISTORY])


def enrich(history: DataFrame, config: GitConfig = GitConfig()) -> DataFrame:
    """Summaries with a short or empty-worded subject get a text of counts and scope instead of their file list."""
    if not config.enrich_low_quality_messages:
        return history
    low = (F.col("chunk_type") == "commit_summary") & ((F.length("subject") < config.low_quality_threshold) | F.col("subject").rlike(C.LOW_QUALITY))
    scope = C.infer_scope("file_path")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Commit by "), F.col("author"), F.lit(" on "), F.col("date"), F.lit(': "'), F.col("subject"), F.lit('"')),
        F.when(F.col("body") != "", F.col("body")),
        F.concat(F.lit("Files changed: "), F.col("files_changed").cast("string"), F.lit(" ("), F.col("additions").cast("string"), F.lit(" additions, "), F.col("deletions").cast("string"), F.lit(" deletions)")),
        F.when(F.col("file_path") != "", F.concat(F.lit("Primary file: "), F.col("file_path"))),
        F.when(scope != "", F.concat(F.lit("Change scope: "), scope)),
    )
    return history.withColumn("text", F.when(low, text).otherwise(F.col("text")))


def ingest(raw: DataFrame, config: GitConfig = GitConfig()) -> DataFrame:
    """Raw commits to the history rows that are stored."""
    return enrich(chunk_commits(kept_commits(raw, config), config), config)


def summaries(history: DataFrame) -> DataFrame:
    return history.where("chunk_type = 'commit_summary'")


def file_diffs(history: DataFrame) -> DataFrame:
    return history.where("chunk_type = 'file_diff' AND file_path IS NOT NULL AND file_path <> ''")


def latest(history: DataFrame) -> Column:
    """The newest instant of a history as a literal: the clock for reproducible runs."""
    return F.lit(history.agg(F.max("ts")).first()[0])
