"""Reverts, matched to the commit that they undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import columns as C
from strataline.operators.history import summaries
from strataline.operators.signals.common import among, commit_files, signal_rows
from strataline.schema import SignalsConfig
from strataline.sources.scratch import materialized

# Fixed values.
SHA_IN_TEXT = r"(?i)reverts?\s+commit\s+([0-9a-f]{7,40})"
QUOTED_SUBJECT = r'[Rr]evert\s+"([^"]+)"'


def matches(history: DataFrame, slices: int = 1) -> DataFrame:
    """One row per revert: sha, original (null if unknown) and how it was found (sha, prefix or subject).

    Repeated shas, 7-character prefixes and subjects stand for their last commit in log order.
    """
    told = summaries(history)
    text = F.concat(F.col("subject"), F.lit(" "), F.coalesce("body", F.lit("")))
    reverts = told.where(F.lower("subject").contains("revert")).select(
        "sha", "subject", F.nullif(F.regexp_extract(text, SHA_IN_TEXT, 1), F.lit("")).alias("named"), F.nullif(F.regexp_extract("subject", QUOTED_SUBJECT, 1), F.lit("")).alias("quoted")
    )
    by_sha = told.select(F.col("sha").alias("exact")).distinct()
    reverts = materialized(reverts, "reverts") if slices > 1 else reverts
    prefixes = reverts.where("named IS NOT NULL").select(F.substring("named", 1, 7).alias("prefix"))
    by_prefix = among(told.withColumn("prefix", F.substring("sha", 1, 7)), prefixes, slices).groupBy("prefix").agg(F.max_by("sha", "seq").alias("full"))
    by_subject = among(told.withColumn("quoted", F.col("subject")), reverts.where("quoted IS NOT NULL").select("quoted"), slices).groupBy("quoted").agg(F.max_by("sha", "seq").alias("said"))
    found = (
        reverts.join(by_sha, F.col("named") == F.col("exact"), "left")
        .join(by_prefix, (F.substring("named", 1, 7) == F.col("prefix")) & F.col("full").startswith(F.col("named")), "left")
        .join(by_subject, "quoted", "left")
    )
    said = F.when(F.col("said") != F.col("sha"), F.col("said"))
    how = F.when(F.col("exact").isNotNull(), "sha").when(F.col("full").isNotNull(), "prefix").when(said.isNotNull(), "subject")
    return found.select("sha", F.coalesce("exact", "full", said).alias("original"), how.alias("matched_by")).distinct()


def scopes(found: DataFrame, history: DataFrame) -> DataFrame:
    """(sha, affected_files, directory_scope) from the original's files."""
    files = found.where("original IS NOT NULL").join(commit_files(history).withColumnRenamed("sha", "original"), "original")
    segments = F.split(C.dirname("file_path"), "/")
    agg = files.groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("pos", "file_path"))).alias("o"), F.min(segments).alias("low"), F.max(segments).alias("high"))
    return agg.select("sha", F.transform("o", lambda x: x["file_path"]).alias("affected_files"), C.common_directory(F.col("low"), F.col("high")).alias("directory_scope"))


def detect(history: DataFrame, as_of: Column, config: SignalsConfig = SignalsConfig()) -> DataFrame:
    told = summaries(history).groupBy("sha").agg(F.max_by(F.struct("ts", "subject", "files_changed", "decision_class"), "seq").alias("c"))
    found = materialized(matches(history, config.slices), "matched") if config.slices > 1 else matches(history)
    df = (
        found.join(told.select("sha", F.col("c").alias("r")), "sha")
        .join(told.select(F.col("sha").alias("original"), F.col("c").alias("o")), "original", "left")
        .join(scopes(found, history), "sha", "left")
    )
    sha, old, known = F.col("sha"), F.col("original"), F.col("original").isNotNull()
    days = F.when(known, C.half_up(C.days_between(F.col("r.ts"), F.col("o.ts"))))
    n = {c: F.when(F.col("r.decision_class") == c, 1).otherwise(0) + F.when(F.col("o.decision_class") == c, 1).otherwise(0) for c in ("decision", "routine", "unknown")}
    shas = F.when(known, F.array(old, sha)).otherwise(F.array(sha))
    seven = lambda x: F.substring(x, 1, 7)
    summary = F.when(known, F.concat(F.lit('Revert detected: "'), F.col("o.subject"), F.lit('" ('), seven(old), F.lit(") was reverted by "), seven(sha), F.lit(" after "), days.cast("string"), F.lit(" days. "), F.col("o.files_changed").cast("string"), F.lit(" files affected."))).otherwise(
        F.concat(F.lit("Revert detected: "), F.col("r.subject"), F.lit(" ("), seven(sha), F.lit("). Original commit not found in indexed history."))
    )
    files = F.coalesce("affected_files", F.array().cast("array<string>"))
    lists = {"affected_files": F.col("affected_files")} if config.list_members else {}
    return signal_rows(
        df.withColumn("affected_files", files).withColumn("directory_scope", F.coalesce("directory_scope", F.lit("."))),
        "revert_pair",
        {"original_sha": old, "revert_sha": sha, "time_to_revert_days": days, "original_subject": F.col("o.subject"), "files_changed": F.coalesce("o.files_changed", "r.files_changed"), **lists, "dominant_decision_class": C.dominant(n)},
        id=C.signal_id("revert_pair", F.array_join(shas, ":")), summary=summary, severity=F.lit("caution"), confidence=F.when(known, 0.9).otherwise(0.6), contributing_shas=shas if config.list_members else F.lit(None),
        start=F.coalesce("o.ts", "r.ts"), end=F.col("r.ts"), dominant_decision_class=C.dominant(n),
    )
