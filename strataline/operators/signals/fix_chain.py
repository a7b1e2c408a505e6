"""Fix chains: features followed by fixes to the same files within days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import columns as C
from strataline.operators.history import file_diffs, summaries
from strataline.operators.signals.common import followers, member_classes, signal_rows, sliced, union_files
from strataline.schema import SignalsConfig
from strataline.sources.scratch import materialized

DAY = 86_400_000_000


def pairs(history: DataFrame, window_days: int, slices: int = 1) -> DataFrame:
    """Distinct (lead, follow, ...) of features and the fixes that follow them on a common file."""
    told = summaries(history).select("sha", "ts", "commit_type")

    def run(files: DataFrame) -> DataFrame:
        leads = told.where("commit_type = 'feat'").join(files, "sha")
        fixes = told.where("commit_type = 'fix'").join(files, "sha")
        return followers(leads, fixes, "file_path", window_days * DAY)

    found = sliced(file_diffs(history).select("sha", "file_path"), "file_path", slices, run, "fix-pairs").distinct()
    fixes = summaries(history).where("commit_type = 'fix'").select(F.col("sha").alias("follow"), F.col("ts").alias("follow_ts"), F.col("seq").alias("follow_seq"), F.col("subject").alias("follow_subject")).distinct()
    found = found.join(fixes, ["follow", "follow_ts"])
    return materialized(found, "fix-chains") if slices > 1 else found


def detect(history: DataFrame, as_of: Column, config: SignalsConfig = SignalsConfig()) -> DataFrame:
    found = pairs(history, config.fix_chain_window_days, config.slices)
    told = summaries(history).select(F.col("sha").alias("lead"), F.col("subject").alias("feature_subject"))
    ordered = F.sort_array(F.collect_list(F.struct("follow_ts", "follow_seq", "follow", "follow_subject")))
    chains = found.groupBy("lead").agg(F.count("*").alias("fix_count"), F.min("lead_ts").alias("start"), F.max("follow_ts").alias("end"), ordered.alias("fixes"))
    df = chains.join(told, "lead").join(union_files(found, history), "lead").join(member_classes(found, history), "lead")
    n, days, lead = F.col("fix_count"), C.half_up(C.days_between(F.col("end"), F.col("start"))), F.col("lead")
    fix_shas, fix_subjects = F.col("fixes.follow"), F.col("fixes.follow_subject")
    lists = {"affected_files": F.col("affected_files"), "fix_shas": fix_shas, "fix_subjects": fix_subjects} if config.list_members else {}
    return signal_rows(
        df, "fix_chain",
        {"feature_sha": lead, "feature_subject": F.col("feature_subject"), "fix_count": n, "day_span": days, **lists, "dominant_decision_class": F.col("dominant_decision_class")},
        id=C.signal_id("fix_chain", lead), severity=F.when(n >= 3, "warning").otherwise("caution"), confidence=F.least(F.lit(0.9), 0.5 + n * 0.15), directory_scope=F.col("first_dir"),
        contributing_shas=F.concat(F.array(lead), fix_shas) if config.list_members else F.lit(None),
        summary=F.concat(F.lit('Feature "'), F.col("feature_subject"), F.lit('" ('), F.substring(lead, 1, 7), F.lit(") required "), n.cast("string"), F.lit(" follow-up fix"), C.plural(n, many="es"), F.lit(" over "), days.cast("string"), F.lit(" day"), C.plural(days), F.lit(", affecting "), F.col("n_files").cast("string"), F.lit(" files.")),
    )
