"""What the detectors share: the output row, class look-ups, windowed joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import columns as C
from strataline.operators.history import file_diffs, summaries
from strataline.schema import SIGNAL
from strataline.sources.scratch import materialized

#: Keys that are broadcast after they were counted; more of them are shuffled.
BROADCAST_KEYS = 400_000


def sliced(rows: DataFrame, key: str, slices: int, run: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``run`` over the rows, a part of the keys at a time; for what treats every key by itself."""
    if slices <= 1:
        return run(rows)
    part = F.pmod(F.xxhash64(key), F.lit(slices))
    return reduce(DataFrame.unionByName, [materialized(run(rows.where(part == k)), name) for k in range(slices)])


def among(rows: DataFrame, keys: DataFrame, slices: int) -> DataFrame:
    """The rows with one of ``keys`` (one column, which rows have too); in large histories keys are counted first."""
    if slices > 1:
        keys = materialized(keys.distinct(), "keys")
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return rows.join(keys, keys.columns, "left_semi")


def commit_classes(history: DataFrame) -> DataFrame:
    """(sha, cls): each commit's decision class; of repeated summaries the last in log order counts."""
    return summaries(history).groupBy("sha").agg(F.max_by("decision_class", "seq").alias("cls"))


def classed(rows: DataFrame, history: DataFrame) -> DataFrame:
    """rows (with sha) and their commit's class, 'unknown' without a summary."""
    return rows.join(commit_classes(history), "sha", "left").withColumn("cls", F.coalesce("cls", F.lit("unknown")))


def first_shas(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, contributing_shas): the first n distinct shas of each key in log order.

    rows are (key, sha, seq). The row_number filter is a top-n that Spark applies before the shuffle too,
    so a hot key never gathers its rows in one task.
    """
    order = Window.partitionBy(key).orderBy("seq", "sha")
    top = rows.groupBy(key, "sha").agg(F.min("seq").alias("seq")).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    return top.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "sha"))), lambda x: x["sha"]).alias("contributing_shas"))


def signal_rows(df: DataFrame, kind: str, metadata: dict[str, Column], **given: Column) -> DataFrame:
    """df as rows of the one signal schema; columns that are not given are taken from df by name, or null."""
    meta = F.to_json(F.struct(*[v.alias(k) for k, v in metadata.items()]))
    values = {"type": F.lit(kind), "metadata": meta} | given
    out = [(values[f.name] if f.name in values else F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SIGNAL]
    return df.select(*out)


def followers(leads: DataFrame, fixes: DataFrame, key: str, micros: int) -> DataFrame:
    """Distinct (lead, lead_ts, follow, follow_ts) that share ``key`` with 0 < follow_ts - lead_ts <= micros.

    Both sides carry sha, ts and the key. The window is part of the equi-key: time is cut into
    buckets as long as the window, and a lead looks into its own and the next, so a hot key meets only the
    rows near in time.
    """
    bucket = F.floor(F.unix_micros("ts") / F.lit(micros)).cast("long")
    a = leads.select(key, F.col("sha").alias("lead"), F.col("ts").alias("lead_ts"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    b = fixes.select(key, F.col("sha").alias("follow"), F.col("ts").alias("follow_ts"), bucket.alias("bucket"))
    gap = F.unix_micros("follow_ts") - F.unix_micros("lead_ts")
    return a.join(b, [key, "bucket"]).where((gap > 0) & (gap <= micros)).drop(key, "bucket").distinct()


def commit_files(history: DataFrame) -> DataFrame:
    """(sha, file_path, pos), each file of a commit once."""
    return file_diffs(history).groupBy("sha", "file_path").agg(F.min("pos").alias("pos"))


def union_files(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """(lead, n_files, affected_files, first_dir) over the files of a lead and all its followers.

    affected_files lists the lead's files in their order, then the others by path; first_dir is the
    directory of the first.
    """
    members = pairs.select("lead", F.col("follow").alias("sha")).unionByName(pairs.select("lead", F.col("lead").alias("sha"))).distinct()
    files = members.join(commit_files(history), "sha")
    own = F.when(F.col("sha") == F.col("lead"), F.col("pos"))
    files = files.groupBy("lead", "file_path").agg(F.min(own).alias("pos"))
    ordered = F.sort_array(F.collect_list(F.struct(F.coalesce("pos", F.lit((1 << 62))).alias("pos"), "file_path")))
    files = files.groupBy("lead").agg(ordered.alias("o"))
    return files.select("lead", F.size("o").alias("n_files"), F.transform("o", lambda x: x["file_path"]).alias("affected_files"), C.dirname(F.element_at("o", 1)["file_path"]).alias("first_dir"))


def member_classes(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """(lead, dominant_decision_class) over the distinct shas of a lead and its followers."""
    members = pairs.select("lead", F.col("follow").alias("sha")).unionByName(pairs.select("lead", F.col("lead").alias("sha"))).distinct()
    return classed(members, history).groupBy("lead").agg(*C.class_counts("cls")).select("lead", C.dominant_of_counts().alias("dominant_decision_class"))
