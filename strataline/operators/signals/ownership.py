"""Ownership: files and directories with an author of at least a share of the changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import columns as C
from strataline.operators.history import file_diffs
from strataline.operators.signals.common import classed, first_shas, signal_rows, sliced
from strataline.schema import SignalsConfig


def author_counts(rows: DataFrame, key: Column) -> DataFrame:
    """(key, author, commits, last_change, first_seq), one row per author of a key."""
    return rows.select(key.alias("key"), "author", "ts", "seq").groupBy("key", "author").agg(F.count("*").alias("commits"), F.max("ts").alias("last_change"), F.min("seq").alias("first_seq"))


def classed_counts(rows: DataFrame, history: DataFrame) -> DataFrame:
    """author_counts of (key, author, sha, ts, seq), with how many of an author's commits are of each class."""
    each = rows.groupBy("sha", "key", "author").agg(F.count("*").alias("commits"), F.max("ts").alias("last_change"), F.min("seq").alias("first_seq"))
    return classed(each, history).groupBy("key", "author").agg(F.sum("commits").alias("commits"), F.max("last_change").alias("last_change"), F.min("first_seq").alias("first_seq"), *C.class_counts("cls"))


def owners(counts: DataFrame, min_commits: int, min_percent: int) -> DataFrame:
    """Keys with enough changes and a clear owner. Of equal counts the author seen first ranks first; other columns of counts are the owner's."""
    told = ["author", "commits", "last_change", *[c for c in counts.columns if c not in ("key", "author", "commits", "last_change", "first_seq")]]
    rank = F.struct("commits", -F.col("first_seq"))
    out = counts.groupBy("key").agg(
        F.sum("commits").alias("total"), F.count("*").alias("contributor_count"),
        F.max_by(F.struct(*told), rank).alias("top"), F.min_by("last_change", rank).alias("start"),
    )
    out = out.select("key", "total", "contributor_count", "top.*", "start").withColumn("percentage", C.percent(F.col("commits"), F.col("total")))
    return out.where((F.col("total") >= min_commits) & (F.col("percentage") >= min_percent))


def top_contributors(counts: DataFrame, n: int = 5) -> DataFrame:
    """(key, contributors): the n strongest authors with their shares."""
    order = Window.partitionBy("key").orderBy(F.desc("commits"), "first_seq")
    total = counts.groupBy("key").agg(F.sum("commits").alias("total"))
    best = counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).join(total, "key")
    row = F.struct("rn", "author", C.percent(F.col("commits"), F.col("total")).alias("percentage"), "commits")
    return best.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x.dropFields("rn")).alias("contributors"))


def _signals(history: DataFrame, key: Column, config: SignalsConfig, directory: bool) -> DataFrame:
    rows = file_diffs(history)
    if directory:
        rows = rows.where(C.dirname("file_path") != ".")
    rows = rows.select(key.alias("key"), "author", "sha", "ts", "seq")

    def owned(rows: DataFrame) -> DataFrame:
        found = owners(classed_counts(rows, history), config.ownership_min_commits + 2 * directory, config.ownership_min_percent)
        return found.where("author IS NOT NULL").withColumn("dominant_decision_class", C.dominant_of_counts()).drop("n_decision", "n_routine", "n_unknown")

    # directories are few: their counts are summed before they are shuffled
    df, lists = sliced(rows, "key", 1 if directory else config.slices, owned, "owners"), {}
    if config.list_members:
        found, counts = df, author_counts(rows, F.col("key"))
        mine = rows.select("key", "author", "sha", "seq").join(found.select("key", "author"), ["key", "author"], "left_semi")
        top5 = top_contributors(counts.join(found.select("key"), "key", "left_semi"))
        df, lists = df.join(first_shas(mine, "key", 10), "key").join(top5, "key"), {"contributors": F.col("contributors")}
    k, pct, total = F.col("key"), F.col("percentage"), F.col("total")
    share = F.concat(F.col("author"), F.lit(" owns "), k, F.lit("/ (" if directory else " ("), pct.cast("string"), F.lit("% of "), total.cast("string"), F.lit(" changes"))
    summary = F.concat(share, F.lit(" across directory).")) if directory else F.concat(share, F.lit(", last active "), F.date_format("last_change", "yyyy-MM-dd"), F.lit(")."))
    return signal_rows(
        df, "ownership",
        {"directory" if directory else "file": k, "primary_author": F.col("author"), "percentage": pct, "total_commits": total, "contributor_count": F.col("contributor_count"), "last_change": C.iso(F.col("last_change")), **lists, "dominant_decision_class": F.col("dominant_decision_class")},
        id=C.signal_id("ownership", F.concat(k, F.lit("/")) if directory else k, F.col("author")), summary=summary, severity=F.lit("info"),
        confidence=F.least(F.lit(0.95), 0.5 + pct / 200), directory_scope=k if directory else C.dirname(k), end=F.col("last_change"), file=F.lit(None) if directory else k,
    )


def detect_files(history: DataFrame, as_of: Column, config: SignalsConfig = SignalsConfig()) -> DataFrame:
    return _signals(history, F.col("file_path"), config, False)


def detect_directories(history: DataFrame, as_of: Column, config: SignalsConfig = SignalsConfig()) -> DataFrame:
    return _signals(history, C.dirname("file_path"), config, True)


def detect(history: DataFrame, as_of: Column, config: SignalsConfig = SignalsConfig()) -> DataFrame:
    return detect_files(history, as_of, config).unionByName(detect_directories(history, as_of, config))
