"""Per-file risk profiles from history and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import columns as C
from strataline.operators.history import file_diffs
from strataline.operators.signals.ownership import author_counts
from strataline.schema import PROFILE

OWNER_PERCENT = 30
MIN_CHANGES = 2


def _listed(signals: DataFrame, kind: str, name: str) -> DataFrame:
    """(path, name): how many signals of a kind list each file."""
    return signals.where(F.col("type") == kind).select(F.explode(F.array_distinct("affected_files")).alias("path")).groupBy("path").agg(F.count("*").alias(name))


def _scopes_of(signals: DataFrame) -> DataFrame:
    """(id, scopes) of every signal's id."""
    return signals.where("id IS NOT NULL").groupBy("id").agg(F.collect_set("directory_scope").alias("scopes"))


def _above(dirs: DataFrame) -> DataFrame:
    """(dir, scope): each directory with itself and those above it; '.' is above nothing."""
    return dirs.where("dir <> '.'").select("dir", F.explode(C.ancestors(F.concat("dir", F.lit("/x")))).alias("scope"))


def _by_directory(dirs: DataFrame, signals: DataFrame) -> DataFrame:
    """(dir, above, inherited): reverts scoped to a directory or one above it, and the number of ids of all such signals.

    Ids are counted once per scope, and the counts added up per directory; only ids with several scopes, which could count twice,
    are met with directories one by one.
    """
    reverts = signals.groupBy(F.col("directory_scope").alias("scope")).agg(F.count_if(F.col("type") == "revert_pair").alias("n"))
    ids = _scopes_of(signals)
    once = ids.where("size(scopes) = 1").groupBy(F.element_at("scopes", 1).alias("scope")).agg(F.count("*").alias("n_ids"))
    up = _above(dirs)
    sums = up.join(reverts, "scope").join(once, "scope", "left").groupBy("dir").agg(F.sum("n").alias("above"), F.sum(F.coalesce("n_ids", F.lit(0))).alias("single"))
    several = ids.where("size(scopes) > 1").select("id", F.explode("scopes").alias("scope"))
    more = up.join(several, "scope").select("dir", "id").distinct().groupBy("dir").agg(F.count("*").alias("several"))
    return sums.join(more, "dir", "left").select("dir", "above", (F.col("single") + F.coalesce("several", F.lit(0))).alias("inherited"))


def _named(signals: DataFrame) -> DataFrame:
    """(path, id): ids of signals that name a file which no scope of theirs is above; the others are inherited already."""
    named = signals.where("file IS NOT NULL AND id IS NOT NULL").where(~F.col("file").startswith(F.concat("directory_scope", F.lit("/")))).select(F.col("file").alias("path"), "id").distinct()
    several = _scopes_of(signals).where("size(scopes) > 1")
    return named.join(several, "id", "left").where(F.col("scopes").isNull() | ~F.exists("scopes", lambda s: F.col("path").startswith(F.concat(s, F.lit("/"))))).select("path", "id")


def with_signal_ids(profiles: DataFrame, signals: DataFrame) -> DataFrame:
    """Profiles with active_signal_ids, sorted: for every file all ids above it, so best for the files that were asked for."""
    rows = profiles.withColumn("dir", C.dirname("path"))
    scoped = signals.where("id IS NOT NULL").select(F.col("directory_scope").alias("scope"), "id").distinct()
    inherited = _above(rows.select("dir").distinct()).join(scoped, "scope").groupBy("dir").agg(F.sort_array(F.collect_set("id")).alias("inherited"))
    own = _named(signals).groupBy("path").agg(F.collect_set("id").alias("own_ids"))
    none = F.array().cast("array<string>")
    every = F.coalesce("inherited", none)
    every = F.when(F.col("own_ids").isNull(), every).otherwise(F.sort_array(F.array_union(every, F.coalesce("own_ids", none))))
    return rows.join(own, "path", "left").join(inherited, "dir", "left").select(*profiles.columns, every.alias("active_signal_ids"))


def file_profiles(history: DataFrame, signals: DataFrame) -> DataFrame:
    """One profile per file with at least two changes, with the ids of its active signals."""
    out = with_signal_ids(counted_profiles(history, signals), signals)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in PROFILE])


def counted_profiles(history: DataFrame, signals: DataFrame) -> DataFrame:
    """The profiles with the number of their active signals, n_active, in place of the ids.

    A revert that lists a file counts once for that, and once more if the file lies under its scope.
    Active signals name the file or have a scope above it; a scope of '.' is above nothing.
    """
    diffs = file_diffs(history)
    counts = author_counts(diffs, F.col("file_path"))
    rank = F.struct("commits", -F.col("first_seq"))
    files = counts.groupBy(F.col("key").alias("path")).agg(F.sum("commits").alias("total_changes"), F.count("*").alias("contributor_count"), F.max_by(F.struct("author", "commits", "last_change"), rank).alias("top"))
    dates = diffs.groupBy(F.col("file_path").alias("path")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_modified"))
    files = files.where(F.col("total_changes") >= MIN_CHANGES).join(dates, "path")
    files = files.withColumn("dir", C.dirname("path"))
    above = _by_directory(files.select("dir").distinct(), signals)
    named = _named(signals).groupBy("path").agg(F.count("*").alias("own"))

    zero = F.lit(0).cast("long")
    df = files.join(_listed(signals, "revert_pair", "listed"), "path", "left").join(above, "dir", "left").join(_listed(signals, "fix_chain", "fixes"), "path", "left").join(named, "path", "left")
    df = df.withColumn("n_active", F.coalesce("inherited", zero) + F.coalesce("own", zero))
    df = df.withColumn("reverts", F.coalesce("listed", zero) + F.coalesce("above", zero)).withColumn("fixes", F.coalesce("fixes", zero))
    span = F.greatest(F.lit(1.0), C.days_between(F.col("last_modified"), F.col("first_ts")))
    pct = C.percent(F.col("top.commits"), F.col("total_changes"))
    owner = F.when(pct >= OWNER_PERCENT, F.struct(F.col("top.author").alias("author"), pct.alias("percentage"), F.col("top.commits").alias("commits"), F.col("top.last_change").alias("last_change")))
    df = df.withColumn("per_day", F.col("total_changes") / span).withColumn("stability_score", C.stability_score(F.col("reverts"), F.col("fixes"), F.col("per_day")))
    out = df.select(
        "path", owner.alias("primary_owner"), "contributor_count", "stability_score", "total_changes", F.col("reverts").alias("revert_count"), F.col("fixes").alias("fix_after_feature_count"),
        C.change_frequency(F.col("per_day")).alias("change_frequency"), C.risk_score(F.col("stability_score"), F.col("contributor_count"), F.col("reverts"), F.col("fixes")).alias("risk_score"),
        "last_modified", "n_active",
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in PROFILE if f.name in out.columns], "n_active")
