"""Assessment of files before a change, and explanation of code by its history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import columns as C
from strataline.operators import vector as V
from strataline.operators import warnings as W


@dataclass
class Assessment:
    warnings: DataFrame
    file_profiles: DataFrame
    signals: DataFrame
    owners: DataFrame


def profiles_for(profiles: DataFrame, files: DataFrame) -> DataFrame:
    """Profiles of the files (column path) and of everything below their directories; each once."""
    dirs = files.select(C.dirname("path").alias("key")).where("key <> '.'").distinct()
    exact = profiles.join(F.broadcast(files.select("path").distinct()), "path", "left_semi").select("path")
    below = profiles.select("path", F.explode(C.ancestors("path")).alias("key")).join(F.broadcast(dirs), "key", "left_semi").select("path")
    return profiles.join(exact.union(below).distinct(), "path", "left_semi")


def signals_for(signals: DataFrame, files: DataFrame) -> DataFrame:
    """Signals scoped to a file's directory or to the repository; all of them if a file lies at the root."""
    dirs = files.select(C.dirname("path").alias("asked")).distinct()
    asked = F.broadcast(dirs)  # a request's directories
    wanted = (F.col("directory_scope") == F.col("asked")) | (F.col("directory_scope") == ".") | (F.col("asked") == ".")
    return signals.join(asked, wanted, "left_semi").dropDuplicates(["id"])


def owners_of(profiles: DataFrame) -> DataFrame:
    """(author, path, percentage, last_change), each author and path once, by share."""
    o = F.col("primary_owner")
    rows = profiles.where(o.isNotNull()).select(o["author"].alias("author"), "path", o["percentage"].alias("percentage"), o["last_change"].alias("last_change"))
    return rows.dropDuplicates(["author", "path"]).orderBy(F.desc("percentage"), "path")


def assess(profiles: DataFrame, signals: DataFrame, files: DataFrame, as_of: Column, change_type: str | None = None, found: DataFrame | None = None) -> Assessment:
    """What is known to be risky about files (column path; a request's list, so it is small).

    found adds signals from a vector search; those that the directories already gave come first.
    """
    kept = profiles_for(profiles, files)
    near = signals_for(signals, files)
    if found is not None:
        near = near.unionByName(found.select(*near.columns).join(near.select("id"), "id", "left_anti").select(*near.columns))
    return Assessment(W.ranked(W.warnings(kept, near, as_of, change_type)), kept, near, owners_of(kept))


def explain(chunks: DataFrame, history: DataFrame, query_code, query_history, hits: int = 5, per_file: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(code hits, the best history rows of each hit's file, history hits)."""
    code = V.search_code(chunks, query_code, hits)
    return code, V.lateral_top_k(code, history.where("chunk_type = 'file_diff'"), query_history, per_file), V.search_history(history, query_history, hits)


def file_history(history: DataFrame, path: str, query, limit: int = 10) -> DataFrame:
    return V.search_history(history, query, limit, F.col("file_path") == path)
