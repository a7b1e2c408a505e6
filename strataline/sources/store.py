"""Parquet tables of chunks, history, signals and profiles, with snapshot rewrites and state.

Parquet has no in-place delete. A change writes the table's next snapshot to a new folder and then moves
the table's pointer, a one-line file, so readers see the old or the new snapshot, never a mixture. The last
KEPT snapshots stay, so that a query that began before a change can end. A delete writes only those files
again that had such rows; the new snapshot lists the other ones, which stay where they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline import schema
from strataline.functions import columns as C
from strataline.sources.scratch import freed_shuffles

VECTOR = T.StructField("vector", T.ArrayType(T.FloatType()))
TABLES = {
    "chunks": T.StructType([*schema.CODE_CHUNK, VECTOR]), "git_history": T.StructType([*schema.HISTORY, VECTOR]),
    "signals": T.StructType([*schema.SIGNAL, VECTOR]), "file_profiles": schema.PROFILE,
}
#: Snapshots of a table that are kept beside the current one.
KEPT = 2
PARTITIONS = {"git_history": ["chunk_type"], "signals": ["type"]}
#: Columns whose values own the keys of their rows: such rows are dealt out together, and so lie and compress together.
OWNERS = {"git_history": "sha"}
#: Folders that a snapshot's files may lie in; beyond, a delete writes the whole table anew.
FOLDERS = 8
#: Rows of a table from which an append first leaves out those that can't have one of its keys, by a filter of so many bits.
LARGE, FILTER_BITS = 5_000_000, 1 << 24


class Store:
    """Tables and state below one URI of any Hadoop file system."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.uri).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # small files by way of the file system's own streams, so that object stores work
    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.uri}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(f"{self.uri}/{name}"), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _current(self, table: str) -> str | None:
        at = self._read(f"{table}/_current")
        return f"{self.uri}/{table}/{at.strip()}" if at else None

    def _older(self, at: str) -> list[str]:
        """The files of older snapshots that a snapshot has too, below the table's folder."""
        return (self._read(f"{at.removeprefix(self.uri + '/')}/_older") or "").split("\n")[:-1]

    def _local(self, uri: str) -> str:
        return self._path(self.spark.sparkContext._jvm.java.net.URI(uri)).toUri().getPath()

    def _files(self, folder: str) -> dict[str, str]:
        """Data files below a snapshot's folder: their names below the table's folder, by their paths."""
        if not self._fs.exists(self._path(folder)):
            return {}
        found, each = {}, self._fs.listFiles(self._path(folder), True)
        top = len(self._fs.makeQualified(self._path(folder.rpartition("/")[0])).toUri().getPath()) + 1
        while each.hasNext():
            path = each.next().getPath()
            if not path.getName().startswith(("_", ".")):
                found[path.toUri().getPath()] = path.toUri().getPath()[top:]
        return found

    def _scans(self, table: str, at: str) -> list[DataFrame]:
        """What a snapshot holds: its own folder, and listed files of each older one."""
        read, top, older = self.spark.read.schema(TABLES[table]), f"{self.uri}/{table}", {}
        for name in self._older(at):
            older.setdefault(name.partition("/")[0], []).append(f"{top}/{name}")
        return [read.parquet(at), *(self.spark.read.schema(TABLES[table]).option("basePath", f"{top}/{k}").parquet(*names) for k, names in older.items())]

    def exists(self, table: str) -> bool:
        return self._current(table) is not None

    def read(self, table: str, vectors: bool = False) -> DataFrame:
        """A table, empty if it isn't there yet; vectors are left out of the scan unless asked for."""
        kind, at = TABLES[table], self._current(table)
        df = self.spark.createDataFrame([], kind) if at is None else reduce(DataFrame.unionByName, self._scans(table, at))
        return df if vectors or "vector" not in df.columns else df.drop("vector")

    def _conform(self, table: str, df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table]])

    def _written(self, table: str, df: DataFrame, folder: str, mode: str) -> None:
        with freed_shuffles(df.sparkSession):
            self._conform(table, df).write.mode(mode).option("compression", "zstd").partitionBy(*PARTITIONS.get(table, [])).parquet(folder)

    def _snapshot(self, table: str, df: DataFrame, older: list[str] = ()) -> None:
        """The table's next snapshot: df's rows, and the older files that are named."""
        old = self._current(table)
        number = int(old.rpartition("-")[2]) + 1 if old else 0
        self._written(table, df, f"{self.uri}/{table}/snapshot-{number}", "overwrite")
        if older:
            self._write(f"{table}/snapshot-{number}/_older", "".join(f"{name}\n" for name in older))
        self._write(f"{table}/_current", f"snapshot-{number}\n")
        if number > KEPT:
            self._retire(table, number - KEPT - 1)

    def _retire(self, table: str, number: int) -> None:
        """Removes a snapshot, but for the files that the next one has too; what both lack went before."""
        at, top = f"{self.uri}/{table}/snapshot-{number}", f"{self.uri}/{table}"
        had, kept = {*self._files(at).values(), *self._older(at)}, {*self._older(f"{top}/snapshot-{number + 1}")}
        for name in had - kept if kept else ():
            self._fs.delete(self._path(f"{top}/{name}"), False)
        for folder in {f"snapshot-{number}", *(name.partition("/")[0] for name in had)} - {name.partition("/")[0] for name in kept}:
            self._fs.delete(self._path(f"{top}/{folder}"), True)

    def _drop_rows(self, table: str, stays: Column) -> None:
        """The next snapshot lacks the rows for which ``stays`` isn't true; files without such rows are not written again."""
        at = self._current(table)
        scans, names = self._scans(table, at), self._files(at)
        names |= {self._fs.makeQualified(self._path(f"{self.uri}/{table}/{name}")).toUri().getPath(): name for name in self._older(at)}
        hit = reduce(DataFrame.union, [df.where(~F.coalesce(stays, F.lit(False))).select("_metadata.file_path") for df in scans]).distinct().collect()
        changed = {names[self._local(r[0])] for r in hit}
        if len(scans) > FOLDERS:
            changed = set(names.values())
        older = sorted(set(names.values()) - changed)
        folders: dict[str, list[str]] = {}
        for name in sorted(changed):
            folders.setdefault(name.partition("/")[0], []).append(f"{self.uri}/{table}/{name}")
        rows = [self.spark.read.schema(TABLES[table]).option("basePath", f"{self.uri}/{table}/{k}").parquet(*paths).where(stays) for k, paths in folders.items()]
        self._snapshot(table, reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], TABLES[table]), older)

    def insert(self, table: str, df: DataFrame, overwrite: bool = False) -> None:
        """Appends to the current snapshot's folder, or writes a new one."""
        at = self._current(table)
        if overwrite or at is None:
            self._snapshot(table, df)
        else:
            self._written(table, df, at, "append")

    def append_new(self, table: str, df: DataFrame, key: str = "id", dealt: bool = False) -> None:
        """Appends the rows whose key isn't there yet: repeated runs change nothing.

        Where keys have owners, rows are dealt out by them, once for both the repeated keys and the known ones; ``dealt``
        tells that ``dealt_out`` was applied to what df was made of.
        """
        owner = OWNERS.get(table) if OWNERS.get(table) in df.columns else None
        near = F.col(key) if owner is None else owner_of(owner)
        known = self.read(table).select(near.alias("__near"), F.col(key).alias("__key"))
        if self.exists(table) and known.count() > LARGE:
            known = possible(known, df.select(near.alias("__near")), "__near")
        rows = df.withColumn("__near", near).withColumn("__key", F.col(key))
        rows = rows if dealt else rows.repartition("__near")
        with _by_owner(df.sparkSession):
            self.insert(table, rows.dropDuplicates(["__near", "__key"]).join(known, ["__near", "__key"], "left_anti"))

    def delete(self, table: str, keys: DataFrame, key: str) -> None:
        """Drops the rows whose key is among ``keys`` (one column of that name)."""
        if self.exists(table):
            self._snapshot(table, without(self.read(table, vectors=True), keys, key))

    def delete_by_file_path(self, path: str, table: str = "chunks") -> None:
        if self.exists(table):
            self._drop_rows(table, F.col("file_path") != path)

    def delete_by_sha(self, sha: str) -> None:
        if self.exists("git_history"):
            self._drop_rows("git_history", F.col("sha") != sha)

    def replace_signals(self, types: list[str], df: DataFrame) -> None:
        """The signals of these types become exactly df's; a type without new signals ends up empty."""
        self._snapshot("signals", replaced_types(self.read("signals", vectors=True), self._conform("signals", df), types))

    def upsert_profiles(self, df: DataFrame, overwrite: bool = False) -> None:
        self._snapshot("file_profiles", self._conform("file_profiles", df) if overwrite else upserted(self.read("file_profiles"), self._conform("file_profiles", df), "path"))

    def drop(self, table: str) -> None:
        self._fs.delete(self._path(f"{self.uri}/{table}"), True)

    def load_state(self, name: str) -> dict[str, Any] | None:
        try:
            return json.loads(self._read(f"state/{name}.json") or "null")
        except ValueError:
            return None

    def save_state(self, name: str, state: dict[str, Any]) -> None:
        self._write(f"state/{name}.json", json.dumps(state))


def owner_of(column: str) -> Column:
    return F.coalesce(column, F.lit(""))


def dealt_out(df: DataFrame, table: str) -> DataFrame:
    """df, from which a table's rows are made, with all of an owner's rows together."""
    return df.repartition(owner_of(OWNERS[table]))


@contextmanager
def _by_owner(spark: SparkSession) -> Iterator[None]:
    """Joins by several columns take rows that are dealt out by one of them as they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def possible(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be among ``keys``: every one that is, and few others, by a filter of one hash that is broadcast."""
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    word, bit = F.shiftright(slot, 6), (slot % 64).cast("int")
    words = keys.groupBy(word.alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({key}), {FILTER_BITS}) % 64 AS INT))")).alias("__bits"))
    held = rows.withColumn("__word", word).withColumn("__bit", bit).join(F.broadcast(words), "__word")
    return held.where(F.getbit("__bits", F.col("__bit")) == 1).select(*rows.columns)


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti").select(*rows.columns)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's rows, and old's rows whose key new doesn't have."""
    return without(old, new, key).unionByName(new)


def replaced_types(old: DataFrame, new: DataFrame, types: list[str]) -> DataFrame:
    return old.where(~F.col("type").isin(types)).unionByName(new)


def history_stats(history: DataFrame) -> DataFrame:
    return history.agg(F.count("*").alias("total_rows"), F.count_distinct("sha").alias("commits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def code_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"), F.count_distinct("file_path").alias("files"))


def signal_type_counts(signals: DataFrame) -> DataFrame:
    """(type, n), the most frequent type first."""
    return signals.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def signals_in_directory(signals: DataFrame, directory: str) -> DataFrame:
    """Signals scoped to a directory or to the whole repository; '.' gives all."""
    return signals if directory == "." else signals.where(F.col("directory_scope").isin(directory, "."))


def signals_of_type(signals: DataFrame, kind: str) -> DataFrame:
    return signals.where(F.col("type") == kind)


def profile_of(profiles: DataFrame, path: str) -> DataFrame:
    return profiles.where(F.col("path") == path)


def profiles_under(profiles: DataFrame, directory: str) -> DataFrame:
    return profiles if directory == "." else profiles.where(F.col("path").startswith(directory.rstrip("/") + "/"))


def signals_as_records(signals: DataFrame) -> DataFrame:
    """Signals with arrays as JSON text and times as ISO text, as record-oriented consumers expect."""
    return signals.select("id", "type", "summary", "severity", "confidence", "directory_scope", F.to_json("contributing_shas").alias("contributing_shas"), C.iso(F.col("start")).alias("temporal_start"), C.iso(F.col("end")).alias("temporal_end"), "metadata")


def records_as_signals(records: DataFrame) -> DataFrame:
    """The signals of such records: arrays and times parsed again, and what their metadata names of files and classes."""
    meta = lambda k, kind: F.from_json("metadata", f"{k} {kind}")[k]
    return records.select(
        "id", "type", "summary", "severity", "confidence", "directory_scope", F.from_json("contributing_shas", "array<string>").alias("contributing_shas"), C.to_ts("temporal_start").alias("start"), C.to_ts("temporal_end").alias("end"),
        meta("file", "string").alias("file"), meta("dominant_decision_class", "string").alias("dominant_decision_class"), "metadata",
    )
