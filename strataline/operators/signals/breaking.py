"""Breaking changes: commits answered by fixes of several other authors in the same directories within hours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import columns as C
from strataline.operators.history import summaries
from strataline.operators.signals.common import signal_rows
from strataline.schema import DECISION_CLASSES, SignalsConfig
from strataline.sources.scratch import materialized

HOUR = 3_600_000_000
#: Cells of (lead, fix) that are held at once.
CELLS = 1 << 22

COUNTS = "sha string, subject string, author string, start bigint, end bigint, author_count bigint, fix_count bigint, n_files bigint, first_dir string, n_decision bigint, n_routine bigint, n_unknown bigint, fix_shas array<string>, fix_authors array<string>"


def _commits(history: DataFrame, micros: int, slices: int = 1, part: int = 0) -> DataFrame:
    """(sha, seq, ..., files): each commit with files, by the last of its summaries in log order; of more slices, those that the part's buckets of time need."""
    told = F.struct("author", "ts", "subject", "commit_type", F.coalesce("decision_class", F.lit("unknown")).alias("cls"))
    is_summary = F.col("chunk_type") == "commit_summary"
    rows = history.where(is_summary | (F.col("chunk_type") == "file_diff") & (F.col("file_path") != ""))
    if slices > 1:
        commits = summaries(history).groupBy("sha").agg(F.max_by(F.struct("ts", "commit_type"), F.struct("seq", "ts")).alias("c")).select("sha", "c.*")
        rows = rows.join(commits.where(F.exists(_buckets(micros), lambda b: F.pmod(b, F.lit(slices)) == part)).select("sha"), "sha", "left_semi")
    rows = rows.groupBy("sha").agg(
        F.max_by(told, F.when(is_summary, F.struct("seq", "ts"))).alias("c"), F.max(F.when(is_summary, F.col("seq"))).alias("seq"),
        F.collect_list(F.when(~is_summary, F.struct(F.col("pos").cast("long").alias("pos"), F.col("file_path").alias("path")))).alias("files"),
    )
    return rows.where("c.author IS NOT NULL AND c.ts IS NOT NULL AND size(files) > 0").select("sha", "seq", "c.*", "files")


def _is_fix() -> Column:
    return F.coalesce(F.col("commit_type") == "fix", F.lit(False))


def _buckets(micros: int) -> Column:
    """The buckets of time that look at a commit: its own, and for a fix the one before."""
    bucket = F.floor(F.unix_micros("ts") / F.lit(micros)).cast("long")
    return F.when(_is_fix(), F.array(bucket, bucket - 1)).otherwise(F.array(bucket))


def _ranges(first, last):
    """(owner, place) of all places first[i] <= place < last[i]."""
    import numpy as np

    n = np.maximum(last - first, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _directory(path: str) -> str:
    at = path.rfind("/")
    return path[:at] if at >= 0 else "."


def _answered(micros: int, listed: bool, cells: int):
    """The function of one bucket of time: its leads, and the fixes of it and the next, to a row for each lead with fixes of two authors.

    A lead's fixes are a row of a matrix of (lead, fix), filled from the ranges of time in each of the lead's directories; it is
    built for some leads at a time, so pairs are counted where they are found and are never rows of a table.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ts = table["ts"].to_numpy()
        is_fix = table["is_fix"].to_numpy().astype(bool)
        order_fix = table.append_column("at", pa.array(np.arange(len(ts)))).filter(pa.array(is_fix)).select(["ts", "seq", "sha", "at"])
        fixes = order_fix.sort_by([("ts", "ascending"), ("seq", "ascending"), ("sha", "ascending")])["at"].to_numpy()
        leads = np.flatnonzero(~is_fix)
        leads = leads[np.argsort(ts[leads], kind="stable")]
        if not len(fixes) or not len(leads):
            return
        authors = pc.dictionary_encode(table["author"].combine_chunks()).indices.to_numpy()
        classes = table["cls"].to_numpy(zero_copy_only=False)
        fix_of, lead_of = np.full(len(ts), -1), np.full(len(ts), -1)
        fix_of[fixes], lead_of[leads] = np.arange(len(fixes)), np.arange(len(leads))

        # each file of a commit once, with its first place
        lists = table["files"].combine_chunks()
        row, entries = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
        coded = pc.dictionary_encode(entries.field("path"))
        names = coded.dictionary.to_pylist()
        by_name = np.empty(len(names), np.int64)
        by_name[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(names))
        pos = entries.field("pos").fill_null(1 << 62).to_numpy()
        path = coded.indices.to_numpy().astype(np.int64)
        order = np.lexsort((by_name[path], pos, path, row))
        row, path, pos = row[order], path[order], pos[order]
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (path[1:] != path[:-1])
        row, path, pos = row[keep], path[keep], pos[keep]
        places: dict[str, int] = {}
        dir_of = np.fromiter((places.setdefault(_directory(p), len(places)) for p in names), np.int64, len(names))
        dir_names = list(places)

        nf, n = len(fixes), len(leads)
        fix_ts, fix_author = ts[fixes], authors[fixes].astype(np.int64)
        f = fix_of[row] >= 0
        fix_dirs = np.unique(dir_of[path[f]] * nf + fix_of[row[f]])  # by directory, then by time
        by_path = np.lexsort((fix_of[row[f]], path[f]))
        fix_path, path_fix = path[f][by_path], fix_of[row[f]][by_path]  # by file, then by time
        often = np.bincount(fix_path, minlength=len(names))
        weights = np.zeros((nf, 5))
        weights[:, 0] = 1
        for k, c in enumerate(DECISION_CLASSES, 1):
            weights[:, k] = classes[fixes] == c
        weights[:, 4] = np.bincount(path_fix, often[fix_path] == 1, nf)  # files that no other fix here has
        shared_path, shared_fix = fix_path[often[fix_path] > 1], path_fix[often[fix_path] > 1]

        own_row, own_path, own_pos = lead_of[row[~f]], path[~f], pos[~f]
        first = np.lexsort((by_name[own_path], own_pos, own_row))
        own_row, own_path = own_row[first], own_path[first]  # by lead, then in the commit's order
        own_at = np.searchsorted(own_row, np.arange(n + 1))
        lead_dirs = np.unique(own_row * len(dir_names) + dir_of[own_path])
        dirs_lead, dirs_dir = lead_dirs // len(dir_names), lead_dirs % len(dir_names)
        low, high = np.searchsorted(fix_ts, ts[leads], "right"), np.searchsorted(fix_ts, ts[leads] + micros, "right")
        range_low = np.searchsorted(fix_dirs, dirs_dir * nf + low[dirs_lead])
        range_high = np.searchsorted(fix_dirs, dirs_dir * nf + high[dirs_lead])
        dirs_at = np.searchsorted(dirs_lead, np.arange(n + 1))
        lead_author = authors[leads]
        own_first, own_last = np.searchsorted(fix_path, own_path, "left"), np.searchsorted(fix_path, own_path, "right")

        step, at = max(1, cells // nf), 0
        while at < n:
            to = min(n, at + step)
            left, right = low[at], high[to - 1]  # leads are ordered by time, so are their windows
            if right <= left:
                at = to
                continue
            d = slice(dirs_at[at], dirs_at[to])
            owner, place = _ranges(range_low[d], range_high[d])
            lead, fix = dirs_lead[d][owner] - at, fix_dirs[place] % nf
            other = fix_author[fix] != lead_author[at:to][lead]
            lead, fix = lead[other], fix[other]
            who = np.zeros((to - at, int(authors.max()) + 1), bool)
            who[lead, fix_author[fix]] = True
            n_authors = who.sum(1)
            hit = n_authors >= 2
            met = np.zeros((to - at, right - left), bool)
            met[lead, fix - left] = True
            counts = (met.astype(np.float64) @ weights[left:right]).astype(np.int64)
            files = counts[:, 4] + (own_at[at + 1 : to + 1] - own_at[at:to])
            s = (shared_fix >= left) & (shared_fix < right)
            if s.any():
                starts = np.flatnonzero(np.r_[True, shared_path[s][1:] != shared_path[s][:-1]])
                files += np.logical_or.reduceat(met[:, shared_fix[s] - left], starts, axis=1).sum(1)
            o = slice(own_at[at], own_at[to])  # own files that a fix has too were counted twice
            entry, place = _ranges(own_first[o], own_last[o])
            inside = (path_fix[place] >= left) & (path_fix[place] < right)
            entry, place = entry[inside], place[inside]
            covered = np.unique(entry[met[own_row[o][entry] - at, path_fix[place] - left]])
            files -= np.bincount(own_row[o][covered] - at, minlength=to - at)
            got = np.flatnonzero(hit)
            if len(got):
                at_rows = leads[at:to][got]
                end = fix_ts[right - 1 - np.argmax(met[got][:, ::-1], axis=1)]
                mine = [(classes[at_rows] == c).astype(np.int64) for c in DECISION_CLASSES]
                texts = table.select(["sha", "subject", "author"]).take(pa.array(at_rows)).combine_chunks()
                if listed:
                    which, cols = np.nonzero(met[got])
                    chosen = pa.array(fixes[left + cols])
                    offsets = pa.array(np.searchsorted(which, np.arange(len(got) + 1)), pa.int32())
                    shas = pa.ListArray.from_arrays(offsets, table["sha"].take(chosen).combine_chunks())
                    names_of = pa.ListArray.from_arrays(offsets, table["author"].take(chosen).combine_chunks())
                else:
                    shas = names_of = pa.nulls(len(got), pa.list_(pa.string()))
                columns = [
                    *[texts[k].combine_chunks() for k in ("sha", "subject", "author")], ts[at_rows], end, n_authors[got], counts[got, 0], files[got],
                    pa.array([dir_names[dir_of[p]] for p in own_path[own_at[at:to][got]]], pa.string()), *[counts[got, k + 1] + mine[k] for k in range(3)], shas, names_of,
                ]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array | pa.ChunkedArray) else pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in COUNTS.split(", ")])
            at = to

    return run


def answered(history: DataFrame, window_hours: int, listed: bool = True, slices: int = 1) -> DataFrame:
    """A row for each commit but fixes that fixes of two other authors or more answer in a directory of it within the window.

    Counts are over distinct fixes, files and classes of the commit and its fixes; the fixes' shas and authors are listed in the
    order of time if ``listed``. One task has a bucket of time as long as the window, with the fixes of the next.
    """
    micros = window_hours * HOUR
    run = _answered(micros, listed, CELLS)

    def bucketed(table):
        import pyarrow as pa

        kinds = {"string": pa.string(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}
        return pa.Table.from_batches(run(table), pa.schema([(name, kinds[kind]) for name, kind in map(str.split, COUNTS.split(", "))]))

    def of(part: int) -> DataFrame:
        rows = _commits(history, micros, slices, part).select(
            "sha", "seq", "author", F.unix_micros("ts").alias("ts"), F.when(~_is_fix(), F.col("subject")).alias("subject"), "cls", "files", _is_fix().alias("is_fix"),
            F.explode(_buckets(micros)).alias("bucket"),
        ).where(F.pmod("bucket", F.lit(slices)) == part)
        found = rows.groupBy("bucket").applyInArrow(bucketed, COUNTS)
        return materialized(found, "answered") if slices > 1 else found

    return reduce(DataFrame.unionByName, [of(k) for k in range(slices)])


def detect(history: DataFrame, as_of: Column, config: SignalsConfig = SignalsConfig()) -> DataFrame:
    df = answered(history, config.breaking_window_hours, config.list_members, config.slices).withColumn("dominant_decision_class", C.dominant_of_counts())
    df = df.withColumn("start", F.timestamp_micros("start")).withColumn("end", F.timestamp_micros("end"))
    n, lead = F.col("author_count"), F.col("sha")
    lists = {"fix_authors": F.array_distinct("fix_authors"), "fix_shas": F.col("fix_shas")} if config.list_members else {}
    return signal_rows(
        df, "breaking_change",
        {"trigger_sha": lead, "trigger_subject": F.col("subject"), "trigger_author": F.col("author"), "author_count": n, "fix_count": F.col("fix_count"), "affected_files": F.col("n_files"), **lists, "dominant_decision_class": F.col("dominant_decision_class")},
        id=C.signal_id("breaking_change", lead), severity=F.lit("warning"), confidence=F.least(F.lit(0.95), 0.6 + n * 0.1), directory_scope=F.col("first_dir"), contributing_shas=F.concat(F.array(lead), F.col("fix_shas")) if config.list_members else F.lit(None),
        summary=F.concat(F.lit('"'), F.col("subject"), F.lit('" ('), F.substring(lead, 1, 7), F.lit(") triggered fixes from "), n.cast("string"), F.lit(" different authors within 48 hours. Blast radius: "), F.col("n_files").cast("string"), F.lit(" files.")),
    )
