"""Commits from `git log`, parsed as DataFrame columns."""

from __future__ import annotations

import os
import subprocess
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.schema import GitConfig
from strataline.sources.scratch import shared_folder

SEPARATOR = "commit-record"
FORMAT = f"{SEPARATOR}%x00%H%x00%an%x00%ae%x00%aI%x00%s%x00%b%x00%P%x00%D"


def git(repo: str, *args: str) -> str:
    """A git command's output; arguments are passed as they are, never through a shell."""
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True, timeout=600)
    return done.stdout.decode("utf-8", "replace")


def validate_repo(repo: str) -> None:
    try:
        git(repo, "rev-parse", "--is-inside-work-tree")
    except (subprocess.CalledProcessError, OSError) as e:
        raise ValueError(f"not a git repository: {repo}") from e


def head_sha(repo: str) -> str:
    return git(repo, "rev-parse", "HEAD").strip()


def dump_log(repo: str, path: str, since: str | None = None, days: int | None = None) -> str:
    """Writes the log with numbers and patches of all branches, or of since..HEAD, to a file; its path."""
    args = ["log", f"--format={FORMAT}", "--numstat", "-p", "--no-color"]
    args += [f"--since={days} days ago"] if days else []
    args += [f"{since}..HEAD"] if since else ["--all"]
    with open(path, "wb") as out:
        subprocess.run(["git", "-C", repo, *args], stdout=out, check=True)
    return path


def read_log(spark: SparkSession, path: str, config: GitConfig = GitConfig()) -> DataFrame:
    """Raw commits of a dumped log. Each file is split at the record separator and parsed in columns.

    seq is the commit's age order: the log is newest first, so later records are older.
    """
    text = spark.read.text(path, lineSep=f"{SEPARATOR}\0").where("length(value) > 0")
    text = text.select(F.regexp_replace("value", "�", "").alias("value"), F.monotonically_increasing_id().alias("__at"))
    return parse_records(text, config)


def parse_records(records: DataFrame, config: GitConfig = GitConfig()) -> DataFrame:
    """value (one record: eight fields split by NUL, the last followed by numbers and patches) as raw commits."""
    fields = F.split("value", "\0", 8)
    last = F.get(fields, F.lit(7))
    # the text begins after the refs' line; a patch begins at a line's start
    end, cut = F.instr(last, "\n"), F.instr(last, "\ndiff --git ")
    numbers = F.when(end == 0, "").when(cut > 0, F.substring(last, end + 1, cut - end)).otherwise(F.substring(last, end + 1, F.length(last)))
    patches = F.when(cut > 0, F.substring(last, cut + 1, F.length(last))).otherwise(F.lit(""))
    base = records.where(F.length(F.substring_index("value", "\0", 7)) < F.length("value")).select(*[F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(("sha", "author", "email", "date", "subject"))], F.trim(F.regexp_replace(F.get(fields, F.lit(5)), r"\s+$", "")).alias("body"), F.trim(F.get(fields, F.lit(6))).alias("up"), F.substring_index(last, "\n", 1).alias("refs"), numbers.alias("numbers"), patches.alias("patches"), "__at")
    # named twice, so that the optimizer doesn't put the splitting of the whole record in each place where they are used
    files = F.when(F.col("numbers") == "", numstat(F.lit(""))).otherwise(numstat(F.col("numbers")))
    diffs = F.when(F.col("patches") == "", F.create_map().cast("map<string,string>")).otherwise(patches_by_file(F.col("patches"), config.max_diff_lines_per_file))
    return base.select(
        F.trim("sha").alias("sha"), "author", "email", "date", "subject", "body",
        F.when(F.col("up") == "", F.array().cast("array<string>")).otherwise(F.split("up", " ")).alias("parents"), "refs",
        files.alias("files"), diffs.alias("diffs"), (-F.col("__at")).alias("seq"),
    )


def numstat(text: Column) -> Column:
    """Lines 'added<tab>deleted<tab>path' as file changes; '-' (binary) is 0, a path may hold tabs."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^(\d+|-)\t(\d+|-)\t.+"))

    def number(line: Column, k: int) -> Column:
        return F.coalesce(F.get(F.split(line, "\t", 3), F.lit(k)).try_cast("int"), F.lit(0))

    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^[^\t]*\t[^\t]*\t(.+)$", 1).alias("path"), number(x, 0).alias("additions"), number(x, 1).alias("deletions"), F.lit("M").alias("status")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def patches_by_file(text: Column, max_lines: int) -> Column:
    """A patch text as a map of path to that file's patch, cut to max_lines with a note of what was cut."""
    header = "diff --git a/"

    def bodies(parts: Column) -> Column:
        # all parts but the last lost their line's end; the first is what stands before any header, after the end that was put there
        line_end = lambda i: F.when(i + 1 < F.size(parts), "\n").otherwise("")
        whole = lambda p, i: F.when((i == 0) & (p == ""), p).when(i == 0, F.concat(F.lit(header), F.substring(p, F.lit(2), F.length(p)), line_end(i))).otherwise(F.concat(F.lit(header), p, line_end(i)))
        return F.filter(F.transform(parts, whole), lambda body: F.instr(body, "\n") > 0)

    def entry(body: Column) -> Column:
        first = F.substring_index(body, "\n", 1)
        head = F.substring(first, F.lit(len(header) + 1), F.length(first))
        path = _let(head, lambda h: F.when(F.instr(h, " b/") > 0, F.regexp_extract(h, r"^.*? b/(.*)$", 1)).otherwise(F.get(F.split(h, " "), F.lit(0))))
        lines = F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
        note = F.concat(F.lit("\n... truncated ("), (lines - max_lines).cast("string"), F.lit(" more lines)"))
        short = _let(F.substring_index(body, "\n", max_lines), lambda cut: F.when(F.octet_length(cut) < F.octet_length(body), F.concat(cut, note)).otherwise(body))
        return F.struct(path.alias("key"), F.when(body.contains("Binary files"), "[binary file]").otherwise(short).alias("value"))

    def last(entries: Column) -> Column:
        # of entries for one path the last counts; the map keeps distinct keys
        again = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])
        return F.when(F.size(F.array_distinct(F.transform(entries, lambda e: e["key"]))) == F.size(entries), entries).otherwise(F.filter(entries, lambda e, i: ~again(e, i)))

    parts = F.split(F.concat(F.lit("\n"), text), f"\n{header}")
    return F.map_from_entries(_let(F.transform(_let(parts, bodies), entry), last))


def file_diff(repo: str, sha: str, path: str, max_lines: int = 200) -> str:
    """One file's patch in a commit with its functions as context, cut to max_lines; empty if git cannot tell it."""
    try:
        patch = git(repo, "show", "--format=", "--patch", "--function-context", sha, "--", path)
    except (subprocess.CalledProcessError, OSError):
        return ""
    if "Binary files" in patch:
        return "[binary file]"
    lines = patch.split("\n")
    return patch if len(lines) <= max_lines else "\n".join(lines[:max_lines]) + f"\n... truncated ({len(lines) - max_lines} more lines)"


def commits(spark: SparkSession, repo: str, staging: str | None = None, since: str | None = None, days: int | None = None, config: GitConfig = GitConfig()) -> DataFrame:
    """Raw commits of a repository: the log is dumped once by the driver, put where executors see it, and parsed in parallel.

    ``staging`` is a folder of any Hadoop file system; by default one in the shared folder.
    """
    validate_repo(repo)
    folder = f"{(staging or shared_folder(spark)).rstrip('/')}/log-{uuid.uuid4().hex}"
    with tempfile.TemporaryDirectory() as here:  # the driver's own disk, before the file is moved
        path = dump_log(repo, os.path.join(here, "log.txt"), since, days)
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{folder}/log.txt")
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(target.getParent())
        fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{path}"), target)
    return read_log(spark, f"{folder}/log.txt", config)


def changed_paths(spark: SparkSession, repo: str, since: str) -> DataFrame:
    """(path) changed since a commit or in the working tree; renames count by their new name."""
    diff = spark.createDataFrame([(p,) for p in git(repo, "diff", "--name-only", since, "HEAD").splitlines() if p], "path string")
    status = [line[3:].split(" -> ")[-1] for line in git(repo, "status", "--porcelain").splitlines() if len(line) > 3]
    return diff.union(spark.createDataFrame([(p,) for p in status], "path string")).distinct()


def recent_paths(history: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """(file_path) of files with a diff in the last days."""
    return history.where((F.col("chunk_type") == "file_diff") & (F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))).select("file_path").distinct()


