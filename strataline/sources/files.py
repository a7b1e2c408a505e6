"""Source files of a tree as rows, and their packages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import columns as C
from strataline.schema import EngineConfig

#: Test files by language: fixed patterns.
TEST_PATTERNS = {
    ("ts", "tsx", "js", "jsx", "mjs", "mts"): (r"\.(test|spec)\.(ts|tsx|js|jsx)$", r"__tests__/", r"__mocks__/"),
    ("py",): (r"test_.*\.py$", r".*_test\.py$", r"tests/", r"conftest\.py$"),
    ("rb", "rake"): (r"_spec\.rb$", r"_test\.rb$"),
}


def glob_regex(pattern: str) -> str:
    """A glob with ** / * / ? as an anchored regular expression over relative paths."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def matches_any(path: Column, patterns) -> Column:
    return path.rlike("|".join(glob_regex(p) for p in patterns)) if patterns else F.lit(False)


def is_test_file(path: Column) -> Column:
    out = F.lit(False)
    for extensions, patterns in TEST_PATTERNS.items():
        out |= path.rlike(rf"\.({'|'.join(extensions)})$") & path.rlike("|".join(patterns))
    return out


def wanted(path: Column, config: EngineConfig) -> Column:
    """Included by a glob, excluded by none, and no test unless tests are indexed."""
    keep = matches_any(path, config.include) & ~matches_any(path, (*config.exclude, *config.exclude_patterns))
    return keep if config.index_tests else keep & ~is_test_file(path)


def discover(spark: SparkSession, root: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(path, content) of a tree's source files, relative to it; longer files than max_file_lines are left out."""
    base = root.rstrip("/")
    files = spark.read.option("recursiveFileLookup", "true").text(base, wholetext=True).select(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("full"), F.col("value").alias("content"))
    rel = F.regexp_replace("full", "^.*?" + re.escape(base.split("://", 1)[-1].lstrip("/")) + "/", "")
    files = files.select(rel.alias("path"), "content")
    return select_files(files, config)


def select_files(files: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    return files.where(wanted(F.col("path"), config) & (F.size(F.split("content", "\n")) <= config.max_file_lines)).dropDuplicates(["path"])


def package_names(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """files with package_name: the name in the nearest package.json above; 'unknown' if it has none or is broken, 'root' without one.

    manifests is (path, content) of package.json files. Directories are joined with their ancestors by
    equality, once per directory.
    """
    name = F.coalesce(F.nullif(F.get_json_object("content", "$.name"), F.lit("")), F.lit("unknown"))
    named = manifests.select(C.dirname("path").alias("above"), name.alias("package_name"))
    dirs = files.select(C.dirname("path").alias("dir")).distinct()
    up = dirs.select("dir", F.posexplode(F.concat(F.array(F.lit(".")), C.ancestors(F.concat("dir", F.lit("/x"))))).alias("depth", "above"))
    nearest = up.join(named, "above").groupBy("dir").agg(F.max_by("package_name", "depth").alias("package_name"))
    rows = files.withColumn("dir", C.dirname("path")).join(nearest, "dir", "left").drop("dir")
    return rows.withColumn("package_name", F.coalesce("package_name", F.lit("root")))
