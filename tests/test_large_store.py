"""What keeps large tables of the store, the stream and logs small and quick, and right."""

import os
import time

import pytest
from builders import commits, diff, history, summary
from pyspark.sql import functions as F

from strataline.operators import history as H
from strataline.plans import catalog
from strataline.schema import RAW_COMMIT, GitConfig
from strataline.sources import gitlog as G
from strataline.sources import store as ST

FOLDER = "/root/testdata/sf0.001"
supplied = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the supplied tables are not here")


@pytest.fixture
def store(spark, tmp_path):
    return ST.Store(spark, str(tmp_path / "a store"))


def files(store, name=""):
    return {os.path.join(at, f) for at, _, names in os.walk(f"{store.uri}/git_history/{name}") for f in names if f.endswith(".parquet")}


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_a_delete_writes_only_the_files_that_had_such_rows(spark, store):
    for k in range(4):
        store.insert("git_history", history(spark, [summary(f"c{k}", id=f"s{k}"), diff(f"c{k}", "x.ts", id=f"x{k}"), diff(f"c{k}", f"y{k}.ts", id=f"y{k}")]).coalesce(1))
    first, before = store.read("git_history"), files(store)
    store.delete_by_file_path("y1.ts", "git_history")
    assert len(files(store, "snapshot-1")) == 1 and ids(store.read("git_history")) == sorted({"s0", "s1", "s2", "s3", "x0", "x1", "x2", "x3", "y0", "y2", "y3"})
    store.delete_by_sha("c0")
    store.append_new("git_history", history(spark, [diff("c0", "x.ts", id="x0"), diff("c1", "x.ts", id="x1")]))
    assert ids(store.read("git_history")) == ["s1", "s2", "s3", "x0", "x1", "x2", "x3", "y2", "y3"]
    assert len(ids(first)) == 12 and before <= files(store)
    store.delete_by_sha("c2")
    store.delete_by_sha("c3")
    assert ids(store.read("git_history")) == ["s1", "x0", "x1"]
    # the first two snapshots are gone: what only they had went, what the next ones have stays
    assert len(before & files(store)) < len(before) and {r[0] for r in store.read("git_history").select(F.input_file_name()).collect()} and len(files(store)) < 12
    store.delete_by_sha("none")
    store.delete_by_file_path("x.ts", "git_history")
    assert ids(store.read("git_history")) == ["s1"]


def test_deletes_from_many_folders(spark, store, monkeypatch):
    monkeypatch.setattr(ST, "FOLDERS", 2)
    for k in range(6):
        store.insert("git_history", history(spark, [diff(f"c{k}", "x.ts", id=f"x{k}")]))
    for k in range(5):
        store.delete_by_sha(f"c{k}")
        assert ids(store.read("git_history")) == [f"x{j}" for j in range(k + 1, 6)]


def test_an_append_to_a_large_table_reads_possible_keys_only(spark, store, monkeypatch):
    monkeypatch.setattr(ST, "LARGE", 3)
    rows = [diff(f"c{k}", "x.ts", id=f"x{k}") for k in range(50)]
    store.insert("git_history", history(spark, rows))
    store.append_new("git_history", history(spark, [*rows[40:], diff("c40", "y.ts", id="y"), diff("new", "x.ts", id="z"), diff("new", "x.ts", id="z")]))
    assert ids(store.read("git_history")) == sorted([f"x{k}" for k in range(50)] + ["y", "z"])
    some = ST.possible(spark.range(1000), spark.range(990, 1000), "id")
    assert [r[0] for r in some.orderBy("id").collect()][-10:] == list(range(990, 1000)) and some.count() < 20


@supplied
def test_the_stored_history_is_the_same_in_slices(spark, monkeypatch):
    want, seen = sorted(map(tuple, catalog.QUERIES["store_history"](spark, FOLDER).collect())), []
    made = ST.Store.append_new
    monkeypatch.setattr(ST.Store, "append_new", lambda self, *a: (seen.append(1), made(self, *a))[1])
    monkeypatch.setattr(catalog, "SLICE_ROWS", 2500)
    assert sorted(map(tuple, catalog.QUERIES["store_history"](spark, FOLDER).collect())) == want and len(seen) == 3


def test_commits_are_read_and_shuffled_once_for_all_of_their_rows(spark, store, tmp_path):
    commits(spark, [{"files": ["a.ts", "b.ts"]}, {"parents": ["p", "q"]}, {"sha": None}]).write.json(str(tmp_path / "in"))
    raw = spark.read.schema(RAW_COMMIT).json(str(tmp_path / "in"))
    rows = H.chunk_commits(raw)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Scan json") == 1
    assert sorted((r["chunk_type"], r["pos"], r["id"] is None) for r in rows.collect()) == [("commit_summary", 0, False), ("commit_summary", 0, False), ("commit_summary", 0, True), ("file_diff", 0, False), ("file_diff", 1, False), ("merge_group", 0, False)]
    store.append_new("git_history", rows)
    plans, insert = [], store.insert
    store.insert = lambda table, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), insert(table, df))
    store.append_new("git_history", H.chunk_commits(ST.dealt_out(raw, "git_history")).where("sha IS NOT NULL"), dealt=True)
    assert plans[0].count("Exchange hashpartitioning(coalesce(sha") == 1 and plans[0].count("Exchange hashpartitioning(__near") <= 1 and store.read("git_history").count() == 6


@supplied
def test_the_stream_is_the_same_in_slices(spark, monkeypatch):
    want = sorted(map(tuple, catalog.QUERIES["stream_ingest"](spark, FOLDER).collect()))
    monkeypatch.setattr(catalog, "SLICE_ROWS", 1000)
    monkeypatch.setattr(ST, "LARGE", 10)
    assert sorted(map(tuple, catalog.QUERIES["stream_ingest"](spark, FOLDER).collect())) == want


def test_patches_of_many_files_take_time_by_their_length(spark):
    n = 4000
    patch = lambda k: f"diff --git a/f{k} b/f{k}\n--- a\n" + "+l\n" * (k % 5) + ("Binary files" if k % 7 == 0 else "")
    text = "".join(f"{k}\t{k}\tf{k}\n" for k in range(n)) + "\n" + "\n".join(patch(k).rstrip("\n") for k in [*range(n), 3]) + "\n"
    rows = spark.createDataFrame([("\0".join(["sha", "a", "e", "d", "s", "b", "p", "refs\n" + text]), 1), ("\0".join("abcdefgh"), 2), ("\0".join("abcdefg"), 3)], "value string, __at long")
    began = time.monotonic()
    got = {r["sha"]: r for r in G.parse_records(rows, GitConfig(max_diff_lines_per_file=5)).collect()}
    assert time.monotonic() - began < 15  # before, every file's patch was cut anew for each of the files
    assert set(got) == {"sha", "a"} and got["a"]["files"] == [] and got["a"]["diffs"] == {} and got["a"]["refs"] == "h"
    diffs = got["sha"]["diffs"]
    assert len(diffs) == n == len(got["sha"]["files"]) and got["sha"]["files"][n - 1]["additions"] == n - 1
    assert diffs["f1"] == "diff --git a/f1 b/f1\n--- a\n+l\n" and diffs["f3"] == "diff --git a/f3 b/f3\n--- a\n+l\n+l\n+l\n... truncated (1 more lines)"
    assert diffs["f4"].endswith("+l\n... truncated (2 more lines)") and diffs["f7"] == "[binary file]"
