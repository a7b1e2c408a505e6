import pytest
from builders import commits
from pyspark.sql import functions as F

from strataline.functions import columns as C
from strataline.operators import history as H
from strataline.schema import EngineConfig, GitConfig, load_config, merged_config
from strataline.sources import gitlog as G


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("subject", "kind", "scope"),
    [("feat(auth): add", "feat", "auth"), ("fix!: y", "fix", ""), ("chore: z", "chore", ""), ("feature: no", "", ""), ("feat:no space", "", ""), ("revert(a b)!: q", "revert", "a b")],
)
def test_conventional_subjects(spark, subject, kind, scope):
    row = spark.createDataFrame([(subject,)], "s string").select(C.commit_type("s").alias("k"), C.commit_scope("s").alias("c")).first()
    assert (row["k"], row["c"]) == (kind, scope)


@pytest.mark.parametrize(("refs", "subject", "branch"), [("HEAD -> main, origin/x", "s", "main"), ("tag: v1, dev", "s", "dev"), ("", "Merge pull request #1 from me/topic", "me/topic"), ("tag: v1", "plain", "")])
def test_branches(spark, refs, subject, branch):
    assert spark.createDataFrame([(refs, subject)], "r string, s string").select(C.branch_of("r", "s")).first()[0] == branch


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.ts",), ("x.ts",)], "p string")
    got = df.select(C.dirname("p"), C.basename("p"), C.top_directory("p"), C.ancestors("p")).collect()
    assert [tuple(r) for r in got] == [("a/b", "c.ts", "a/b", ["a", "a/b"]), (".", "x.ts", ".", [])]


@pytest.mark.parametrize(("x", "want"), [(2.5, 3), (-2.5, -2), (0.49, 0), (-0.5, 0)])
def test_half_up(spark, x, want):
    assert spark.createDataFrame([(x,)], "x double").select(C.half_up(F.col("x"))).first()[0] == want


@pytest.mark.parametrize(
    ("subject", "files", "want"),
    [
        ("feat: x", ["a.ts"], "decision"), ("fix: x", ["a.ts"], "routine"), ("fix: x", list("abcd"), "unknown"), ("chore: x", [str(i) for i in range(11)], "decision"), ("docs: x", ["tsconfig.json"], "decision"),
        ("chore: x", ["yarn.lock"], "routine"), ("docs: x", [], "routine"), ("docs: x", ["a.md"], "unknown"),
    ],
)
def test_decision_classes(spark, subject, files, want):
    df = H.chunk_commits(commits(spark, [{"subject": subject, "files": files}]))
    assert H.summaries(df).first()["decision_class"] == want


def test_skipped_commits(spark):
    rows = [{"author": "Renovate Bot"}, {"subject": "Merge branch 'x'"}, {"subject": "update lock file"}, {"parents": ["a", "b"]}, {"files": ["yarn.lock", "a/go.sum"]}, {"files": ["yarn.lock", "a.ts"]}, {"files": []}]
    assert sorted(r["seq"] for r in H.kept_commits(commits(spark, rows)).collect()) == [5, 6]
    assert [r["seq"] for r in H.kept_commits(commits(spark, rows), GitConfig(max_commits=1)).collect()] == [6]


def test_the_limit_takes_the_newest_commits_of_a_log(spark, tmp_path):
    """As the log's own order: its first kept records."""
    import os
    import subprocess

    run = lambda *a, **k: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, text=True, env=os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null"} | k).stdout
    run("init", "-q", "-b", "main")
    for i in range(6):
        (tmp_path / "a.py").write_text(f"x = {i}\n")
        run("add", "-A")
        when = f"2025-01-0{i + 1}T00:00:00Z"
        run("-c", "user.name=dependabot" if i == 4 else "user.name=Ann", "-c", "user.email=a@x", "commit", "-q", "-m", f"fix: step {i}", GIT_AUTHOR_DATE=when, GIT_COMMITTER_DATE=when)
    raw = G.commits(spark, str(tmp_path), str(tmp_path / "staging"))
    log = [s for s in run("log", "--format=%s").splitlines() if "step 4" not in s]
    for n in (1, 2, 3, 50):
        assert [r["subject"] for r in H.kept_commits(raw, GitConfig(max_commits=n)).orderBy(F.desc("seq")).collect()] == log[:n]
    sha = run("rev-parse", "HEAD").strip()
    patch = G.file_diff(str(tmp_path), sha, "a.py")
    assert "-x = 4" in patch and "+x = 5" in patch and G.file_diff(str(tmp_path), sha, "a.py", 2).endswith("more lines)") and G.file_diff(str(tmp_path), "0" * 40, "a.py") == ""


def test_chunks_and_texts(spark):
    raw = commits(spark, [{"body": "why", "files": [("src/a.ts", 3, 1, "M"), ("b.md", 1, 0, "M")], "parents": ["p", "q"], "diffs": {"src/a.ts": "x" * 3100}}])
    got = {(r["chunk_type"], r["file_path"]): r for r in H.chunk_commits(raw).collect()}
    assert set(got) == {("commit_summary", ""), ("file_diff", "src/a.ts"), ("file_diff", "b.md"), ("merge_group", "")}
    s = got["commit_summary", ""]
    assert s["text"].split("\n") == ['Commit by Alice on 2025-01-10T10:00:00+02:00: "feat(auth): add login"', "why", "", "Files changed:", "  src/a.ts (+3/-1)", "  b.md (+1/-0)", "Directories affected: src"]
    assert (s["additions"], s["deletions"], s["files_changed"], s["ts"].hour) == (4, 1, 2, 8)
    assert got["file_diff", "src/a.ts"]["text"].endswith("\n... truncated (100 more chars)")
    assert got["file_diff", "b.md"]["text"].startswith("b.md changed (+1/-0) in commit")
    assert "Parents: p, q" in got["merge_group", ""]["text"]
    assert len({r["id"] for r in got.values()}) == 4


def test_enrichment_replaces_poor_messages_only(spark):
    rows = [{"subject": "wip", "files": ["src/a/b/c.ts"]}, {"subject": "feat(auth): add login", "files": ["a"]}]
    got = {r["subject"]: r["text"] for r in H.summaries(H.ingest(commits(spark, rows))).collect()}
    assert "Files changed: 1 (1 additions, 0 deletions)" in got["wip"]
    assert "Files changed:\n" in got["feat(auth): add login"]


def test_scope_inference(spark):
    df = spark.createDataFrame([("pkg/src/a/b/c.ts",), ("src/a.ts",), ("",)], "p string")
    assert [r[0] for r in df.select(C.infer_scope("p")).collect()] == ["a/b", "src", ""]


def record(sha, subject="s", body="b", numbers="", patch=""):
    return "\0".join([sha, "An Author", "a@x", "2025-01-01T00:00:00Z", subject, body, "p1", "HEAD -> main"]) + f"\n\n{numbers}{patch}"


def test_log_records(spark):
    patch = "diff --git a/x.ts b/x.ts\n@@\n+1\n" + "diff --git a/img b/img\nBinary files differ\n"
    rows = [(record("a" * 40, body="line one\nline two", numbers="3\t1\tx.ts\n-\t-\timg\n2\t0\ta\tb\n", patch=patch), 0), ("broken", 1)]
    got = G.parse_records(spark.createDataFrame(rows, "value string, __at long"), GitConfig(max_diff_lines_per_file=2)).collect()
    assert len(got) == 1
    assert got[0]["body"] == "line one\nline two" and got[0]["parents"] == ["p1"] and got[0]["refs"] == "HEAD -> main"
    assert [(f["path"], f["additions"], f["deletions"]) for f in got[0]["files"]] == [("x.ts", 3, 1), ("img", 0, 0), ("a\tb", 2, 0)]
    assert got[0]["diffs"]["img"] == "[binary file]" and got[0]["diffs"]["x.ts"].endswith("... truncated (2 more lines)")


def test_configuration(tmp_path):
    base = EngineConfig(exclude_patterns=("a",))
    c = merged_config(base, {"searchLimit": 9, "excludePatterns": ["b"], "git": {"maxCommits": 3}, "other": 1})
    assert (c.search_limit, c.exclude_patterns, c.git.max_commits, c.git.include_file_chunks) == (9, ("a", "b"), 3, True)
    (tmp_path / "bad.json").write_text("{")
    assert load_config(str(tmp_path / "bad.json")) == EngineConfig()
