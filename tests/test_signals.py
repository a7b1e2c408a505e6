import json

import pytest
from builders import DAY, NOW, diff, history, summary
from pyspark.sql import functions as F

from strataline.operators import profiles as P
from strataline.operators import warnings as W
from strataline.operators.signals import adoption, breaking, churn, fix_chain, ownership, revert, stability
from strataline.operators.signals import pipeline as S
from strataline.schema import SIGNAL, SignalsConfig



def clock(ts=NOW):
    return F.lit(ts).cast("timestamp")



def run(spark, detect, rows, **config):
    from strataline.schema import SignalsConfig

    got = detect(history(spark, rows), clock(), SignalsConfig(**config)).collect()
    return [r.asDict(True) | json.loads(r["metadata"]) for r in got]


def test_churn_flags_the_outlier(spark):
    rows = [diff(f"a{i}", "src/a.ts", ts=NOW - i * DAY) for i in range(20)] + [diff(f"b{i}", f"src/f{i}.ts") for i in range(8)]
    (s,) = run(spark, churn.detect, rows)
    assert s["file"] == "src/a.ts" and s["count"] == 20 and s["trend"] == "increasing" and len(s["contributing_shas"]) == 20 and s["directory_scope"] == "src"


def test_churn_is_silent_when_all_files_are_alike(spark):
    assert run(spark, churn.detect, [diff(f"{f}{i}", f) for f in ("a", "b", "c") for i in range(2)]) == []
    assert run(spark, churn.detect, []) == []


def test_churn_severity(spark):
    rows = [diff(f"a{i}", "a.ts") for i in range(50)] + [diff(f"b{i}", f"f{i}") for i in range(10)]
    (s,) = run(spark, churn.detect, rows)
    assert s["severity"] == "warning" and s["directory_scope"] == "." and s["confidence"] == pytest.approx(0.6 + 0.1 * s["sigma"], abs=0.01)


def test_dominant_class_ties_prefer_decisions(spark):
    rows = [summary("s0", decision_class="decision"), summary("s1", decision_class="routine")] + [diff(f"s{i % 2}", "a.ts") for i in range(20)] + [diff(f"b{i}", f"f{i}") for i in range(8)]
    (s,) = run(spark, churn.detect, rows)
    assert s["dominant_decision_class"] == "decision"


def test_ownership_cut_offs(spark):
    two = [diff("1", "src/a.ts"), diff("2", "src/a.ts")]
    assert run(spark, ownership.detect, two) == []
    spread = [diff(str(i), "src/a.ts", author=f"u{i}") for i in range(10)]
    assert run(spark, ownership.detect, spread) == []
    got = run(spark, ownership.detect, [diff(str(i), "src/a.ts", author="Bob" if i < 3 else "Eve") for i in range(5)])
    assert {(s.get("file"), s.get("directory"), s["percentage"]) for s in got} == {("src/a.ts", None, 60), (None, "src", 60)}
    assert got[0]["contributors"][0] == {"author": "Bob", "percentage": 60, "commits": 3}


def test_ownership_ties_go_to_the_first_author(spark):
    got = run(spark, ownership.detect_files, [diff(str(i), "a.ts", author="Zed" if i % 2 == 0 else "Abe") for i in range(4)])
    assert got[0]["primary_author"] == "Zed"


def test_fix_chain_window(spark):
    rows = [summary("f", commit_type="feat", subject="feat: x"), diff("f", "src/a.ts")]
    near = [summary("x", commit_type="fix", ts=NOW + 2 * DAY), diff("x", "src/a.ts", ts=NOW + 2 * DAY), diff("x", "lib/z.ts", ts=NOW + 2 * DAY, pos=1)]
    far = [summary("y", commit_type="fix", ts=NOW + 8 * DAY), diff("y", "src/a.ts", ts=NOW + 8 * DAY)]
    (s,) = run(spark, fix_chain.detect, rows + near + far)
    assert s["fix_count"] == 1 and s["day_span"] == 2 and s["affected_files"] == ["src/a.ts", "lib/z.ts"] and s["directory_scope"] == "src" and s["contributing_shas"] == ["f", "x"]
    assert run(spark, fix_chain.detect, rows + far) == []
    edge = [summary("z", commit_type="fix", ts=NOW + 7 * DAY), diff("z", "src/a.ts", ts=NOW + 7 * DAY)]
    assert len(run(spark, fix_chain.detect, rows + edge)) == 1
    same = [summary("w", commit_type="fix"), diff("w", "src/a.ts")]
    assert run(spark, fix_chain.detect, rows + same) == []


def breaking_rows(*fixes):
    rows = [summary("t", commit_type="feat", subject="feat: t"), diff("t", "src/a.ts")]
    for i, (author, hours, path) in enumerate(fixes):
        ts = NOW + hours * DAY / 24
        rows += [summary(f"x{i}", commit_type="fix", author=author, ts=ts), diff(f"x{i}", path, author=author, ts=ts)]
    return rows


def test_breaking_changes(spark):
    (s,) = run(spark, breaking.detect, breaking_rows(("Bob", 5, "src/a.ts"), ("Eve", 47, "src/b.ts")))
    assert s["author_count"] == 2 and s["severity"] == "warning" and s["directory_scope"] == "src" and json.loads(s["metadata"])["affected_files"] == 2
    assert run(spark, breaking.detect, breaking_rows(("Bob", 5, "src/a.ts"), ("Bob", 6, "src/a.ts"))) == []
    assert run(spark, breaking.detect, breaking_rows(("Bob", 73, "src/a.ts"), ("Eve", 80, "src/a.ts"))) == []
    assert run(spark, breaking.detect, breaking_rows(("Alice", 1, "src/a.ts"), ("Eve", 2, "src/a.ts"))) == []
    assert len(run(spark, breaking.detect, [r | ({"file_path": r["file_path"].replace("src/", "")} if r.get("file_path") else {}) for r in breaking_rows(("Bob", 5, "src/x.ts"), ("Eve", 7, "src/y.ts"))])) == 1


def test_reverts(spark):
    full = "aaaa1111" + "0" * 32
    rows = [
        summary(full, subject="feat: add", files_changed=2), diff(full, "src/x/a.ts"), diff(full, "src/y/b.ts", pos=1),
        summary("r1", subject='Revert "feat: add"', body="This reverts commit aaaa1111.", ts=NOW + 3 * DAY),
        summary("r2", subject='revert "feat: add"', ts=NOW + 1 * DAY), summary("r3", subject="Revert something", body=""), summary("r4", subject=f"revert: it reverts commit {full}"),
    ]
    got = {s["revert_sha"]: s for s in run(spark, revert.detect, rows)}
    assert set(got) == {"r1", "r2", "r3", "r4"}
    assert got["r1"]["original_sha"] == full and got["r1"]["affected_files"] == ["src/x/a.ts", "src/y/b.ts"] and got["r1"]["directory_scope"] == "src" and got["r1"]["time_to_revert_days"] == 3
    assert got["r2"]["original_sha"] == full and got["r4"]["original_sha"] == full
    assert got["r3"].get("original_sha") is None and got["r3"]["confidence"] == 0.6 and got["r3"]["directory_scope"] == "."


def manifest(sha, day, *lines):
    return diff(sha, "package.json", ts=NOW + day * DAY, text="\n".join(lines))


def test_adoption_cycles(spark):
    plus, minus = '+  "lodash": "1"', '-  "lodash": "1"'
    (s,) = run(spark, adoption.detect, [manifest("a", 0, plus), manifest("b", 1, minus), manifest("c", 2, plus)])
    assert (s["subject"], s["cycle_count"], s["transitions"], s["current_status"]) == ("lodash", 1, 2, "active")
    assert run(spark, adoption.detect, [manifest("a", 0, plus), manifest("b", 1, plus, minus), manifest("c", 2, minus)]) == []
    assert run(spark, adoption.detect, [manifest(c, i, x.replace("lodash", "@types/node")) for i, (c, x) in enumerate(zip("abc", (plus, minus, plus), strict=True))]) == []


def test_stability_shifts(spark):
    def rows(recent, previous, filler):
        counts = [(5, recent), (45, previous), (200, filler)]
        return [diff(f"{d}-{i}", "src/app/f.ts", ts=NOW - d * DAY) for d, n in counts for i in range(n)]

    (s,) = run(spark, stability.detect, rows(8, 3, 0))
    assert s["shift"] == "destabilized" and s["severity"] == "caution" and s["directory"] == "src/app"
    (s,) = run(spark, stability.detect, rows(1, 8, 3))
    assert s["shift"] == "stabilized" and s["severity"] == "info"
    (s,) = run(spark, stability.detect, rows(0, 8, 3))
    assert s["dominant_decision_class"] == "decision" and s["contributing_shas"] == []
    assert run(spark, stability.detect, rows(8, 0, 5)) == [] and run(spark, stability.detect, rows(4, 2, 0)) == []


def test_pipeline_is_the_union_of_its_detectors(spark):
    h = history(spark, breaking_rows(("Bob", 5, "src/a.ts"), ("Eve", 7, "src/a.ts")))
    every = S.detect(h, clock())
    assert sorted(r["id"] for r in every.collect()) == sorted(r["id"] for n in S.DETECTORS for r in S.DETECTORS[n](h, clock()).collect())
    assert {r["type"] for r in every.collect()} <= {"fix_chain", "breaking_change", "ownership"}


def test_profiles_and_warnings(spark):
    full = "ab" * 20
    rows = [summary(full, subject="feat: q", commit_type="feat")] + [diff(full, "src/a.ts")] + [diff(f"d{i}", "src/a.ts", author=f"u{i % 7}", ts=NOW - i * DAY) for i in range(13)]
    rows += [summary(f"r{i}", subject=f"Revert it {i}", body=f"This reverts commit {full}") for i in range(2)] + [diff("one", "src/b.ts"), diff("two", "root.ts"), diff("three", "root.ts", author="Bob")]
    h = history(spark, rows)
    signals = S.detect(h, clock(), names=["revert"])
    got = {r["path"]: r for r in P.file_profiles(h, signals).collect()}
    assert set(got) == {"src/a.ts", "root.ts"}  # one change is too few
    a = got["src/a.ts"]
    assert a["total_changes"] == 14 and a["revert_count"] == 4 and a["primary_owner"] is None and a["contributor_count"] == 8 and len(a["active_signal_ids"]) == 2
    assert 0 <= a["stability_score"] <= 100 and a["change_frequency"] == "daily" and a["risk_score"] >= 35
    assert got["root.ts"]["primary_owner"]["author"] == "Alice" and got["root.ts"]["revert_count"] == 0
    rows = W.ranked(W.warnings(P.file_profiles(h, signals), signals, clock(), "refactor")).collect()
    assert [r["rank"] for r in rows] == sorted(r["rank"] for r in rows)
    assert any(r["category"] == "ownership" and r["message"].startswith("No clear owner for src/a.ts. 8 contributors") for r in rows)
    assert sum(r["category"] == "pattern" for r in rows) == 2
    old = clock(NOW + 2000 * DAY)
    assert not [r for r in W.warnings(P.file_profiles(h, signals), signals, old).collect() if r["category"] == "pattern"]


def test_breaking_changes_against_brute_force(spark):
    import random

    rng = random.Random(7)
    rows, told, files = [], {}, {}
    for i in range(160):
        sha, author, ts = f"c{i:03d}", rng.choice(["A", "B", "C", None]), NOW + DAY * rng.randrange(0, 40) / 4
        kind = rng.choice(["fix", "feat", "docs", None])
        paths = [rng.choice(["", "a/", "b/", "b/c/"]) + f"f{rng.randrange(6)}.ts" for _ in range(rng.randrange(0, 5))]  # repeated ones too
        rows.append(summary(sha, author=author, ts=ts, commit_type=kind, subject=f"s{i}", decision_class=rng.choice(["decision", "routine", "unknown"])))
        rows += [diff(sha, p, author=author, ts=ts, pos=k) for k, p in enumerate(paths)]
        told[sha], files[sha] = (author, ts, kind, i), paths
    dirs = {s: {p.rpartition("/")[0] or "." for p in f} for s, f in files.items()}
    want = {}
    for s, (author, ts, kind, _) in told.items():
        after = [x for x, (a, t, k, _) in told.items() if kind != "fix" and k == "fix" and ts < t <= ts + 2 * DAY and None not in (a, author) and a != author and dirs[s] & dirs[x]]
        if len({told[x][0] for x in after}) >= 2:
            after.sort(key=lambda x: (told[x][1], told[x][3], x))
            want[s] = (len({told[x][0] for x in after}), len(after), len({p for x in [s, *after] for p in files[x]}), files[s][0].rpartition("/")[0] or ".", [s, *after], max(told[x][1] for x in after))
    h = history(spark, rows)
    for config in (SignalsConfig(), SignalsConfig(list_members=False)):
        found = breaking.detect(h, clock(), config)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # pairs are never rows
        got = {}
        for r in found.collect():
            m = json.loads(r["metadata"])
            got[m["trigger_sha"]] = (m["author_count"], m["fix_count"], m["affected_files"], r["directory_scope"], r["contributing_shas"], r["end"])
            assert ("fix_shas" in m) == config.list_members
        assert len(want) > 10 and got == {k: v if config.list_members else (*v[:4], None, v[5]) for k, v in want.items()}
    few, breaking.CELLS = breaking.CELLS, 50  # some leads at a time
    try:
        assert {json.loads(r["metadata"])["trigger_sha"]: tuple(r["contributing_shas"]) for r in breaking.detect(h, clock()).collect()} == {k: tuple(v[4]) for k, v in want.items()}
    finally:
        breaking.CELLS = few


def test_profiles_count_signals_without_gathering_them(spark):
    h = history(spark, [diff(f"d{i}", p) for i, p in enumerate(["a/x.ts", "a/x.ts", "a/b/y.ts", "a/b/y.ts", "r.ts", "r.ts"])])
    given = [("1", "a", None), ("2", "a/b", None), ("2", "a", None), ("3", ".", "r.ts"), ("4", ".", "a/x.ts"), ("4", "a", None), ("5", "a/b", "a/b/y.ts"), ("6", "z", "a/x.ts"), ("6", "z", "a/x.ts")]
    base = {f.name: None for f in SIGNAL} | {"type": "ownership"}
    signals = spark.createDataFrame([tuple((base | {"id": i, "directory_scope": d, "file": f})[x.name] for x in SIGNAL) for i, d, f in given], SIGNAL)
    counted = P.counted_profiles(h, signals)
    want = {"a/x.ts": ["1", "2", "4", "6"], "a/b/y.ts": ["1", "2", "4", "5"], "r.ts": ["3"]}
    assert {r["path"]: r["active_signal_ids"] for r in P.file_profiles(h, signals).collect()} == want
    assert {r["path"]: r["n_active"] for r in counted.collect()} == {k: len(v) for k, v in want.items()}
    assert "active_signal_ids" not in counted.columns
