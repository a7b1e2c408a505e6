"""Small history rows for tests."""

import datetime as dt

from strataline.schema import HISTORY, RAW_COMMIT

DAY = dt.timedelta(days=1)
NOW = dt.datetime(2025, 3, 1, 12)


def history(spark, rows):
    base = {f.name: "" for f in HISTORY} | {"files_changed": 1, "additions": 1, "deletions": 0, "pos": 0, "decision_class": "unknown", "author": "Alice", "seq": None}
    out = []
    for i, r in enumerate(rows):
        row = base | {"seq": i} | r
        row["ts"] = row["ts"] or NOW
        row["date"] = row["ts"].isoformat() + "Z"
        out.append(tuple(row[f.name] for f in HISTORY))
    return spark.createDataFrame(out, HISTORY)


def summary(sha, **given):
    return {"sha": sha, "chunk_type": "commit_summary", "ts": NOW} | given


def diff(sha, path, **given):
    return {"sha": sha, "chunk_type": "file_diff", "file_path": path, "ts": NOW} | given


def commits(spark, rows):
    base = {"author": "Alice", "email": "a@x", "date": "2025-01-10T10:00:00+02:00", "subject": "feat(auth): add login", "body": "", "parents": ["p"], "refs": "", "files": [], "diffs": None}
    out = []
    for i, r in enumerate(rows):
        row = base | {"sha": f"{i:040x}", "seq": i} | r
        row["files"] = [f if isinstance(f, tuple) else (f, 1, 0, "M") for f in row["files"]]
        out.append(tuple(row[f.name] for f in RAW_COMMIT))
    return spark.createDataFrame(out, RAW_COMMIT)
