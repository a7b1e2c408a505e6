"""Row types, enumerations and configuration of the history-risk engine."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace

from pyspark.sql import types as T

STR, INT, LONG, DBL, BOOL, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


FILE_CHANGE = struct(path=STR, additions=INT, deletions=INT, status=STR)
RAW_COMMIT = struct(sha=STR, author=STR, email=STR, date=STR, subject=STR, body=STR, parents=T.ArrayType(STR), refs=STR, files=T.ArrayType(FILE_CHANGE), diffs=T.MapType(STR, STR), seq=LONG)
HISTORY = struct(
    id=STR, sha=STR, author=STR, email=STR, date=STR, subject=STR, body=STR, chunk_type=STR, commit_type=STR, scope=STR, file_path=STR, text=STR,
    files_changed=INT, additions=INT, deletions=INT, branch=STR, decision_class=STR, ts=TS, seq=LONG, pos=INT,
)
CODE_CHUNK = struct(id=STR, file_path=STR, package_name=STR, name=STR, chunk_type=STR, line_start=INT, line_end=INT, content=STR, language=STR, exported=BOOL, framework_role=STR)
SIGNAL = struct(
    id=STR, type=STR, summary=STR, severity=STR, confidence=DBL, directory_scope=STR, contributing_shas=T.ArrayType(STR), start=TS, end=TS,
    file=STR, affected_files=T.ArrayType(STR), dominant_decision_class=STR, metadata=STR,
)
OWNER = struct(author=STR, percentage=INT, commits=LONG, last_change=TS)
PROFILE = struct(
    path=STR, primary_owner=OWNER, contributor_count=LONG, stability_score=INT, total_changes=LONG, revert_count=LONG, fix_after_feature_count=LONG,
    change_frequency=STR, risk_score=INT, last_modified=TS, active_signal_ids=T.ArrayType(STR),
)
WARNING = struct(severity=STR, category=STR, message=STR, evidence=T.ArrayType(STR), signal_ids=T.ArrayType(STR), rank=INT, emission=STR)

# Enumerations: fixed values.
COMMIT_TYPES = ("feat", "fix", "refactor", "docs", "style", "test", "chore", "perf", "ci", "build", "revert")
DECISION_CLASSES = ("decision", "routine", "unknown")
SIGNAL_TYPES = ("revert_pair", "churn_hotspot", "ownership", "fix_chain", "adoption_cycle", "stability_shift", "breaking_change")
SEVERITY_RANK = {"warning": 0, "caution": 1, "info": 2}
LOCK_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock", "shrinkwrap.json", "npm-shrinkwrap.json", "Gemfile.lock", "Cargo.lock", "poetry.lock", "composer.lock", "go.sum")


@dataclass(frozen=True)
class SignalsConfig:
    churn_sigma_threshold: float = 2.0
    ownership_min_percent: int = 30
    ownership_min_commits: int = 3
    fix_chain_window_days: int = 7
    breaking_window_hours: int = 48
    stability_shift_window_days: int = 30
    #: Without it signals carry their counts only, not the commits, events and authors that were counted: their number grows with the square of a busy directory's commits.
    list_members: bool = True
    #: Parts that large histories are worked through in: each part's results are written, and what was shuffled for it is gone, before the next begins.
    slices: int = 1


@dataclass(frozen=True)
class GitConfig:
    include_file_chunks: bool = True
    include_merge_groups: bool = True
    max_diff_lines_per_file: int = 50
    max_diff_chars_per_file: int = 3000
    enrich_low_quality_messages: bool = True
    low_quality_threshold: int = 10
    skip_bot_authors: tuple[str, ...] = ("dependabot", "renovate", "github-actions")
    skip_message_patterns: tuple[str, ...] = ("^Merge branch", "lock file")
    max_commits: int = 0


# The globs below are fixed values.
@dataclass(frozen=True)
class EngineConfig:
    include: tuple[str, ...] = ("**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.mjs", "**/*.mts", "**/*.py", "**/*.rb", "**/*.rake")
    exclude: tuple[str, ...] = ("node_modules/**", "dist/**", "build/**", ".next/**", "coverage/**", "*.d.ts", "*.min.js", "*.bundle.js", "tmp/**", "log/**", "vendor/bundle/**", ".bundle/**", "db/schema.rb")
    exclude_patterns: tuple[str, ...] = ()
    max_file_lines: int = 2000
    index_tests: bool = False
    chunk_max_tokens: int = 8000
    embedding_provider: str = "hashing"
    embedding_model: str = "hashing-768"
    embedding_api_key: str | None = None
    embedding_base_url: str | None = None
    embedding_batch_size: int = 50
    embedding_concurrency: int = 2
    embedding_dimension: int = 768
    search_limit: int = 5
    store_uri: str | None = None
    max_analyze_chunks: int | None = None
    signals: SignalsConfig = field(default_factory=SignalsConfig)
    git: GitConfig = field(default_factory=GitConfig)


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def merged_config(base, given: dict):
    """base with the values of a parsed file laid over it; keys may be camelCase; exclude_patterns add up."""
    out, known = {}, {f.name for f in fields(base)}
    for key, value in given.items():
        name = _snake(key)
        if name not in known:
            continue
        old = getattr(base, name)
        if is_dataclass(old):
            out[name] = merged_config(old, value if isinstance(value, dict) else {})
        elif name == "exclude_patterns":
            out[name] = (*old, *value)
        else:
            out[name] = tuple(value) if isinstance(value, list) else value
    return replace(base, **out)


def load_config(path: str | None, base: EngineConfig | None = None) -> EngineConfig:
    """The configuration in a JSON file over the defaults; a missing or broken file gives the defaults."""
    base = base or EngineConfig()
    if path is None:
        return base
    try:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
    except (OSError, ValueError):
        return base
    return merged_config(base, given) if isinstance(given, dict) else base


def default_config_json() -> str:
    return json.dumps(asdict(EngineConfig()), indent=2)
