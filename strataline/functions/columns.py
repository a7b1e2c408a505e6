"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataline.schema import COMMIT_TYPES, DECISION_CLASSES, LOCK_FILES


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dirname(path: Column | str) -> Column:
    """Everything before the last slash; '.' for a file at the root."""
    p = col(path)
    return F.when(F.instr(p, "/") == 0, F.lit(".")).otherwise(F.substring(p, F.lit(1), F.length(p) - F.length(F.substring_index(p, "/", -1)) - 1))


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def top_directory(path: Column | str, depth: int = 2) -> Column:
    """The first segments of a file's directory."""
    return F.substring_index(dirname(path), "/", depth)


def ancestors(path: Column | str) -> Column:
    """Every directory above a path, nearest last; empty for a file at the root."""
    parts = F.split(col(path), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.when(F.size(parts) > 1, up).otherwise(F.array().cast("array<string>"))


def common_directory(low: Column, high: Column) -> Column:
    """The common ancestor of a set of directories, from the smallest and the largest as segment arrays."""
    n = F.least(F.size(low), F.size(high))
    same = F.filter(F.sequence(F.lit(1), n), lambda k: F.slice(low, F.lit(1), k) == F.slice(high, F.lit(1), k))
    return F.when(F.size(same) > 0, F.array_join(F.slice(low, F.lit(1), F.size(same)), "/")).otherwise(F.lit("."))


def short_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts' concatenation."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def signal_id(kind: str, *parts: Column) -> Column:
    return short_id(F.concat(F.lit(kind), F.concat_ws(":", *parts)))


def half_up(x: Column) -> Column:
    """Rounding to whole numbers with halves going up, negative ones included."""
    return F.floor(x + F.lit(0.5))


def percent(part: Column, whole: Column) -> Column:
    return half_up(part / whole * 100).cast("int")


def to_ts(date: Column | str) -> Column:
    """ISO-8601 text with any offset as an instant; null if it can't be read."""
    return F.try_to_timestamp(col(date))


def micros_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def days_between(later: Column, earlier: Column) -> Column:
    return micros_between(later, earlier) / F.lit(86_400_000_000)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def plural(n: Column, one: str = "", many: str = "s") -> Column:
    return F.when(n == 1, F.lit(one)).otherwise(F.lit(many))


def dominant(counts: dict[str, Column]) -> Column:
    """The class with the largest count; of equal ones the first in the fixed order; the first if all are 0."""
    d, r, u = (counts[c] for c in DECISION_CLASSES)
    return F.when((d >= r) & (d >= u), F.lit("decision")).when(r >= u, F.lit("routine")).otherwise(F.lit("unknown"))


def class_counts(column: Column | str) -> list[Column]:
    return [F.count_if(col(column) == c).alias(f"n_{c}") for c in DECISION_CLASSES]


def dominant_of_counts() -> Column:
    return dominant({c: F.col(f"n_{c}") for c in DECISION_CLASSES})


# The patterns down to LOW_QUALITY are fixed values.
CONVENTIONAL = rf"^({'|'.join(COMMIT_TYPES)})(\(([^)]+)\))?!?:\s"
CONFIG_FILES = r"(?i)package\.json$|\.config\.(ts|js|mjs)$|tsconfig|\.env|dockerfile|docker-compose"
LOCK_PATTERN = r"(?i)lock\.json$|\.lock$|go\.sum$"
LOW_QUALITY = r"(?i)^(fix|wip|update|tmp|test|cleanup|minor|typo|\.)"


def commit_type(subject: Column | str) -> Column:
    return F.regexp_extract(col(subject), CONVENTIONAL, 1)


def commit_scope(subject: Column | str) -> Column:
    return F.regexp_extract(col(subject), CONVENTIONAL, 3)


def branch_of(refs: Column | str, subject: Column | str) -> Column:
    """The first ref that is no tag, without 'HEAD -> '; else the word after 'from' in the subject; else empty."""
    names = F.transform(F.split(F.coalesce(col(refs), F.lit("")), ","), lambda r: F.regexp_replace(F.trim(r), "^HEAD -> ", ""))
    named = F.get(F.filter(names, lambda r: (r != "") & ~r.startswith("tag:")), F.lit(0))
    return F.coalesce(named, F.regexp_extract(col(subject), r"(?i)from\s+(\S+)", 1))


def is_lock_file(path: Column) -> Column:
    return basename(path).isin(*LOCK_FILES)


def decision_class(subject: Column | str, paths: Column) -> Column:
    """decision, routine or unknown, from a commit's subject and its array of paths."""
    s, n = F.lower(col(subject)), F.size(paths)
    decided = s.rlike("^(feat|refactor|revert|perf)") | (n > 10) | F.exists(paths, lambda p: p.rlike(CONFIG_FILES))
    routine = (s.startswith("fix") & (n <= 3)) | F.forall(paths, lambda p: p.rlike(LOCK_PATTERN))
    return F.when(decided, "decision").when(routine, "routine").otherwise("unknown")


def infer_scope(path: Column | str) -> Column:
    """The two segments after 'src' when two or more follow, else the first segment; empty for an empty path."""
    parts = F.split(col(path), "/")
    at = F.array_position(parts, "src")
    return F.when(col(path) == "", F.lit("")).when((at > 0) & (at + 2 <= F.size(parts)), F.array_join(F.slice(parts, (at + 1).cast("int"), 2), "/")).otherwise(F.get(parts, F.lit(0)))


def capped(text: Column, n: int) -> Column:
    """Text of at most n characters, with a note of how many were cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("\n... truncated ("), (F.length(text) - n).cast("string"), F.lit(" more chars)"))).otherwise(text)


def estimate_tokens(text: Column | str) -> Column:
    return F.ceil(F.length(col(text)) / 4)


DEPENDENCY_NOISE = ("version", "name")


def dependencies(text: Column | str, sign: str) -> Column:
    """Distinct dependency names on lines with a sign ('+' or '-') in a manifest's diff."""
    found = F.regexp_extract_all(col(text), F.lit(rf'\{sign}\s*"([^"]+)":\s*"[^"]*"'), F.lit(1))
    return F.array_distinct(F.filter(found, lambda d: ~d.startswith("@types/") & ~d.isin(*DEPENDENCY_NOISE)))


def change_frequency(per_day: Column) -> Column:
    return F.when(per_day >= 1, "daily").when(per_day >= 1 / 7, "weekly").when(per_day >= 1 / 30, "monthly").otherwise("rare")


def stability_score(reverts: Column, fixes: Column, per_day: Column) -> Column:
    lost = F.least(F.lit(30), reverts * 10) + F.least(F.lit(20), fixes * 5) + F.least(F.lit(30.0), F.greatest(F.lit(0.0), (per_day - 0.1) * 100))
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(F.lit(100) - lost))).cast("int")


def risk_score(stability: Column, contributors: Column, reverts: Column, fixes: Column) -> Column:
    raw = (100 - stability) * 0.5 + F.when(contributors > 5, 15).otherwise(0) + F.when(reverts > 0, 20).otherwise(0) + F.when(fixes > 0, 15).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), half_up(raw))).cast("int")


def temporal_decay(ts: Column, as_of: Column, half_life_days: Column | float = 90.0) -> Column:
    """0.5 to the power of age over half-life."""
    return F.pow(F.lit(0.5), days_between(as_of, ts) / half_life_days)


def decay_half_life(kind: Column) -> Column:
    return F.when(kind.isin("revert_pair", "breaking_change"), F.lit(180.0)).otherwise(F.lit(90.0))


def decision_weight(cls: Column) -> Column:
    return F.when(cls == "decision", 1.5).when(cls == "routine", 0.5).otherwise(1.0)


def cosine(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """Cosine similarity of two arrays in double precision; null for a zero vector. ``b_norm`` is the length of b where it is known."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return F.try_divide(dot, norm(a) * (norm(b) if b_norm is None else b_norm))
