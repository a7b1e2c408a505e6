"""Warnings from profiles and signals, ranked by severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import columns as C
from strataline.schema import SEVERITY_RANK, WARNING

RELEVANT = 0.1


def _c(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def relevance(as_of: Column) -> Column:
    """Decay by age at the signal's end, times the weight of its dominant class."""
    return C.temporal_decay(F.col("end"), as_of, C.decay_half_life(F.col("type"))) * C.decision_weight(F.col("dominant_decision_class"))


def _rows(df: DataFrame, severity: Column, category: str, message: Column, evidence: Column, ids: Column, emission: Column) -> DataFrame:
    rank = F.coalesce(*[F.when(severity == s, r) for s, r in SEVERITY_RANK.items()], F.lit(3))
    values = dict(severity=severity, category=F.lit(category), message=message, evidence=evidence, signal_ids=ids, rank=rank, emission=emission)
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in WARNING])


def warnings(profiles: DataFrame, signals: DataFrame, as_of: Column, change_type: str | None = None) -> DataFrame:
    """Warning rows with their severity rank and emission key; order by both for the reading order. The texts are fixed values.

    Profiles and signals that only count their ids and commits give no signal_ids and evidence.
    """
    none, p = F.array().cast("array<string>"), F.col("path")
    ids = F.col("active_signal_ids") if "active_signal_ids" in profiles.columns else F.lit(None)
    n = F.col("revert_count")
    out = [
        _rows(profiles.where("stability_score < 30"), F.lit("warning"), "stability", _c(p, " has a stability score of ", F.col("stability_score"), "/100. Changed ", F.col("total_changes"), " times with ", n, " revert", C.plural(n), "."), none, ids, _c("1:", p))
    ]
    if change_type == "refactor":
        out.append(_rows(profiles.where("stability_score >= 30 AND stability_score < 50"), F.lit("caution"), "stability", _c("Refactoring a volatile area: ", p, " (stability ", F.col("stability_score"), "/100). Consider smaller incremental changes."), none, ids, _c("1:", p)))
    o = F.col("primary_owner")
    owned = o.isNotNull() & (o["percentage"] >= 30)
    mine = _c(o["author"], " owns ", p, " (", o["percentage"], "% of changes, ", o["commits"], " commits). Last active: ", F.date_format(o["last_change"], "yyyy-MM-dd"), ".")
    shared = _c("No clear owner for ", p, ". ", F.col("contributor_count"), " contributors", F.when(o.isNotNull(), _c(", highest is ", o["percentage"], "%")).otherwise(F.lit("")), ".")
    out.append(_rows(profiles.where(owned | (F.col("contributor_count") > 0)), F.lit("info"), "ownership", F.when(owned, mine).otherwise(shared), none, ids, _c("2:", p)))

    live = signals.where(relevance(as_of) >= RELEVANT)
    m = lambda k: F.get_json_object("metadata", f"$.{k}")
    one = F.array("id")
    seven = lambda k: F.substring(m(k), 1, 7)
    fixes, days = m("fix_count").cast("int"), m("day_span").cast("int")
    rules = {
        "revert_pair": (F.lit("caution"), "pattern", _c("A previous change to this area was reverted (", F.coalesce(seven("original_sha"), F.lit("unknown")), ", ", F.when(m("time_to_revert_days").isNotNull(), _c(m("time_to_revert_days"), " days after landing")).otherwise(F.lit("timing unknown")), "). ", m("original_subject")), F.col("contributing_shas")),
        "fix_chain": (F.col("severity"), "pattern", _c('Feature "', m("feature_subject"), '" (', seven("feature_sha"), ") required ", fixes, " follow-up fix", C.plural(fixes, many="es"), " over ", days, " day", C.plural(days), "."), F.col("contributing_shas")),
        "churn_hotspot": (F.lit("info"), "churn", _c(m("file"), " is a churn hotspot (", m("count"), " changes, ", m("sigma"), "σ above repo mean). Trend: ", m("trend"), "."), F.slice("contributing_shas", 1, 5)),
        "breaking_change": (F.lit("warning"), "breaking", _c("A previous change here (", seven("trigger_sha"), ") caused fixes from ", m("author_count"), " different authors within 48 hours. Blast radius: ", m("affected_files"), " files."), F.col("contributing_shas")),
        "adoption_cycle": (F.lit("warning"), "pattern", _c(F.coalesce(m("subject"), F.lit("This dependency")), " has gone through ", m("cycle_count"), " adoption cycles. Current status: ", m("current_status"), "."), F.col("contributing_shas")),
    }
    for kind, (severity, category, message, evidence) in rules.items():
        out.append(_rows(live.where(F.col("type") == kind), severity, category, message, evidence, one, _c("3:", F.date_format("end", "yyyyMMddHHmmss"), ":", F.col("id"))))
    return reduce(DataFrame.unionByName, out)


def ranked(rows: DataFrame) -> DataFrame:
    return rows.orderBy("rank", "emission", "message")
