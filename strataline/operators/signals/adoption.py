"""Adoption cycles: dependencies that are added and removed again and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataline.functions import columns as C
from strataline.operators.history import file_diffs
from strataline.operators.signals.common import classed, signal_rows, sliced
from strataline.schema import SignalsConfig
from strataline.sources.scratch import materialized


def dependency_events(history: DataFrame) -> DataFrame:
    """(dep, event, ts, seq, sha) from diffs of package.json; a dependency on both sides of a diff is a version bump, no event."""
    rows = file_diffs(history).where(F.col("file_path").endswith("package.json")).select("sha", "ts", "seq", C.dependencies("text", "+").alias("plus"), C.dependencies("text", "-").alias("minus"))
    shared = ["sha", "ts", "seq"]
    added = rows.select(*shared, F.explode(F.array_except("plus", "minus")).alias("dep"), F.lit("add").alias("event"))
    removed = rows.select(*shared, F.explode(F.array_except("minus", "plus")).alias("dep"), F.lit("remove").alias("event"))
    return added.unionByName(removed)


def _by_month(events: DataFrame) -> DataFrame:
    """A row for each dependency and month: what happened in it, and its first and last event.

    So a dependency's events are ordered a month at a time, and only months are ordered over its whole life.
    """
    order = F.struct("ts", "seq", "event", "sha")
    events = events.withColumn("month", F.date_trunc("month", "ts"))
    step = Window.partitionBy("dep", "month").orderBy("ts", "seq", "event", "sha")
    events = events.withColumn("changed", F.coalesce(F.col("event") != F.lag("event").over(step), F.lit(False)))
    return events.groupBy("dep", "month").agg(
        F.count("*").alias("n"), F.count_if("changed").alias("inner"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.min_by("event", order).alias("first"), F.max_by("event", order).alias("last"),
        F.sort_array(F.collect_list(order)).alias("events"), *C.class_counts("cls"),
    )


def detect(history: DataFrame, as_of: Column, config: SignalsConfig = SignalsConfig()) -> DataFrame:
    events = classed(dependency_events(history), history)
    events = materialized(events, "dependency-events") if config.slices > 1 else events
    return sliced(events, "dep", config.slices, lambda rows: _signals(rows, config), "cycles")


def _signals(events: DataFrame, config: SignalsConfig) -> DataFrame:
    months = _by_month(events)
    order = Window.partitionBy("dep").orderBy("month")
    months = months.withColumn("turn", F.coalesce((F.col("first") != F.lag("last").over(order)).cast("int"), F.lit(0)))
    deps = months.groupBy("dep").agg(
        F.sum("n").alias("n"), F.sum(F.col("inner") + F.col("turn")).alias("transitions"), F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("last", "month").alias("last"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("month", "events"))), lambda x: x["events"])).alias("events"), *[F.sum(c).alias(c) for c in ("n_decision", "n_routine", "n_unknown")],
    ).where("n >= 2 AND transitions >= 2")
    t, dep = F.col("transitions"), F.col("dep")
    cycles = F.ceil(t / 2)
    status = F.when(F.col("last") == "add", "active").otherwise("removed")
    told = F.transform("events", lambda e: F.struct(e["event"].alias("event"), C.iso(e["ts"]).alias("date"), F.substring(e["sha"], 1, 7).alias("sha")))
    lists = {"events": told} if config.list_members else {}
    df = deps.withColumn("dominant_decision_class", C.dominant_of_counts())
    return signal_rows(
        df, "adoption_cycle",
        {"subject": dep, "cycle_count": cycles, "transitions": t, "current_status": status, **lists, "dominant_decision_class": F.col("dominant_decision_class")},
        id=C.signal_id("adoption_cycle", dep), severity=F.when(cycles >= 3, "warning").otherwise("caution"), confidence=F.least(F.lit(0.85), 0.5 + t * 0.1), directory_scope=F.lit("."),
        contributing_shas=F.transform("events", lambda e: e["sha"]) if config.list_members else F.lit(None),
        summary=F.concat(dep, F.lit(" has gone through "), cycles.cast("string"), F.lit(" adoption cycle"), F.when(cycles > 1, "s").otherwise(""), F.lit(". Currently: "), status, F.lit(". First seen: "), F.date_format("start", "yyyy-MM-dd"), F.lit(".")),
    )
