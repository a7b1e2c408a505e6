"""Stability shifts: directories whose change rate halved or doubled from one month to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import columns as C
from strataline.operators.history import file_diffs
from strataline.operators.signals.common import classed, first_shas, signal_rows
from strataline.schema import SignalsConfig


def detect(history: DataFrame, as_of: Column, config: SignalsConfig = SignalsConfig()) -> DataFrame:
    days = config.stability_shift_window_days
    ago = [as_of - F.expr(f"INTERVAL {k * days} DAYS") for k in (1, 2, 3)]
    rows = file_diffs(history).where(C.dirname("file_path") != ".").select(C.top_directory("file_path").alias("dir"), "sha", "seq", "ts")
    ts = F.col("ts")
    dirs = rows.groupBy("dir").agg(
        F.count("*").alias("n"), F.count_if(ts >= ago[0]).alias("recent"), F.count_if((ts >= ago[1]) & (ts < ago[0])).alias("previous"), F.count_if((ts >= ago[2]) & (ts < ago[1])).alias("older")
    )
    ratio = F.try_divide(F.col("recent"), F.col("previous"))
    shift = F.when((ratio < 0.5) & (F.col("previous") >= 3), "stabilized").when((ratio > 2.0) & (F.col("recent") >= 3), "destabilized")
    found = dirs.where("n >= 10 AND previous > 0").select("*", ratio.alias("ratio"), shift.alias("shift")).where("shift IS NOT NULL")
    late = rows.where(ts >= ago[0]).join(found.select("dir"), "dir", "left_semi")
    classes = classed(late.select("dir", "sha"), history).groupBy("dir").agg(*C.class_counts("cls")).select("dir", C.dominant_of_counts().alias("cls"))
    df = found.join(classes, "dir", "left")
    if config.list_members:
        df = df.join(first_shas(late.select("dir", "sha", "seq"), "dir", 10), "dir", "left").withColumn("contributing_shas", F.coalesce("contributing_shas", F.array().cast("array<string>")))
    df = df.withColumn("dominant_decision_class", F.coalesce("cls", F.lit("decision")))
    d, up = F.col("dir"), F.col("shift") == "destabilized"
    return signal_rows(
        df, "stability_shift",
        {"directory": d, "shift": F.col("shift"), "recent_30d": F.col("recent"), "previous_30d": F.col("previous"), "older_30d": F.col("older"), "ratio": F.round("ratio", 2), "dominant_decision_class": F.col("dominant_decision_class")},
        id=C.signal_id("stability_shift", d), severity=F.when(up, "caution").otherwise("info"), confidence=F.least(F.lit(0.85), 0.5 + F.abs(F.col("ratio") - 1) * 0.2), directory_scope=d,
        start=ago[1], end=as_of,
        summary=F.concat(d, F.lit(" has "), F.col("shift"), F.lit(": went from "), F.col("previous").cast("string"), F.lit(" changes/month to "), F.col("recent").cast("string"), F.lit(" changes/month ("), F.when(up, "increasing").otherwise("decreasing"), F.lit(" activity).")),
    )
