"""Churn hotspots: files changed more often than mean + k standard deviations of all files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.functions import columns as C
from strataline.operators.history import file_diffs
from strataline.operators.signals.common import among, classed, first_shas, signal_rows, sliced
from strataline.schema import SignalsConfig

TREND_DAYS = 30


def churn_counts(history: DataFrame, as_of: Column, slices: int = 1) -> DataFrame:
    """Per file: changes, first and last, and counts in the last 30 days and the 30 before."""
    recent = as_of - F.expr(f"INTERVAL {TREND_DAYS} DAYS")
    before = as_of - F.expr(f"INTERVAL {2 * TREND_DAYS} DAYS")
    counts = [
        F.count("*").alias("count"), F.min("ts").alias("start"), F.max("ts").alias("end"),
        F.count_if(F.col("ts") >= recent).alias("recent_30d"), F.count_if((F.col("ts") >= before) & (F.col("ts") < recent)).alias("previous_30d"),
    ]
    return sliced(file_diffs(history), "file_path", slices, lambda rows: rows.groupBy("file_path").agg(*counts), "churn-files")


def churn_hotspots(history: DataFrame, as_of: Column, config: SignalsConfig = SignalsConfig()) -> DataFrame:
    """The flagged files with sigma, mean and trend; none if all files change equally often."""
    files = churn_counts(history, as_of, config.slices)
    stats = files.agg(F.avg("count").alias("mean"), F.stddev_pop("count").alias("sd"))  # one row
    ratio = F.try_divide(F.col("recent_30d"), F.col("previous_30d"))
    trend = (
        F.when(F.col("previous_30d") == 0, F.when(F.col("recent_30d") > 0, "increasing").otherwise("stable"))
        .when(ratio > 1.5, "increasing").when(ratio < 0.5, "decreasing").otherwise("stable")
    )
    return files.crossJoin(F.broadcast(stats)).where((F.col("sd") > 0) & (F.col("count") > F.col("mean") + config.churn_sigma_threshold * F.col("sd"))).select("file_path", "count", "start", "end", "recent_30d", "previous_30d", "mean", ((F.col("count") - F.col("mean")) / F.col("sd")).alias("sigma"), trend.alias("trend"))


def detect(history: DataFrame, as_of: Column, config: SignalsConfig = SignalsConfig()) -> DataFrame:
    hot = churn_hotspots(history, as_of, config)
    touched = among(file_diffs(history), hot.select("file_path"), config.slices).select("file_path", "sha", "seq")
    classes = classed(touched.select("file_path", "sha").distinct(), history).groupBy("file_path").agg(*C.class_counts("cls")).select("file_path", C.dominant_of_counts().alias("dominant_decision_class"))
    df = hot.join(classes, "file_path")
    df = df.join(first_shas(touched, "file_path", 20), "file_path") if config.list_members else df
    f, sigma = F.col("file_path"), F.col("sigma")
    return signal_rows(
        df, "churn_hotspot",
        {"file": f, "count": F.col("count"), "sigma": F.round(sigma, 2), "mean": F.round("mean", 1), "trend": F.col("trend"), "recent_30d": F.col("recent_30d"), "previous_30d": F.col("previous_30d"), "dominant_decision_class": F.col("dominant_decision_class")},
        id=C.signal_id("churn_hotspot", f), file=f, directory_scope=C.dirname(f),
        summary=F.concat(F.lit("Churn hotspot: "), f, F.lit(" changed "), F.col("count").cast("string"), F.lit(" times ("), F.format_string("%.1f", sigma), F.lit("σ above mean of "), C.half_up(F.col("mean")).cast("string"), F.lit("). Trend: "), F.col("trend"), F.lit(".")),
        severity=F.when(sigma > 3, "warning").otherwise("caution"), confidence=F.least(F.lit(0.95), 0.6 + sigma * 0.1),
    )


def by_sigma(signals: DataFrame) -> DataFrame:
    """Churn signals for reading, the largest deviation first."""
    return signals.orderBy(F.get_json_object("metadata", "$.sigma").cast("double").desc(), "file")
