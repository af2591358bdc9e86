"""Live evaluation: rules on a growing folder of JSON lines, deduplicated alerts and windowed rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.rules import Rule, findings

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def tail(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def alerts(stream: DataFrame, rules: list[Rule], subject: str, late: str = "10 minutes") -> DataFrame:
    """Each finding once, however often its event arrives within the time that late rows may take."""
    return findings(stream.withWatermark("ts", late), rules, subject).dropDuplicatesWithinWatermark(["rule_id", "event_id"])


def rates(stream: DataFrame, key: str, window: str, slide: str, least: int, late: str = "10 minutes") -> DataFrame:
    """Windows in which a key has at least so many rows: key, start, n."""
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).select(key, F.col("w.start").alias("start"), "n")
