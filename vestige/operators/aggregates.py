"""Groupings of events, findings and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import EVIDENCE_STATES, SEVERITIES, rank
from .windows import micros


def finding_groups(findings: DataFrame, refs: int = 5) -> DataFrame:
    """Findings by rule and session, in order of first appearance: count, worst severity, time span, the first refs as one string.

    findings: rule_id, session_id, severity, ts, ref, seq.  The refs come from a ranked window, so a group of any size stays bounded.
    """
    keys = ["rule_id", "session_id"]
    groups = findings.groupBy(*keys).agg(F.count("*").alias("n"), F.min(rank(F.col("severity"), SEVERITIES)).alias("worst"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("seq").alias("first_seq"))
    few = findings.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where(F.col("k") <= refs).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "ref"))), lambda x: x["ref"]), ",").alias("refs"))
    return groups.join(few, keys).withColumn("severity", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("worst") + 1)).drop("worst")


def minute_buckets(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.groupBy(F.date_format(ts, "yyyy-MM-dd'T'HH:mm").alias("minute")).agg(F.count("*").alias("n"))


def order_statistic(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """The ceil(share n)-th smallest value of each key: key, n, q; from ranks, with no array of a whole group."""
    w = Window.partitionBy(key).orderBy(value)
    ranked = rows.where(F.col(value).isNotNull()).select(key, value, F.row_number().over(w).alias("__k"), F.count("*").over(Window.partitionBy(key)).alias("__n"))
    return ranked.where(F.col("__k") == F.ceil(F.col("__n") * share)).select(key, F.col("__n").alias("n"), F.col(value).alias("q"))


def spread_keys(rows: DataFrame, key: str, member: str, least: int = 2) -> DataFrame:
    """Keys seen with at least so many members: key, n_members, and the members in order as one string."""
    few = rows.select(key, F.col(member).cast("string").alias("m")).distinct().groupBy(key).agg(F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_list("m")), ",").alias("members"))
    return few.where(F.col("n_members") >= least)


def session_cards(events: DataFrame, key: str, kind: str, ts: str = "ts") -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(kind).alias("kinds"), F.min(micros(ts)).alias("start_us"), F.max(micros(ts)).alias("stop_us"))


def strongest_state(rows: DataFrame, key: str, state: str = "state") -> DataFrame:
    best = rows.groupBy(key).agg(F.min(rank(F.col(state), EVIDENCE_STATES)).alias("r"))
    return best.select(key, F.element_at(F.array(*map(F.lit, EVIDENCE_STATES)), F.least(F.col("r"), F.lit(6)) + 1).alias("state"))


def corpus_scores(expected: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn."""
    both = expected.select(*keys, F.lit(1).alias("e")).join(produced.select(*keys).distinct().withColumn("p", F.lit(1)), keys, "full_outer")
    return both.agg(F.count_if(F.col("e").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def adjusted_confidence(start: Column, steps: list[Column]) -> Column:
    """A level from 0 to 2 after each verifier's step in turn, clamped after every one."""
    for s in steps:
        start = F.greatest(F.lit(0), F.least(F.lit(2), start + s))
    return start


def capped_lists(rows: DataFrame, kind: str, order: list, most: int) -> DataFrame:
    """The first rows of each kind, with omitted: how many more there are.  A null kind is a kind.

    Ranks alone are filtered, so each task hands on its own first rows of a kind; the counts are a grouped join.
    """
    counts = rows.groupBy(F.col(kind).alias("__kind")).agg(F.count("*").alias("__n"))
    first = rows.withColumn("__k", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("__k") <= most)
    return first.join(counts, F.col(kind).eqNullSafe(F.col("__kind"))).withColumn("omitted", F.greatest(F.col("__n") - most, F.lit(0))).drop("__k", "__n", "__kind")
