"""Ordered analytics within sessions: gaps, regressions, rates, runs, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def upper_median(values: Column) -> Column:
    """The item in the middle of a sorted array, the upper of two; never a mean."""
    return F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)


def silence_gaps(events: DataFrame, key: str, ts: str = "ts", tie: str = "event_id", least_s: int = 900, times: int = 30) -> DataFrame:
    """Pauses of at least least_s seconds and times the session's upper median pause: key, tie, gap_us, median_us.

    The median comes from counts of whole pauses by value, so a session of any length is no single array.
    """
    w = Window.partitionBy(key).orderBy(micros(ts), tie)
    steps = events.select(key, tie, (micros(ts) - F.lag(micros(ts)).over(w)).alias("gap_us")).where("gap_us is not null")
    positive = steps.where("gap_us > 0").groupBy(key, "gap_us").agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy("gap_us")
    ranked = positive.select(key, "gap_us", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy(key)).alias("whole"))
    median = ranked.where(F.col("upto") > F.expr("whole div 2")).groupBy(key).agg(F.min("gap_us").alias("median_us"))
    return steps.join(median, key).where((F.col("gap_us") >= least_s * 1_000_000) & (F.col("gap_us") >= times * F.col("median_us"))).select(key, tie, "gap_us", "median_us")


def regressions(events: DataFrame, key: str, value: Column, tie: str, slack: int, running: bool) -> DataFrame:
    """Rows whose value lies more than slack before the previous row's, or before the running maximum: key, tie, back."""
    w = Window.partitionBy(key).orderBy(tie)
    before = F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)) if running else F.lag("v").over(w)
    return events.select(key, tie, value.alias("v")).select(key, tie, (before - F.col("v")).alias("back")).where(F.col("back") > slack)


def rate_hits(events: DataFrame, keys: list[str], seconds: int, least: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The first row of each key at which the last seconds hold at least so many rows: keys, tie, n."""
    w = Window.partitionBy(*keys).orderBy("u").rangeBetween(-seconds * 1_000_000, 0)
    hit = events.select(*keys, tie, micros(ts).alias("u")).withColumn("n", F.count("*").over(w)).where(F.col("n") >= least)
    return hit.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("u", tie))).where("k = 1").select(*keys, tie, "n")


def runs(events: DataFrame, key: str, boundary: Column, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """events with run: how many boundaries (instructions) stand at or before a row in its session."""
    return events.withColumn("run", F.sum(boundary.cast("long")).over(Window.partitionBy(key).orderBy(micros(ts), tie)))


def varied_runs(events: DataFrame, key: str, boundary: Column, kind: str, seconds: int, least: int, kinds: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Runs in which some window holds at least so many rows of at least so many kinds: key, run, tie (the first row at which it does)."""
    w = Window.partitionBy(key, "run").orderBy("u").rangeBetween(-seconds * 1_000_000, 0)
    inside = runs(events, key, boundary, ts, tie).where(~boundary).withColumn("u", micros(ts))
    hit = inside.withColumn("n", F.count("*").over(w)).withColumn("kinds", F.size(F.collect_set(kind).over(w))).where((F.col("n") >= least) & (F.col("kinds") >= kinds))
    return hit.withColumn("k", F.row_number().over(Window.partitionBy(key, "run").orderBy("u", tie))).where("k = 1").select(key, "run", tie)


def mode_rises(events: DataFrame, key: str, rank: Column, top: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The first row of each session that moves to rank top from a lower rank: key, tie, was."""
    w = Window.partitionBy(key).orderBy(micros(ts), tie)
    moved = events.withColumn("r", rank).withColumn("was", F.lag("r").over(w)).where((F.col("r") == top) & (F.col("was") < top))
    return moved.withColumn("k", F.row_number().over(w)).where("k = 1").select(key, tie, "was")


def sequence_gaps(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Missing numbers between neighbours: key, after, missing."""
    w = Window.partitionBy(key).orderBy(seq)
    return rows.select(key, seq).distinct().select(key, F.lag(seq).over(w).alias("after"), F.col(seq)).where(F.col(seq) > F.col("after") + 1).select(key, "after", (F.col(seq) - F.col("after") - 1).alias("missing"))


def islands(events: DataFrame, key: str, seconds: int, ts: str = "ts") -> DataFrame:
    """Activity ranges: rows no further apart than seconds are one: key, start_us, stop_us, n."""
    w = Window.partitionBy(key).orderBy("u")
    new = (F.col("u") - F.lag("u").over(w) > seconds * 1_000_000).cast("int")
    marked = events.select(key, micros(ts).alias("u")).withColumn("new", F.coalesce(new, F.lit(0))).withColumn("island", F.sum("new").over(w))
    return marked.groupBy(key, "island").agg(F.min("u").alias("start_us"), F.max("u").alias("stop_us"), F.count("*").alias("n")).drop("island")


def content_runs(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """How many runs of equal neighbours each key has (A A B A has three): key, n_runs."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("p", F.lag(value).over(w)).groupBy(key).agg(F.sum(F.when(F.col("p").eqNullSafe(F.col(value)), 0).otherwise(1)).alias("n_runs"))


def last_before(events: DataFrame, key: str, wanted: Column, value: str, back: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """events with trigger: the value of the latest wanted row among the back rows before each.

    A running last of the value and its row's number, so a row costs the same however far it looks back.
    """
    w = Window.partitionBy(key).orderBy(micros(ts), tie)
    rows = events.withColumn("__n", F.row_number().over(w))
    last = F.last(F.when(wanted, F.struct(F.col(value).alias("v"), F.col("__n").alias("n"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = rows.withColumn("__last", last)
    return found.withColumn("trigger", F.when(F.col("__n") - F.col("__last.n") <= back, F.col("__last.v"))).drop("__n", "__last")


def distinct_ahead(rows: DataFrame, keys: list[str], at: str, value: str, window: int) -> DataFrame:
    """rows with n_distinct: how many different values of value the keys have from the row's time to window after it, both included.

    A row counts in the windows that begin behind the last row of its value and no more than window before it: one more at the first such
    time, one less behind its own.  So one running sum over times gives all counts, however many rows a window holds.  Null values count as
    none; rows without a time have no count; null keys are a key.
    """
    timed = rows.where(F.col(at).isNotNull())
    own = timed.where(F.col(value).isNotNull()).select(*keys, value, F.col(at).cast("long").alias("__at")).distinct().withColumn("__was", F.lag("__at").over(Window.partitionBy(*keys, value).orderBy("__at")))
    steps = own.select(*keys, F.explode(F.array(F.struct(F.greatest(F.col("__was") + 1, F.col("__at") - window).alias("t"), F.lit(1).alias("d")), F.struct((F.col("__at") + 1).alias("t"), F.lit(-1).alias("d")))).alias("s")).select(*keys, F.col("s.t").alias("__t"), F.col("s.d").alias("__d"))
    marked = timed.withColumn("__t", F.col(at).cast("long")).withColumn("__d", F.lit(0)).withColumn("__row", F.lit(True))
    w = Window.partitionBy(*keys).orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    counted = marked.unionByName(steps.withColumn("__row", F.lit(False)), allowMissingColumns=True).withColumn("n_distinct", F.sum("__d").over(w))
    return counted.where("__row").drop("__t", "__d", "__row").unionByName(rows.where(F.col(at).isNull()).withColumn("n_distinct", F.lit(None).cast("long")))


def bursts(rows: DataFrame, keys: list[str], at: str, value: str, window: int, least: int) -> DataFrame:
    """Bursts of a key: keys, first_at, last_at, n_rows, n_distinct.  A burst begins where at least so many different values come within window,
    and goes on while rows are no more than window apart.

    So within a run of rows no more than window apart, the burst is from the first row whose window has enough to the run's end.
    """
    order = Window.partitionBy(*keys).orderBy(at)
    counted = distinct_ahead(rows.where(F.col(at).isNotNull()), keys, at, value, window)
    runs = counted.withColumn("__new", (F.col(at) - F.lag(at).over(order) > window).cast("int")).withColumn("__run", F.sum(F.coalesce("__new", F.lit(0))).over(order.rangeBetween(Window.unboundedPreceding, 0)))
    start = runs.withColumn("__from", F.min(F.when(F.col("n_distinct") >= least, F.col(at))).over(Window.partitionBy(*keys, "__run")))
    return start.where(F.col(at) >= F.col("__from")).groupBy(*keys, "__run").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n_rows"), F.count_distinct(value).alias("n_distinct")).drop("__run")
