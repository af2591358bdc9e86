"""Detections within sessions that are a filter, a grouped count or a window over typed events.

All take events with a key (session, agent, account or artifact), a time in microseconds and a tie that orders equal times.  Rows without a key
are a session of their own.  Rows without a time have no place in an order and are left out of ordered tests, but count where rows are only
counted.  Repeated rows count as often as they come; an empty table gives no rows, or one row of zeros where a table of any size gives one.
Helper columns begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _ordered(events: DataFrame, at: str) -> DataFrame:
    return events.where(F.col(at).isNotNull())


def _first_of(rows: DataFrame, keys: list[str], at: str, tie: str, *kept: str) -> DataFrame:
    """The earliest row of each key, and of it the columns kept."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(at, tie, *kept)).alias("__first"))
    return first.select(*keys, *(F.col(f"__first.{c}").alias(c) for c in (tie, *kept)))


def count_with_first(events: DataFrame, when: Column, at: str, tie: str) -> DataFrame:
    """One row: how many rows there are of the kind (n), and the first of them (first_event; null if there is none)."""
    return events.where(when).agg(F.count("*").alias("n"), F.min_by(tie, F.struct(at, tie)).alias("first_event"))


def sessions_over(events: DataFrame, key: str, when: Column, most: int = 10) -> DataFrame:
    """Sessions with more than so many rows of the kind: key, n."""
    return events.where(when).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)


def integrity(events: DataFrame, key: str, broken: Column, at: str, tie: str, slack_us: int = 60_000_000) -> DataFrame:
    """Artifacts with chain breaks or times that step back by more than the slack against the timed row before: key, breaks, steps_back, severity."""
    w = Window.partitionBy(key).orderBy(tie)
    before = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.select(key, broken.alias("__broken"), (F.col(at) < before - slack_us).alias("__back"))
    found = rows.groupBy(key).agg(F.count_if("__broken").alias("breaks"), F.count_if("__back").alias("steps_back")).where("breaks > 0 or steps_back > 0")
    return found.withColumn("severity", F.when(F.col("breaks") > 0, "HIGH").otherwise("MEDIUM"))


def resumed_after_done(events: DataFrame, task: str, agent: str, done: Column, at: str, tie: str, slack_us: int = 60_000_000) -> DataFrame:
    """Agents that are active, other than by a result, more than the slack after the latest completion of their task: agent, done_us, tie of the first such row."""
    timed = _ordered(events, at)
    ends = timed.where(done).where(F.col(task).isNotNull()).groupBy(F.col(task).alias(agent)).agg(F.max(at).alias("done_us"))
    late = timed.where(~done).select(agent, at, tie).join(ends, agent).where(F.col(at) > F.col("done_us") + slack_us)
    return _first_of(late, [agent, "done_us"], at, tie)


def several_identities(events: DataFrame, key: str, identity: str, least: int = 2) -> DataFrame:
    """Sessions in which at least so many identities act: key, n_identities."""
    return events.groupBy(key).agg(F.count_distinct(identity).alias("n_identities")).where(F.col("n_identities") >= least)


def changes_in_mode(events: DataFrame, key: str, mode: Column, wanted: str, change: Column, at: str, tie: str) -> DataFrame:
    """State changes while the mode last set (null: this row sets none) is the wanted one: key, tie."""
    w = Window.partitionBy(key).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = _ordered(events, at).withColumn("__mode", F.last(mode, ignorenulls=True).over(w))
    return rows.where(change & (F.col("__mode") == wanted)).select(key, tie)


def widened_unapproved(events: DataFrame, key: str, rank: Column, approval: Column, at: str, tie: str) -> DataFrame:
    """Rows whose permission rank (null: this row sets none) is above the one set before, with no approval between: key, tie, was, now."""
    w = Window.partitionBy(key).orderBy(at, tie)
    rows = _ordered(events, at).withColumn("__rank", rank).withColumn("__approvals", F.count_if(approval).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pairs = rows.where("__rank is not null").withColumn("was", F.lag("__rank").over(w)).withColumn("__then", F.lag("__approvals").over(w))
    return pairs.where((F.col("__rank") > F.col("was")) & (F.col("__approvals") == F.col("__then"))).select(key, tie, "was", F.col("__rank").alias("now"))


def unprompted(events: DataFrame, key: str, source: Column, instruction: Column, call: Column, at: str, tie: str) -> DataFrame:
    """Calls whose latest source-or-instruction row before them is a source: what was read, not what was asked for, may have led to them.  key, tie, source_event."""
    w = Window.partitionBy(key).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(source, F.struct(F.lit(True).alias("source"), F.col(tie).alias("id"))).when(instruction, F.struct(F.lit(False).alias("source"), F.col(tie).alias("id")))
    rows = _ordered(events, at).withColumn("__last", F.last(mark, ignorenulls=True).over(w))
    return rows.where(call & F.col("__last.source")).select(key, tie, F.col("__last.id").alias("source_event"))


def unverified_success(events: DataFrame, key: str, failed: Column, claim: Column, reset: Column, at: str, tie: str) -> DataFrame:
    """Claims of success whose latest failed-or-reset row before them is a failure, the first claim after each: key, tie."""
    w = Window.partitionBy(key).orderBy(at, tie)
    rows = _ordered(events, at).where(failed | claim | reset).withColumn("__claim", claim & ~failed).withColumn("__was", F.lag(failed).over(w))
    return rows.where(F.col("__claim") & F.col("__was")).select(key, tie)


def drifting(rows: DataFrame, keys: list[str], version: str, at: str, most: int = 20) -> DataFrame:
    """Keys seen in several versions: keys, n_versions, and the first of them in order of first sight as one string (most of them; the count is whole)."""
    seen = rows.where(F.col(version).isNotNull()).groupBy(*keys, F.col(version).cast("string").alias("__v")).agg(F.min(at).alias("__at"))
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("__at"), "__v")
    ranked = seen.withColumn("__k", F.row_number().over(w))
    few = F.array_sort(F.collect_list(F.when(F.col("__k") <= most, F.struct("__k", "__v"))))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n_versions"), F.array_join(F.transform(few, lambda x: x["__v"]), ",").alias("versions")).where("n_versions >= 2")


def clock_faults(calls: DataFrame, results: DataFrame, key: str, at: str, done: str, least_us: int, most_us: int) -> DataFrame:
    """Calls with an impossible time: key, fault (before_era, future, result_first), a row for each fault.  results: key and done, its time."""
    first = results.groupBy(key).agg(F.min(done).alias("__done"))
    rows = calls.select(key, at).join(first, key, "left")
    tests = ((F.col(at) < least_us, "before_era"), (F.col(at) > most_us, "future"), (F.col("__done") < F.col(at), "result_first"))
    return rows.select(key, F.explode(F.filter(F.array(*(F.when(t, F.lit(n)) for t, n in tests)), lambda x: x.isNotNull())).alias("fault"))


def error_rates(events: DataFrame, backend: str, error: Column, least: int) -> DataFrame:
    """Backends with at least so many errors: backend, errors, n."""
    return events.groupBy(backend).agg(F.count_if(error).alias("errors"), F.count("*").alias("n")).where(F.col("errors") >= least)


def summary(findings: DataFrame, *facets: str) -> DataFrame:
    """Counts of findings by each facet alone, in one pass: facet, value, n.  A null value is a value."""
    pairs = F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets))
    return findings.select(F.explode(pairs).alias("__p")).groupBy(F.col("__p.facet").alias("facet"), F.col("__p.value").alias("value")).agg(F.count("*").alias("n"))


def conversation_list(turns: DataFrame, key: str, turn: str, role: str, text: str, opening: int = 80) -> DataFrame:
    """A row for each conversation: key, turns, chars, roles, and how its first user turn opens (null without one)."""
    user = F.when(F.col(role) == "user", F.struct(F.col(turn).alias("t"), F.substring(text, 1, opening).alias("x")))
    return turns.groupBy(key).agg(F.count("*").alias("turns"), F.sum(F.length(text)).alias("chars"), F.count_distinct(role).alias("roles"), F.min(user).alias("__u")).withColumn("opening", F.col("__u.x")).drop("__u")


def fetched_then_run(fetched: DataFrame, ran: DataFrame, keys: list[str], at: str, then: str, tie: str, within_us: int = 3_600_000_000) -> DataFrame:
    """Runs of what was fetched at most so long before: keys, tie of the run, fetched_us (the latest such fetch).

    One ordered pass over both sides, so a key of any size makes no pairs.
    """
    both = fetched.select(*keys, F.col(at).alias("__at"), F.lit(None).cast("long").alias(tie)).unionByName(ran.select(*keys, F.col(then).alias("__at"), F.col(tie).cast("long").alias(tie)))
    w = Window.partitionBy(*keys).orderBy("__at", F.col(tie).isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    rows = both.where("__at is not null").withColumn("fetched_us", F.last(F.when(F.col(tie).isNull(), F.col("__at")), ignorenulls=True).over(w))
    return rows.where(F.col(tie).isNotNull() & (F.col("__at") - F.col("fetched_us") <= within_us)).select(*keys, tie, "fetched_us")


def refused_then_repeated(events: DataFrame, key: str, action: list[str], refused: Column, call: Column, instruction: Column, at: str, tie: str) -> DataFrame:
    """Calls that repeat an action refused before, with no instruction between: key, tie, refused_event (the latest such refusal).

    Of one time, rows go by their tie.  An action with a null part is no action.
    """
    timed = _ordered(events, at)
    w = Window.partitionBy(key).orderBy(at, tie)
    rows = timed.withColumn("__told", F.count_if(instruction).over(w.rowsBetween(Window.unboundedPreceding, 0))).dropna(subset=action)
    same = Window.partitionBy(key, "__told", *action).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.where(refused | call).withColumn("__refused", F.last(F.when(refused, F.col(tie)), ignorenulls=True).over(same))
    return rows.where(call & F.col("__refused").isNotNull()).select(key, tie, F.col("__refused").alias("refused_event"))
