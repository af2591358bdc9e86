"""Processes by the time they lived: an id is used again, so it means another process at another time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def lives(records: DataFrame) -> DataFrame:
    """host, pid, start, stop, record_id of each process: from its start record to the next of that id on the host, or to its exit if that is earlier.

    records: host, pid, at, what ("exec" or "exit"), record_id.  Of starts at one time the last id counts; an exit without a start before it
    means nothing; a process that nothing ends has a null stop.  Rows without host, pid or time are left out.
    """
    r = records.where("host is not null and pid is not null and at is not null and what in ('exec', 'exit')")
    starts = r.where("what = 'exec'").groupBy("host", "pid", "at").agg(F.max("record_id").alias("record_id")).withColumn("what", F.lit("exec"))
    ends = r.where("what = 'exit'").groupBy("host", "pid", "at").agg(F.max("record_id").alias("record_id")).withColumn("what", F.lit("exit"))
    w = Window.partitionBy("host", "pid").orderBy("at", "what")  # "exec" before "exit"
    # What follows a start, whichever it is, ends it.
    return starts.unionByName(ends).withColumn("stop", F.lead("at").over(w)).where("what = 'exec'").select("host", "pid", F.col("at").alias("start"), "stop", "record_id")


def alive_at(points: DataFrame, records: DataFrame, slack: int) -> DataFrame:
    """points (host, pid, at) with process_id, start and ended: the latest start record of that id at or before at plus slack; null for none.

    ended is whether that process had ended, by more than slack, at that time.  One ordered pass over both tables by (host, pid): the last start
    so far.  Points without host, pid or time have no process.
    """
    life = lives(records)
    p = points.withColumn("__t", F.col("at") + slack)
    marks = life.select("host", "pid", F.col("start").alias("__t"), F.struct("start", "stop", "record_id").alias("__life"))
    # A start at the very time counts, so starts come first among equals; the frame is all rows so far, peers included.
    w = Window.partitionBy("host", "pid").orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    both = p.withColumn("__point", F.lit(True)).unionByName(marks.withColumn("__point", F.lit(False)), allowMissingColumns=True)
    seen = both.withColumn("__last", F.max("__life").over(w)).where("__point")
    known = F.col("host").isNotNull() & F.col("pid").isNotNull() & F.col("at").isNotNull()
    last = F.when(known, F.col("__last"))
    return seen.select(*points.columns, last["record_id"].alias("process_id"), last["start"].alias("start"), (last["stop"] + slack < F.col("at")).alias("ended"))


def related(matches: DataFrame, records: DataFrame, slack: int) -> DataFrame:
    """Records of the process that a match names, and of its children, while it lived: match_id, record_id, how ("same" or "child").

    matches: match_id, host, pid, at; records: host, pid, ppid, at, what, record_id.
    """
    own = alive_at(matches.select("match_id", "host", "pid", "at"), records, slack).where("process_id is not null")
    life = lives(records).select(F.col("record_id").alias("process_id"), "stop")
    spans = own.drop("ended").join(life, "process_id").select("match_id", "host", F.col("pid").alias("__pid"), "start", "stop")
    lived = (F.col("at") >= F.col("start")) & (F.col("stop").isNull() | (F.col("at") <= F.col("stop")))
    same = records.join(spans, (records["host"] == spans["host"]) & (records["pid"] == spans["__pid"])).where(lived).select("match_id", "record_id", F.lit("same").alias("how"))
    child = records.where("what = 'exec'").join(spans, (records["host"] == spans["host"]) & (records["ppid"] == spans["__pid"])).where(lived).select("match_id", "record_id", F.lit("child").alias("how"))
    return same.unionByName(child).distinct()
