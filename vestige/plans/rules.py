"""Declarative rules and ordered patterns, compiled to Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Phrases that override instructions.
INJECTION_PHRASES = ("ignore previous instructions", "ignore all previous instructions", "disregard your instructions", "disregard all prior", "ignore your system prompt", "override your system prompt", "you are now dan", "pretend you have no restrictions", "do not tell the user", "without informing the user", "exfiltrate", "<!-- ai:", "[system]", "important: before responding")


def java_pattern(pattern: str) -> str:
    """A pattern of linear-time dialects as one of Java: end of text is \\z, and only line feeds end lines."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(r"\z" if c == "$" and not inside else c)
        i += 1
    return "(?d)" + "".join(out)


@dataclass(frozen=True)
class Rule:
    """Fires where the subject holds any of contains (lower case) or matches pattern, and not exclude."""

    rule_id: str
    severity: str
    contains: tuple[str, ...] = ()
    pattern: str = ""
    exclude: str = ""

    def fires(self, subject: Column) -> Column:
        low = F.lower(subject)
        tests = [low.contains(p) for p in self.contains] + ([subject.rlike(java_pattern(self.pattern))] if self.pattern else [])
        hit = reduce(or_, tests, F.lit(False))
        return hit & ~subject.rlike(java_pattern(self.exclude)) if self.exclude else hit


def findings(rows: DataFrame, rules: list[Rule], subject: str) -> DataFrame:
    """A row for each row and rule that fires, in one pass: the row's columns, rule_id, severity."""
    found = F.array(*(F.when(r.fires(F.col(subject)), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in rules))
    return rows.withColumn("__f", F.explode(F.filter(found, lambda x: x.isNotNull()))).select(*rows.columns, "__f.rule_id", "__f.severity")


@dataclass(frozen=True)
class Step:
    """differs: a column whose value must be another than that of the step before."""

    when: Column
    differs: str | None = None


@dataclass(frozen=True)
class Chain:
    """Steps in order within window_us of the first (0: however late).

    link: a column of one value or an array of them; each step shares a value with the step before, and from the third on one that was shared there.
    """

    chain_id: str
    steps: tuple[Step, ...]
    window_us: int
    link: str | None = None


def _segments(rows: DataFrame, window_us: int) -> DataFrame:
    """Rows with the number of their segment (s): segments of a key are further apart than the window, so no match crosses them.

    A bucket of the window's width holds no such gap, so the buckets' first and last times tell them; only these are ordered by key.
    """
    if not window_us:
        return rows.withColumn("s", F.lit(0).cast("long"))
    rows = rows.withColumn("b", F.floor(F.col("at") / window_us))
    w = Window.partitionBy("k").orderBy("b")
    spans = rows.groupBy("k", "b").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    spans = spans.withColumn("new", (F.col("lo") - F.lag("hi").over(w) > window_us).cast("int"))
    spans = spans.select(F.col("k").alias("sk"), F.col("b").alias("sb"), F.coalesce(F.sum("new").over(w), F.lit(0)).alias("s"))
    return rows.join(spans, F.col("k").eqNullSafe(F.col("sk")) & (F.col("b") == F.col("sb"))).drop("sk", "sb", "b")


class _Row(NamedTuple):
    at: int
    bits: int
    link: list | None
    d: list


def follow(events: list, start: int, names: list, linked: bool, window: int | None) -> tuple[int, int] | None:
    """Places of the last row and of what comes behind it, of the match that starts here.  names: for each step the column that must differ, or None."""
    before, shared, place = events[start], set(events[start].link if linked and events[start].link is not None else ()), start + 1
    for step in range(1, len(names)):
        while True:
            if place == len(events) or (window and events[place].at - events[start].at > window):
                return None
            r, place = events[place], place + 1
            common = shared.intersection(r.link) if linked and r.link is not None else ()
            if r.bits >> step & 1 and (not linked or common) and (names[step] is None or r.d[step] != before.d[step]):
                break
        before, shared = r, set(common)
    return place - 1, place


def _changes(rows) -> np.ndarray:
    """Whether each row begins a segment (k, s) of sorted rows of a table or batch."""
    k = rows.column("k")
    code = (pa.chunked_array([k]) if isinstance(k, pa.Array) else k).combine_chunks().dictionary_encode()
    code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.fill_null(-1).to_numpy(zero_copy_only=False)
    s = np.asarray(rows.column("s"))
    return np.append(True, (code[1:] != code[:-1]) | (s[1:] != s[:-1]))


def _segment(rows: pa.RecordBatch, i: int) -> tuple:
    return rows.column("k")[i].as_py(), rows.column("s")[i].as_py()


def _jumped(at: np.ndarray, bits: np.ndarray, stop: np.ndarray, steps: int, window: int, most: int | None) -> tuple[list[int], list[int]]:
    """First and last places of matches whose steps ask nothing of each other: each start's last row by the places of the next row of every step."""
    n = len(at)
    end = np.arange(n)
    for step in range(1, steps):
        following = np.full(n + 1, n)
        following[:n][bits >> step & 1 == 1] = np.flatnonzero(bits >> step & 1)
        end = np.minimum.accumulate(following[::-1])[::-1][np.minimum(end + 1, n)]
    whole = (bits & 1 == 1) & (end < stop)
    if window:
        whole &= at[np.minimum(end, n - 1)] - at <= window
    start = np.full(n + 1, n)
    start[:n][whole] = np.flatnonzero(whole)
    start = np.minimum.accumulate(start[::-1])[::-1]
    first, last, p, count, inside = [], [], int(start[0]), 0, 0
    while p < n:
        if p >= inside:
            count, inside = 0, int(stop[p])
        first.append(p)
        last.append(int(end[p]))
        count += 1
        p = int(start[inside if most is not None and count >= most else last[-1] + 1])
    return first, last


def _looped(rows: list[dict], starts: np.ndarray, names: list, linked: bool, window: int, most: int | None) -> tuple[list[int], list[int]]:
    """First and last places of matches whose steps ask something of each other."""
    first, last = [], []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        ordered, i, count = [_Row(r["at"], r["bits"], r["link"], r["d"]) for r in rows[a:b]], 0, 0
        while i < len(ordered) and (most is None or count < most):
            found = follow(ordered, i, names, linked, window) if ordered[i].bits & 1 else None
            if found:
                first.append(a + i)
                last.append(a + found[0])
                count += 1
            i = found[1] if found else i + 1
    return first, last


def chain_matches(events: DataFrame, chain: Chain, key: str, at: str, tie: str, most: int | None = None) -> DataFrame:
    """Greedy matches that don't overlap: key, chain_id, first_event, last_event; all of them, or of a key the first so many where most asks for that.

    After a match the search goes on behind its last row, after a failed start at the row behind that start.  Rows that can be no step or
    have no time are left out; rows without a key are one group; repeated rows are rows; an empty table has no matches.  What is read at
    once is a run of a key's rows none of which is further than the window from the next, all its rows only where there is no window.  Such runs
    come sorted, many in a batch; where steps ask nothing of each other, the work on them grows with their rows alone.
    """
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(s.when, F.lit(1 << i)).otherwise(F.lit(0)) for i, s in enumerate(chain.steps)))
    link = F.lit(None).cast("array<string>")
    if chain.link:
        many = dict(events.dtypes)[chain.link].startswith("array")
        link = (F.col(chain.link) if many else F.when(F.col(chain.link).isNotNull(), F.array(chain.link))).cast("array<string>")
    names = [s.differs for s in chain.steps]
    differs = F.array(*(F.col(n).cast("string") if n else F.lit(None).cast("string") for n in names))
    rows = events.select(F.col(key).cast("string").alias("k"), F.col(at).cast("long").alias("at"), F.col(tie).cast("long").alias("e"), bits.alias("bits"), link.alias("link"), differs.alias("d")).where("bits <> 0 and at is not null")
    name, window, linked = chain.chain_id, chain.window_us, bool(chain.link)

    tied = linked or any(names)

    def match(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        """The matches of whole segments in order."""
        t = pa.Table.from_batches(batches).combine_chunks()
        at, bits = (t.column(c).to_numpy() for c in ("at", "bits"))
        starts = np.append(np.flatnonzero(_changes(t)), len(t))
        stop = np.repeat(starts[1:], np.diff(starts))  # where each row's segment ends
        first, last = _looped(t.to_pylist(), starts, names, linked, window, most) if tied else _jumped(at, bits, stop, len(names), window, most)
        end = t.column("e").take(pa.array(last, pa.int64()))
        some = t.select(["k", "e", "at"]).take(pa.array(first, pa.int64()))
        cols = [some.column("k"), pa.array([name] * len(first), pa.string()), some.column("e"), end, some.column("at")]
        return pa.Table.from_arrays(cols, names=["k", "chain_id", "first_event", "last_event", "first_at"]).combine_chunks()

    def run(batches):
        held: list[pa.RecordBatch] = []  # of one segment
        for b in batches:
            if b.num_rows == 0:
                continue
            new = int(np.flatnonzero(_changes(b))[-1])  # where the last segment of b begins
            if new == 0 and (not held or _segment(held[-1], -1) == _segment(b, 0)):
                held.append(b)
                continue
            yield from match([*held, b.slice(0, new)]).to_batches()
            held = [b.slice(new)]
        if held:
            yield from match(held).to_batches()

    ordered = _segments(rows, window).repartition("k", "s").sortWithinPartitions("k", "s", "at", F.asc_nulls_last("e"))
    found = ordered.select("k", "s", "at", "e", "bits", "link", "d").mapInArrow(run, "k string, chain_id string, first_event long, last_event long, first_at long")
    if most is not None:
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("first_at", "first_event"))).where(F.col("n") <= most)
    return found.select(F.col("k").alias(key), "chain_id", "first_event", "last_event")


def precursor_then(events: DataFrame, key: str, at: str, tie: str, first: Column, then: Column) -> DataFrame:
    """Rows of then whose latest first-or-then row before them is a first: each precursor is used once.  key, tie."""
    w = Window.partitionBy(key).orderBy(at, tie)
    marked = events.where(first | then).withColumn("__then", then).withColumn("__was", F.lag("__then").over(w))
    return marked.where(F.col("__then") & (F.col("__was") == F.lit(False))).select(key, tie)
