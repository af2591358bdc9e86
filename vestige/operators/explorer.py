"""What an analyst asks of events: filters that all hold, rows of a timeline, search over every field, pages in order."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import SEVERITIES, printable, rank
from ..plans.rules import java_pattern

#: Characters of a timeline's row; rows of a page, and the most that a page may have.
SHOWN, PAGE, MOST = 240, 200, 500


def select_events(events: DataFrame, *, equal: dict[str, str] | None = None, start: str | None = None, stop: str | None = None, text: str | None = None, fields: tuple[str, ...] = (), time: str = "time", flagged: DataFrame | None = None, id: str = "event_id", without: dict[str, str] | None = None) -> DataFrame:
    """Events for which all that is asked holds: columns equal to values, none of the columns in without equal to theirs, a time from start up to and with stop, text (in
    any case) in one of the fields, and, where flagged is given, an id that it has.

    What is not asked for doesn't count, and nulls are equal to nothing.  Equalities and times reach a file scan's filters; flagged ids are
    one semi join.  Repeated events stay repeated.
    """
    tests = [F.col(c) == v for c, v in (equal or {}).items()]
    tests += [~F.col(c).eqNullSafe(v) for c, v in (without or {}).items()]
    tests += [F.col(time) >= F.lit(start).cast("timestamp")] if start else []
    tests += [F.col(time) <= F.lit(stop).cast("timestamp")] if stop else []
    if text:
        tests.append(F.contains(F.lower(F.concat_ws("\n", *fields)), F.lit(text.lower())))
    out = events.where(reduce(and_, tests)) if tests else events
    return out if flagged is None else out.join(flagged.select(id).distinct(), id, "left_semi")


def timeline(events: DataFrame, what: tuple[str, ...], shown: int = SHOWN) -> DataFrame:
    """events with what: the first of the columns that has text, fit for a screen, and cut to so many characters with an ellipsis."""
    said = printable(F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in what)))
    return events.withColumn("what", F.when(F.length(said) > shown, F.concat(F.left(said, F.lit(shown)), F.lit("…"))).otherwise(said))


def search(rows: DataFrame, query: str, fields: tuple[str, ...], regex: bool = False, case: bool = False) -> DataFrame:
    """Rows of which the fields, a line each, hold the query: as text, or as a pattern; in any case unless case counts.  Nulls are no lines."""
    if not query.strip():
        raise ValueError("a search needs a query")
    lines = F.concat_ws("\n", *(F.col(c).cast("string") for c in fields))
    pattern = java_pattern(query) if regex else "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return rows.where(F.rlike(lines, F.lit(pattern if case else "(?iu)" + pattern)))


def page(rows: DataFrame, order: list[Column | str], offset: int = 0, limit: int = PAGE) -> DataFrame:
    """So many rows in order behind the first so many.  order must tell all rows apart, or a row may be on two pages; limits that are none or too great are PAGE."""
    return rows.orderBy(*order).offset(max(offset, 0)).limit(limit if 0 < limit <= MOST else PAGE)


def by_severity(findings: DataFrame, *ties: str) -> list[Column]:
    """The order of a list of findings: the worst first, unknown severities last, then the ties."""
    return [rank(F.col("severity"), SEVERITIES), *(F.col(t) for t in ties)]
