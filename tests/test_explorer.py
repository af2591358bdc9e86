"""Filters, timelines, search and pages on rows with nulls, odd text, ties and none."""

import pytest
from pyspark.sql import functions as F

from vestige.operators import explorer as E

ROWS = [(1, "s", "click", "2024-01-01 00:00:00", "Hello World", None, "LOW"), (2, "s", "view", "2024-01-02 00:00:00", "", "/a/b", "HIGH"), (3, None, "click", None, None, None, "ODD"), (4, "t", "click", "2024-01-03 00:00:00", "x" * 300, "hello", None), (4, "t", "click", "2024-01-03 00:00:00", "x" * 300, "hello", None), (5, "s", "meta", "2024-01-04 00:00:00", "a‮b\x1b[0m", "(h.llo", "CRITICAL")]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, "event_id int, session string, kind string, t string, text string, file string, severity string").withColumn("time", F.to_timestamp("t"))


def ids(df):
    return sorted(r.event_id for r in df.collect())


def test_filters(spark, events):
    assert ids(E.select_events(events)) == [1, 2, 3, 4, 4, 5]
    assert ids(E.select_events(events, equal={"session": "s", "kind": "click"})) == [1]
    assert ids(E.select_events(events, without={"session": "s"})) == [3, 4, 4]
    assert ids(E.select_events(events, start="2024-01-02 00:00:00", stop="2024-01-03 00:00:00")) == [2, 4, 4]
    assert ids(E.select_events(events, text="HELLO", fields=("text", "file"))) == [1, 4, 4]
    assert ids(E.select_events(events, flagged=events.where("event_id > 3"))) == [4, 4, 5]
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in E.select_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), equal={"event_type": "click"})._jdf.queryExecution().toString()


def test_timeline(events):
    got = {r.event_id: r.what for r in E.timeline(events, ("text", "file")).collect()}
    assert got[1] == "Hello World" and got[2] == "/a/b" and got[3] is None and got[4] == "x" * 240 + "…" and "‮" not in got[5] and "\x1b" not in got[5]


def test_search(events):
    assert ids(E.search(events, "hello", ("text", "file"))) == [1, 4, 4] and ids(E.search(events, "Hello", ("text", "file"), case=True)) == [1]
    assert ids(E.search(events, "(h.l", ("text", "file"))) == [5] and ids(E.search(events, "^hello$", ("file",), regex=True)) == [4, 4] and ids(E.search(events, "\\E(", ("file",))) == []
    with pytest.raises(ValueError):
        E.search(events, "  ", ("text",))


def test_pages(events):
    order = E.by_severity(events, "event_id", "text")
    every = [r.event_id for r in E.page(events, order).collect()]
    assert every == [5, 2, 1, 3, 4, 4]
    assert [r.event_id for r in E.page(events, order, 1, 2).collect()] == [2, 1] and E.page(events, order, 99).count() == 0 and E.page(events, order, -5, 9999).count() == 6
