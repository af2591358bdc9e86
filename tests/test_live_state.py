"""Detections with state on a stream: shuffled, late and repeated rows give what a batch gives; state ends."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from vestige.plans.rules import Chain, Step, chain_matches
from vestige.streaming.live import SCHEMA
from vestige.streaming.state import live_detections

HOUR = 3_600_000_000


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def chain(**more):
    return Chain("A_B_C", tuple(Step(F.col("event_type") == x) for x in "abc"), window_us=HOUR, **more)


def run(spark, tmp_path, name, batches, limit=5, idle="1000 days"):
    folder = tmp_path / f"{name}-in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        with open(folder / f"{i:04}.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.utime(folder / f"{i:04}.json", (1_700_000_000 + 10 * i,) * 2)  # files are read in the order of their times
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(folder))
    found = live_detections(stream, "user_id", chain(), F.col("props"), F.col("event_type") == "a", limit, late="2 hours", idle=idle)
    query = found.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return sorted(tuple(r) for r in spark.table(name).collect() if r.key != "99")


def event(i, minute, user, kind, props=None):
    return {"event_id": i, "ts": f"2024-01-{1 + minute // 1440:02}T{minute // 60 % 24:02}:{minute % 60:02}:00.000Z", "user_id": user, "event_type": kind, "value": 1.0, "props": props}


def closing(n):
    """Rows of another key that move the watermark on."""
    return [[event(10_000_000 + k, 20000 + 200 * k, 99, "z")] for k in range(n)]


def test_live_agrees_with_batch(rocks, tmp_path):
    spark, draw = rocks, random.Random(7)
    rows = [event(i, draw.randint(0, 600), draw.choice([1, 1, 1, 2, 3]), draw.choice("abcz"), draw.choice(["x", "y", "z", None])) for i in range(200)]
    rows.sort(key=lambda r: r["ts"])
    batches = [rows[i : i + 50] for i in range(0, 200, 50)]
    for k, b in enumerate(batches):
        b += draw.sample(b, 10)  # repeated at once
        if k:
            b += [r for r in batches[k - 1][-8:]]  # and again later
        draw.shuffle(b)
    batches[2].append({**event(5000, 1, 1, "a", "late"), "ts": "2023-01-01T00:00:00.000Z"})
    batches[1] += [{**event(5001, 5, None, "a")}, {**event(5002, 5, 1, "a"), "ts": None}]
    got = run(spark, tmp_path, "agree", batches + closing(2))
    frame = spark.createDataFrame([(r["event_id"], r["ts"], r["user_id"], r["event_type"], r["props"]) for r in rows], "event_id long, t string, user_id long, event_type string, props string").withColumn("at", F.unix_micros(F.to_timestamp("t")))
    want = [(str(r.user_id), "A_B_C", r.first_event, r.last_event) for r in chain_matches(frame, chain(), "user_id", "at", "event_id", None).collect()]
    ordered, seen, count = sorted((r.at, r.event_id, r.user_id, r.event_type, r.props) for r in frame.collect()), set(), {}
    for at, e, u, kind, props in ordered:
        if props is not None and (u, props) not in seen:
            seen.add((u, props))
            want.append((str(u), "FIRST_SEEN", e, e))
        if kind == "a":
            count[u] = count.get(u, 0) + 1
            if count[u] == 6:
                want.append((str(u), "ABOVE_LIMIT", e, e))
    assert len(got) == len(set(got)) and sorted(set(want) - {r[:4] for r in got}) == [] == sorted({r[:4] for r in got} - set(want)) and {r[1] for r in got} == {"A_B_C", "FIRST_SEEN", "ABOVE_LIMIT"}


def test_state_ends_when_idle(rocks, tmp_path):
    first = [[event(1, 0, 1, "a", "x")], *closing(1)]
    again = {**event(2, 0, 1, "a", "x"), "ts": "2024-02-20T00:00:00.000Z"}
    more = [[again], [{**event(10_000_900 + k, 0, 99, "z"), "ts": f"2024-03-0{k + 1}T00:00:00.000Z"} for k in range(1)], [{**event(10_000_910, 0, 99, "z"), "ts": "2024-03-05T00:00:00.000Z"}]]
    short = run(rocks, tmp_path, "short", first + more, idle="1 day")
    long = run(rocks, tmp_path, "long", first + more, idle="1000 days")
    assert [r[1:3] for r in short] == [("FIRST_SEEN", 1), ("FIRST_SEEN", 2)] and [r[1:3] for r in long] == [("FIRST_SEEN", 1)]


def test_a_live_chain_needs_a_window(spark):
    with pytest.raises(ValueError):
        live_detections(spark.createDataFrame([], SCHEMA), "user_id", Chain("x", chain().steps, window_us=None), F.lit(None), F.lit(True), 1)
