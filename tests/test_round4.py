"""Findings of round 4: whole results."""

import datetime
import random

import duckdb
import pytest

import __spark_entry__ as entry
from vestige.operators import joins as J

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_all_matches_of_a_key_are_found(spark, tmp_path):
    """a user's matches beyond the twentieth."""
    at, steps = datetime.datetime(2024, 1, 1), ("view", "click", "purchase")
    rows = [(3 * i + j, at + datetime.timedelta(minutes=3 * i + j), 7, k, 1.0, "{}") for i in range(45) for j, k in enumerate(steps)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.first_event, r.last_event) for r in entry.queries()["chain3_greedy"](spark, str(tmp_path)).collect())
    assert got == [(3 * i, 3 * i + 2) for i in range(45)]


def test_all_matches_of_a_sequence_are_found(spark, tmp_path):
    """a session's matches beyond the twentieth, in a conversation of many turns."""
    rows = [(0, t, "assistant", "done") for t in range(0, 1600)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in entry.queries()["transcript_sequences"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = [tuple(r) for r in c.execute(entry.oracle_sql()["transcript_sequences"]).fetchall()]
    assert sorted(got) == sorted(want)


def likeness(x, y):
    return len(x & y) / len(x | y)


def test_copies_are_compared_once(spark, monkeypatch):
    """equal sets give no candidates, one of them stands for all; their pairs are made at the end."""
    rng, seen = random.Random(3), []
    base = [f"w{i}" for i in range(40)]
    rows = [(i, rng.sample(base, 40)) for i in range(70)] + [(100 + i, base[:39] + [f"x{i % 2}"]) for i in range(30)] + [(200, None), (201, []), (202, [None]), (None, base)]
    whole = J.candidates
    monkeypatch.setattr(J, "candidates", lambda *a: seen.append(whole(*a)) or seen[0])
    got = sorted(tuple(r) for r in J.similar(spark.createDataFrame(rows, "id long, w array<string>"), "id", "w", 0.8).collect())
    sets = [(i, set(w)) for i, w in rows if i is not None and w and w != [None]]
    assert got == [(a, b, likeness(x, y)) for a, x in sets for b, y in sets if a < b]
    assert seen[0].count() == 3


@pytest.mark.parametrize("least", [0.8, 0.45])
def test_large_sets_are_cut_alike(spark, monkeypatch, least):
    """sets cut into parts, of sizes about those where their number doubles, in many cells; tokens whose counts share places."""
    for name, value in (("PART", 8), ("CELL", 3), ("PLACES", 64), ("PIECE", 100)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(least)
    centres = [[f"t{t}" for t in rng.sample(range(400), n)] for n in (3, 7, 8, 9, 15, 17, 31, 33, 40)]
    rows = []
    for i in range(180):
        c = rng.choice(centres)
        kept = [t for t in c if rng.random() > rng.choice([0, 0.05, 0.2])] + [f"t{rng.randrange(400)}" for _ in range(rng.randrange(len(c) // 4 + 1))]
        rows.append((i * 7 % 181, kept + kept[:1]))
    got = {(r.a, r.b): r.jaccard for r in J.similar(spark.createDataFrame(rows, "id long, w array<string>"), "id", "w", least).collect()}
    sets = [(i, set(w)) for i, w in rows if w]
    assert got == {(a, b): likeness(x, y) for a, x in sets for b, y in sets if a < b and likeness(x, y) >= least}
    assert len(got) > 100
