"""Packs: what is refused, and sequences on events by plain loops."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest

from vestige.plans import packs as K

STEPS = [{"event_types": ["tool_call"], "command_regex": "^a"}, {"command_regex": "^b"}]


def pack(**more):
    return json.dumps({"chains": [{"id": "A_B", "severity": "HIGH", "scope": "session", "window_minutes": 5, "steps": STEPS, **more}]})


@pytest.mark.parametrize("more", [{"id": "a_b"}, {"id": None}, {"severity": "BAD"}, {"scope": "planet"}, {"scope": "case"}, {"link": "colour"}, {"steps": STEPS[:1]}, {"steps": [{}, STEPS[1]]}, {"steps": [{"command_regex": "("}, STEPS[1]]}, {"steps": [{"command_regex": "a" * 3000}, STEPS[1]]}, {"steps": [{"verb": "x"}, STEPS[1]]}, {"steps": [{"tools": "Bash"}, STEPS[1]]}, {"steps": [{"or": [{}]}, STEPS[1]]}, {"window_minutes": -1}])
def test_refused_sequences(more):
    with pytest.raises(K.PackError):
        K.chains(pack(**more))


@pytest.mark.parametrize("text", ["", "[]", "{}", '{"rules": [{"id": "A_B", "severity": "LOW"}]}', '{"rules": [{"id": "A_B", "severity": "LOW", "pattern": "["}]}', '{"rules": [{"id": "A_B", "severity": "LOW", "contains": ["x"]}, {"id": "A_B", "severity": "LOW", "contains": ["x"]}]}'])
def test_refused_rules(text):
    with pytest.raises(K.PackError):
        K.rules(text)


def test_rules_of_a_pack(spark):
    from vestige.plans.rules import findings

    rules = K.rules(json.dumps({"rules": [{"id": "HAS_X", "severity": "LOW", "contains": ["Secret"]}, {"id": "HAS_Y", "severity": "HIGH", "pattern": "y$", "exclude": "no"}]}))
    df = spark.createDataFrame([(1, "a SECRET y"), (2, "no y"), (3, None), (4, "y\n")], "i int, s string")
    assert sorted((r.i, r.rule_id) for r in findings(df, rules, "s").collect()) == [(1, "HAS_X"), (1, "HAS_Y")]


@pytest.mark.parametrize("link", [None, "tool_call_id"])
def test_sequences_on_events(spark, link):
    draw, start = random.Random(5), datetime(2024, 5, 1, tzinfo=timezone.utc)
    rows = [("f", draw.choice(["s", "t"]), draw.choice([None, *range(60)]), 0, "tool_call", None, "Bash", draw.choice(["1", "2", None]), draw.choice(["a1", "b1", "c", "rm -rf /srv/x", "cat ~/.ssh/id_rsa"]), None, i) for i in range(60)]
    df = spark.createDataFrame([(*r[:2], None if r[2] is None else start + timedelta(minutes=r[2]), *r[3:]) for r in rows], "artifact string, session string, time timestamp, item int, event_type string, text string, tool string, call_id string, command string, file_path string, event_id long")
    steps = [{"tools": ["bash"], "command_regex": "^a"}, {"finding_rules": ["DESTRUCTIVE_COMMAND"], "or": [{"command_regex": "^b"}]}]
    got = sorted((r.scope_key, r.first_event, r.last_event) for r in K.sequence_findings(df, K.chains(pack(steps=steps, **({"link": link} if link else {}))), most=None).collect())
    want = []
    for s in ("s", "t"):
        own, i = sorted((r[2], r[10], r[8], r[7]) for r in rows if r[1] == s and r[2] is not None), 0
        while i < len(own):
            end = None
            if own[i][2].startswith("a"):
                end = next((j for j in range(i + 1, len(own)) if own[j][0] - own[i][0] <= 5 and own[j][2][0] in "br" and (not link or own[j][3] is not None and own[j][3] == own[i][3])), None)
            if end is not None:
                want.append((s, own[i][1], own[end][1]))
            i = i + 1 if end is None else end + 1
    assert got == sorted(want) and want
    assert K.sequence_findings(df.limit(0), K.chains(K.SEQUENCES)).count() == 0
