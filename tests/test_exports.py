"""Exported conversations: branches, forks, cycles, odd values and three products."""

import json

from vestige.sources import exports as X


def node(i, parent, text, role="user"):
    return {"id": i, "parent": parent, "message": {"author": {"role": role}, "content": {"parts": [text] if text else None}, "create_time": 5}}


def rows(doc):
    return [(r[4], r[5], r[6], r[7], r[9]) for r in X.conversation(doc if isinstance(doc, str) else json.dumps(doc))]


def test_the_branch_on_screen():
    mapping = {"root": {"id": "root", "parent": None, "message": None}, "a": node("a", "root", "one"), "b": node("b", "a", "old", "assistant"), "c": node("c", "a", "new", "assistant"), "d": node("d", "b", "lost")}
    assert rows({"id": "x", "mapping": mapping, "current_node": "c"}) == [("a", "root", "user", "one", "active"), ("b", "a", "assistant", "old", "alternate"), ("d", "b", "user", "lost", "alternate"), ("c", "a", "assistant", "new", "active")]
    assert [(r[0], r[4]) for r in rows({"id": "x", "mapping": mapping})] == [("a", "active"), ("b", "unresolved"), ("d", "unresolved"), ("c", "unresolved")]
    del mapping["b"], mapping["d"]
    assert [(r[0], r[4]) for r in rows({"mapping": mapping, "current_node": "gone"})] == [("a", "active"), ("c", "active")]


def test_cycles_missing_parents_and_odd_nodes():
    ring = {"a": node("a", "b", "x"), "b": node("b", "a", "y"), "c": node("c", "nowhere", "z"), "d": 5, "e": {"parent": ["a"], "message": {"author": "me", "content": 3}}}
    got = rows({"mapping": ring, "current_node": "b"})
    assert sorted((r[0], r[4]) for r in got) == [("a", "active"), ("b", "active"), ("c", "alternate"), ("e", "alternate")]
    assert rows({"mapping": {}}) == rows({"mapping": {"a": {}}}) == rows("") == rows("[]") == rows("{broken") == rows({"other": 1}) == []
    chain = {str(i): node(str(i), str(i - 1), "t") for i in range(50_000)}
    assert len(rows({"mapping": chain, "current_node": "49999"})) == 50_000


def test_lists_and_activities():
    flat = {"uuid": "u", "name": "T", "chat_messages": [{"uuid": "1", "sender": "human", "text": "hi", "created_at": "2024-01-01T00:00:01Z"}, {"uuid": "2", "sender": "assistant", "content": [{"type": "text", "text": "yo"}, {"type": "tool_use"}, {"text": "more"}]}, "odd"]}
    got = X.conversation(json.dumps(flat))
    assert [(r[0], r[1], r[3], r[6], r[7], r[8], r[9]) for r in got] == [("u", "T", 0, "user", "hi", 1704067201.0, "active"), ("u", "T", 1, "assistant", "yo\nmore", None, "active")]
    forked = {"uuid": "u", "current_leaf_message_uuid": "3", "chat_messages": [{"uuid": "1", "sender": "human", "text": "hi"}, {"uuid": "2", "parent_message_uuid": "1", "sender": "assistant", "text": "a"}, {"uuid": "3", "parent_message_uuid": "1", "sender": "assistant", "text": "b"}]}
    assert [(r[0], r[4]) for r in rows(forked)] == [("1", "active"), ("2", "alternate"), ("3", "active")]
    fragments = {"id": "d", "mapping": {"1": {"id": "1", "parent": None, "message": {"fragments": [{"type": "REQUEST", "content": "q"}], "inserted_at": "2024-01-01T00:00:00+00:00"}}, "2": {"id": "2", "parent": "1", "message": {"fragments": [{"type": "RESPONSE", "content": "r"}]}}}}
    assert [(r[2], r[3]) for r in rows(fragments)] == [("user", "q"), ("assistant", "r")]
    activity = {"header": "App", "title": "Prompted x", "time": "2024-01-01T00:00:00Z", "safeHtmlItem": [{"html": "<p>y</p>"}]}
    assert [(r[2], r[3]) for r in rows(activity)] == [("user", "Prompted x"), ("assistant", "<p>y</p>")]


def test_files(spark, tmp_path):
    flat = [{"uuid": str(i), "chat_messages": [{"uuid": "1", "sender": "human", "text": f"t{i}"}]} for i in range(5)]
    (tmp_path / "a.json").write_text(json.dumps(flat))
    (tmp_path / "b.json").write_text(" " + json.dumps(flat[0], indent=1))
    (tmp_path / "c.json").write_text("not json")
    (tmp_path / "d.json").write_text("")
    assert sorted(r.text for r in X.load(spark, str(tmp_path)).collect()) == ["t0", "t0", "t1", "t2", "t3", "t4"]
    assert X.messages(spark.createDataFrame([(None,), ("",)], "raw string"), "raw").count() == 0
