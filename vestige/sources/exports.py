"""Account exports of chat services: message trees and lists as rows, with the branch on screen told from abandoned ones."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "conv_id string, title string, product string, seq int, node_id string, parent_id string, role string, text string, at double, branch string"
_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]
#: Names that products give to the two sides.
ROLES = {"human": "user", "USER": "user", "REQUEST": "user", "RESPONSE": "assistant", "ASSISTANT": "assistant", "THINK": "assistant", "SEARCH": "tool", "system": "system", "tool": "tool"}


def _said(value) -> str | None:
    """The text of a content value: a string, its parts, blocks with text, or fragments."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return _said(value.get("parts") if value.get("parts") is not None else value.get("text") if value.get("text") is not None else value.get("content"))
    if isinstance(value, list):
        parts = [t for t in map(_said, value) if t]
        return "\n".join(parts) if parts else None
    return None


def _time(value) -> float | None:
    """Seconds since 1970 of a number or an ISO time."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if isinstance(value, str):
        from datetime import datetime, timezone

        try:
            t = datetime.fromisoformat(value)
        except ValueError:
            return None
        return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp()
    return None


def _message(m: dict) -> tuple[str | None, str | None, float | None]:
    author = m.get("author")
    role = author.get("role") if isinstance(author, dict) else m.get("sender") or m.get("role")
    fragments = m.get("fragments") if isinstance(m.get("fragments"), list) else []
    if role is None and fragments and isinstance(fragments[0], dict):
        role = fragments[0].get("type")
    text = _said(m.get("content")) if m.get("content") is not None else _said(fragments) or _said(m.get("text"))
    at = next((t for t in map(_time, (m.get("create_time"), m.get("inserted_at"), m.get("created_at"))) if t is not None), None)
    return ROLES.get(role, role) if isinstance(role, str) else None, text, at


def _linear(nodes: dict[str, tuple[str | None, dict | None]], current: str | None) -> list[tuple[str, str | None, str]]:
    """(node, parent, branch) of a tree, parents first and siblings as they stand: active is the chain from the current node up; without one, what lies on
    every path.  A parent that is not there, or a cycle, makes a root."""
    children: dict[str | None, list[str]] = {}
    for node, (parent, _) in nodes.items():
        children.setdefault(parent if parent in nodes and parent != node else None, []).append(node)
    order, seen = [], set()
    for root in [*children.get(None, []), *nodes]:  # the nodes of a cycle hang on no root
        stack = [root]
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                order.append(n)
                stack += reversed(children.get(n, []))
    active: set[str] = set()
    if current in nodes:
        n = current
        while n in nodes and n not in active:
            active.add(n)
            n = nodes[n][0]
        other = "alternate"
    else:
        level, other = children.get(None, []), "unresolved"
        while len(level) == 1 and level[0] not in active:  # down to the first fork
            active.add(level[0])
            level = children.get(level[0], [])
    return [(n, nodes[n][0] if nodes[n][0] in nodes else None, "active" if n in active else other) for n in order]


def conversation(raw: str) -> list[tuple]:
    """The rows of one exported conversation or activity; none for what is no JSON object or has no messages."""
    try:
        doc = json.loads(raw)
    except (ValueError, TypeError, RecursionError):
        return []
    if not isinstance(doc, dict):
        return []
    named = next((str(doc[k]) for k in ("conversation_id", "id", "uuid") if doc.get(k) is not None), None)
    title = next((doc[k] for k in ("title", "name") if isinstance(doc.get(k), str)), None)
    if isinstance(doc.get("mapping"), dict):
        product, entries = "tree", [(v.get("id") if isinstance(v.get("id"), str) else k, v.get("parent"), v.get("message")) for k, v in doc["mapping"].items() if isinstance(v, dict)]
        current = doc.get("current_node")
    elif isinstance(doc.get("chat_messages"), list):
        product, entries = "list", []
        for i, m in enumerate(m for m in doc["chat_messages"] if isinstance(m, dict)):
            entries.append((str(m.get("uuid") or i), m.get("parent_message_uuid") or (entries[-1][0] if entries else None), m))
        current = doc.get("current_leaf_message_uuid") or (entries[-1][0] if entries else None)
    elif isinstance(doc.get("header"), str) and isinstance(doc.get("title"), str):
        replies = "\n".join(x["html"] for x in doc.get("safeHtmlItem") or [] if isinstance(x, dict) and isinstance(x.get("html"), str))
        at = _time(doc.get("time"))
        rows = [(named, doc["header"], "activity", 0, "0", None, "user", doc["title"], at, "active")]
        return rows + ([(named, doc["header"], "activity", 1, "1", "0", "assistant", replies, at, "active")] if replies else [])
    else:
        return []
    nodes: dict[str, tuple[str | None, dict | None]] = {}
    for node, parent, message in entries:
        nodes.setdefault(node, (parent if isinstance(parent, str) else None, message if isinstance(message, dict) else None))
    rows = []
    for node, parent, branch in _linear(nodes, current if isinstance(current, str) else None):
        if (message := nodes[node][1]) is not None:
            role, text, at = _message(message)
            rows.append((named, title, product, len(rows), node, parent, role, text, at, branch))
    return rows


def messages(rows: DataFrame, column: str) -> DataFrame:
    """The messages of conversations, one JSON text a row, as SCHEMA: seq counts from 0 with parents first; branch is active (on screen), alternate (left behind by
    an edit or a new answer) or unresolved (behind a fork of which the export doesn't name the side on screen).

    Nodes without a message only join others.  Broken or other texts give no rows; a node that is named twice counts once; an empty table has none.
    """

    def read(batches):
        for b in batches:
            out = [r for raw in b.column(0).to_pylist() for r in conversation(raw)]
            kinds = [pa.int32() if n == "seq" else pa.float64() if n == "at" else pa.string() for n in _NAMES]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=_NAMES)

    return rows.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).mapInArrow(read, SCHEMA)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The messages of export files, each one a JSON list of conversations or one conversation."""
    files = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    single = F.array("value")
    return messages(files.select(F.explode(F.when(F.startswith("value", F.lit("[")), F.from_json("value", "array<string>")).otherwise(single)).alias("raw")), "raw")
