"""Readers of agents' transcripts into one event record.

Each takes lines (artifact, value: one JSON document) and gives a row for each event: artifact, session, time, item (place in its line),
event_type, text, model, tool, call_id, command, file_path, error.  A line that is no JSON object is an event of type trace_gap and keeps
its text; blank and null lines give none; repeated lines give repeated events.  Events keep no order but their time and item.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .telemetry import parse_time

_EVENT = "struct<event_type:string,text:string,model:string,tool:string,call_id:string,command:string,file_path:string,error:boolean>"
_NAMES = ("event_type", "text", "model", "tool", "call_id", "command", "file_path", "error")
_BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean,functionCall:struct<name:string,args:string>,functionResponse:struct<name:string,response:string>>>"


def _event(kind: str | Column, text: Column | None = None, **more: Column) -> Column:
    values = {"event_type": F.lit(kind) if isinstance(kind, str) else kind, "text": F.lit(None) if text is None else text, **more}
    return F.struct(*(values.get(n, F.lit(None)).cast("boolean" if n == "error" else "string").alias(n) for n in _NAMES))


def _none() -> Column:
    return F.array().cast(f"array<{_EVENT}>")


def _blocks(content: Column) -> Column:
    """The parts of a message: its array of objects, or its text as the only one."""
    parts = F.from_json(F.when(F.startswith(F.ltrim(content), F.lit("[")), content), _BLOCKS)
    whole = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))), _BLOCKS.removeprefix("array<")[:-1]))
    return F.when(content.isNull(), F.array().cast(_BLOCKS)).when(parts.isNull() | F.exists(parts, lambda p: p.isNull()), whole).otherwise(parts)


def _said(blocks: Column) -> Column:
    """The texts of a message's parts, a line each."""
    return F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull() & (t != "")), "\n")


def _input(arguments: Column) -> dict[str, Column]:
    """Command and file of a call's arguments; a command given as a list is joined by spaces."""
    raw = F.coalesce(*(F.get_json_object(arguments, f"$.{k}") for k in ("command", "cmd")))
    listed = F.from_json(F.when(F.startswith(raw, F.lit("[")), raw), "array<string>")
    return {"command": F.when(F.size(listed) > 0, F.array_join(listed, " ")).otherwise(raw), "file_path": F.coalesce(*(F.get_json_object(arguments, f"$.{k}") for k in ("file_path", "path")))}


def _told(kind: str, text: Column, **more: Column) -> Column:
    """One event where there is text, else none."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.array(_event(kind, text, **more))).otherwise(_none())


def _out(rows: DataFrame, session: Column, time: Column, events: Column) -> DataFrame:
    whole = F.when(F.get_json_object("value", "$").isNull() | ~F.startswith(F.ltrim("value"), F.lit("{")), F.array(_event("trace_gap", F.col("value")))).otherwise(events)
    found = rows.where("trim(value) <> ''").select("artifact", session.alias("session"), parse_time(time).alias("time"), F.posexplode(whole).alias("item", "__e"))
    return found.select("artifact", "session", "time", "item", *(F.col(f"__e.{n}").alias(n) for n in _NAMES))


def session_lines(lines: DataFrame) -> DataFrame:
    """Messages of typed parts: user lines are prompts (messages to a subagent where they are marked so) or results; assistant lines are responses and calls."""
    d = F.from_json("value", "type string, sessionId string, timestamp string, isSidechain boolean, message struct<model:string,content:string>")
    rows = lines.select("artifact", "value", d.alias("__d")).withColumn("__b", _blocks(F.col("__d.message.content")))
    blocks, kind, model = F.col("__b"), F.col("__d.type"), F.col("__d.message.model")
    results = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_result"), lambda b: _event("tool_result", _said(_blocks(b["content"])), call_id=b["tool_use_id"], error=F.coalesce(b["is_error"], F.lit(False))))
    prompt = F.array(_event(F.when(F.col("__d.isSidechain"), "agent_message").otherwise("human_prompt"), _said(blocks)))
    calls = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: _event("tool_call", model=model, tool=b["name"], call_id=b["id"], **_input(b["input"])))
    events = F.when(kind == "user", F.when(F.size(results) > 0, results).otherwise(prompt)).when(kind == "assistant", F.concat(_told("model_response", _said(blocks), model=model), calls)).otherwise(F.array(_event("session_meta", kind)))
    return _out(rows, F.col("__d.sessionId"), F.col("__d.timestamp"), events)


def rollout_lines(lines: DataFrame) -> DataFrame:
    """Envelopes of a type and a payload; a file's session is the id of its meta line (the least, if there are several; null without one)."""
    d = F.from_json("value", "timestamp string, type string, payload struct<type:string,id:string,role:string,model:string,content:string,name:string,arguments:string,input:string,action:string,call_id:string,output:string>")
    rows = lines.select("artifact", "value", d.alias("__d"))
    sessions = rows.where("__d.type = 'session_meta'").groupBy(F.col("artifact").alias("__a")).agg(F.min("__d.payload.id").alias("__s"))
    rows = rows.join(sessions, F.col("artifact").eqNullSafe(F.col("__a")), "left").withColumn("__b", _blocks(F.col("__d.payload.content")))
    p, said = F.col("__d.payload"), _said(F.col("__b"))
    arguments = F.coalesce(p["arguments"], p["input"], p["action"])
    item = F.when(p["type"] == "message", F.when(p["role"] == "user", _told("human_prompt", said)).when(p["role"] == "assistant", _told("model_response", said)).otherwise(F.array(_event("session_meta", said))))
    item = item.when(p["type"].isin("function_call", "custom_tool_call", "local_shell_call"), F.array(_event("tool_call", tool=F.coalesce(p["name"], p["type"]), call_id=p["call_id"], **_input(arguments))))
    item = item.when(p["type"].isin("function_call_output", "custom_tool_call_output"), F.array(_event("tool_result", p["output"], call_id=p["call_id"])))
    events = F.when(F.col("__d.type") == "session_meta", F.array(_event("session_meta", p["id"]))).when(F.col("__d.type") == "turn_context", F.array(_event("session_meta", F.lit("turn_context"), model=p["model"]))).when(F.col("__d.type") == "response_item", F.coalesce(item, _none())).otherwise(_none())
    return _out(rows, F.col("__s"), F.col("__d.timestamp"), events)


@dataclass(frozen=True)
class Fields:
    """Where a product's chat lines hold their parts, as JSON paths, and what they call their roles."""

    role: str = "$.role"
    content: tuple[str, ...] = ("$.content", "$.parts", "$.text")
    time: tuple[str, ...] = ("$.timestamp", "$.ts", "$.created_at")
    session: tuple[str, ...] = ("$.session_id", "$.sessionId", "$.conversation_id")
    people: tuple[str, ...] = ("user", "human")
    models: tuple[str, ...] = ("assistant", "model", "ai")


def chat_lines(lines: DataFrame, fields: Fields = Fields()) -> DataFrame:
    """One message a line: plain text, typed parts, parts with function calls, or text beside tool_calls."""
    get = lambda *paths: F.coalesce(*(F.get_json_object("value", p) for p in paths))
    rows = lines.select("artifact", "value").withColumn("__b", _blocks(get(*fields.content)))
    rows = rows.withColumn("__c", F.from_json(F.get_json_object("value", "$.tool_calls"), "array<struct<id:string,function:struct<name:string,arguments:string>>>"))
    blocks, role, said = F.col("__b"), F.lower(get(fields.role)), _said(F.col("__b"))
    typed = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: _event("tool_call", tool=b["name"], call_id=b["id"], **_input(b["input"])))
    parts = F.transform(F.filter(blocks, lambda b: b["functionCall"].isNotNull()), lambda b: _event("tool_call", tool=b["functionCall"]["name"], **_input(b["functionCall"]["args"])))
    beside = F.coalesce(F.transform("__c", lambda c: _event("tool_call", tool=c["function"]["name"], call_id=c["id"], **_input(c["function"]["arguments"]))), _none())
    results = F.concat(
        F.transform(F.filter(blocks, lambda b: b["type"] == "tool_result"), lambda b: _event("tool_result", _said(_blocks(b["content"])), call_id=b["tool_use_id"], error=F.coalesce(b["is_error"], F.lit(False)))),
        F.transform(F.filter(blocks, lambda b: b["functionResponse"].isNotNull()), lambda b: _event("tool_result", b["functionResponse"]["response"], tool=b["functionResponse"]["name"])),
    )
    told = F.when(role.isin(*fields.people), _told("human_prompt", said)).when(role.isin(*fields.models), _told("model_response", said)).when(role == "tool", F.array(_event("tool_result", said, call_id=get("$.tool_call_id")))).otherwise(F.array(_event("session_meta", said)))
    return _out(rows, get(*fields.session), get(*fields.time), F.concat(told, typed, parts, beside, results))


DIALECTS = {"session": session_lines, "rollout": rollout_lines, "chat": chat_lines}


def read(spark: SparkSession, path: str, dialect: str) -> DataFrame:
    """The events of the files under a path."""
    return DIALECTS[dialect](spark.read.text(path).select(F.col("_metadata.file_path").alias("artifact"), "value"))
