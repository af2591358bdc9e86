"""Rules and sequences as data: JSON packs, checked and compiled to Columns."""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import commands as C, text as T
from ..operators.graphs import cut
from .detections import OWN_CONFIGURATION, detections
from .rules import Chain, Rule, Step, chain_matches, java_pattern

SEVERITIES, SCOPES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"), ("session", "artifact", "case")
#: What two steps may share, as the values that an event has of it.
LINKS = {"tool_call_id": lambda: F.array("call_id"), "file": lambda: F.array("file_path"), "network_destination": lambda: T.destinations(F.col("command")), "mcp_server": lambda: F.array(F.nullif(F.regexp_extract("tool", "^mcp__(.+?)__", 1), F.lit("")))}
_PATTERNS = {"command_regex": "command", "file_regex": "file_path", "text_regex": "text", "tool_regex": "tool"}
_STEP = {"name", "event_types", "tools", "finding_rules", "upload", "outbound", "mcp", "or", *_PATTERNS}
#: Longest pattern of a pack.
MOST_PATTERN = 2048

#: Sequences whose steps rest on built detections.
SEQUENCES = json.dumps({"chains": [
    {"id": "CHAIN_CONTEXT_POISON_TO_EXEC", "severity": "CRITICAL", "scope": "session", "window_minutes": 120, "steps": [
        {"name": "injection in tool result", "event_types": ["tool_result"], "finding_rules": ["PROMPT_INJECTION_INDICATOR", "MCP_TOOL_POISONING", "INVISIBLE_UNICODE_INSTRUCTION"]},
        {"name": "agent wrote its own instructions/config", "finding_rules": ["AGENT_SELF_MODIFICATION"], "or": [{"event_types": ["tool_call"], "file_regex": OWN_CONFIGURATION}]},
        {"name": "shell command executed", "event_types": ["tool_call"], "command_regex": "\\S"}]},
    {"id": "CHAIN_SECRET_TO_EXFIL", "severity": "CRITICAL", "scope": "session", "window_minutes": 60, "steps": [
        {"name": "secret or credential file accessed", "finding_rules": ["SECRET_ACCESS", "POTENTIAL_SECRET_EXPOSURE", "SENSITIVE_FILE_READ"]},
        {"name": "upload-shaped command", "event_types": ["tool_call"], "upload": True}]},
    {"id": "CHAIN_MCP_RESULT_TO_DESTRUCTIVE", "severity": "CRITICAL", "scope": "session", "window_minutes": 60, "steps": [
        {"name": "poisoned MCP tool result", "event_types": ["tool_result"], "finding_rules": ["MCP_TOOL_POISONING", "PROMPT_INJECTION_INDICATOR"]},
        {"name": "destructive command", "finding_rules": ["DESTRUCTIVE_COMMAND", "LOG_DELETION"]}]},
    {"id": "CHAIN_INJECTION_TO_PUSH", "severity": "HIGH", "scope": "session", "window_minutes": 180, "steps": [
        {"name": "injection in tool result", "event_types": ["tool_result"], "finding_rules": ["PROMPT_INJECTION_INDICATOR", "MCP_TOOL_POISONING", "INVISIBLE_UNICODE_INSTRUCTION"]},
        {"name": "commit created", "finding_rules": ["AGENT_GENERATED_COMMIT"]},
        {"name": "pushed to remote", "finding_rules": ["AGENT_GENERATED_PUSH"]}]},
    {"id": "CHAIN_ACTION_THEN_LOG_TAMPER", "severity": "CRITICAL", "scope": "session", "window_minutes": 120, "steps": [
        {"name": "destructive or exfil action", "finding_rules": ["DESTRUCTIVE_COMMAND", "POTENTIAL_DATA_EXFILTRATION", "UNEXPECTED_NETWORK_DESTINATION"]},
        {"name": "agent logs deleted", "finding_rules": ["LOG_DELETION"]}]},
]})


class PackError(ValueError):
    """A pack that can't be used; the message names the rule or sequence and what is wrong with it."""


def _pattern(where: str, pattern) -> str:
    if not isinstance(pattern, str) or not pattern or len(pattern) > MOST_PATTERN:
        raise PackError(f"{where}: a pattern is text of 1 to {MOST_PATTERN} characters")
    try:
        re.compile(re.sub(r"^\(\?d\)", "", java_pattern(pattern)).replace(r"\z", r"\Z"))
    except re.error as e:
        raise PackError(f"{where}: {e}") from None
    return pattern


def _named(kind: str, entry, seen: set[str]) -> str:
    name = entry.get("id") if isinstance(entry, dict) else None
    if not isinstance(name, str) or not re.fullmatch(r"[A-Z][A-Z0-9]*(_[A-Z0-9]+)+", name):
        raise PackError(f"{kind} {name!r}: the id must be UPPER_SNAKE")
    if name in seen:
        raise PackError(f"{kind} {name}: the id is there twice")
    if entry.get("severity") not in SEVERITIES:
        raise PackError(f"{kind} {name}: severity must be one of {', '.join(SEVERITIES)}")
    seen.add(name)
    return name


def rules(text: str) -> list[Rule]:
    """The rules of a pack: {"rules": [{"id", "severity", "contains", "pattern", "exclude"}]}."""
    out, seen = [], set()
    for r in _entries(text, "rules"):
        name = _named("rule", r, seen)
        contains = r.get("contains") or []
        if not isinstance(contains, list) or not all(isinstance(c, str) and c for c in contains) or not (contains or r.get("pattern")):
            raise PackError(f"rule {name}: needs a list of texts, or a pattern")
        out.append(Rule(name, r["severity"], tuple(c.lower() for c in contains), *(_pattern(f"rule {name}", r[k]) if r.get(k) else "" for k in ("pattern", "exclude"))))
    return out


def _entries(text: str, kind: str) -> list:
    try:
        pack = json.loads(text)
    except ValueError as e:
        raise PackError(f"no JSON: {e}") from None
    if not isinstance(pack, dict) or not isinstance(pack.get(kind), list):
        raise PackError(f"a pack has a list of {kind}")
    return pack[kind]


def _checked(where: str, step) -> None:
    if not isinstance(step, dict) or set(step) - _STEP:
        raise PackError(f"{where}: a step knows {', '.join(sorted(_STEP))} alone")
    if not set(step) - {"name", "or"} and not step.get("or"):
        raise PackError(f"{where}: a step without a condition matches everything")
    for k in _PATTERNS:
        if k in step:
            _pattern(where, step[k])
    for k in ("event_types", "tools", "finding_rules"):
        if k in step and not (isinstance(step[k], list) and step[k] and all(isinstance(v, str) for v in step[k])):
            raise PackError(f"{where}: {k} is a list of names")
    for other in step.get("or") or []:
        _checked(where, other)


def chains(text: str) -> list[dict]:
    """The sequences of a pack, checked: {"chains": [{"id", "severity", "scope", "window_minutes", "link", "steps"}]}.

    A sequence has two steps or more; one over the whole case needs a link, as order and a window alone don't say that two sessions belong together.
    """
    out, seen = [], set()
    for c in _entries(text, "chains"):
        name = _named("sequence", c, seen)
        if c.get("scope") not in SCOPES:
            raise PackError(f"sequence {name}: scope must be one of {', '.join(SCOPES)}")
        if c.get("link") is not None and c["link"] not in LINKS:
            raise PackError(f"sequence {name}: link must be one of {', '.join(LINKS)}")
        if c["scope"] == "case" and not c.get("link"):
            raise PackError(f"sequence {name}: a case needs a link")
        if not isinstance(c.get("window_minutes", 0), (int, float)) or c.get("window_minutes", 0) < 0:
            raise PackError(f"sequence {name}: window_minutes is a number")
        if not isinstance(c.get("steps"), list) or len(c["steps"]) < 2:
            raise PackError(f"sequence {name}: needs two steps or more")
        for i, step in enumerate(c["steps"]):
            _checked(f"sequence {name}, step {i + 1}", step)
        out.append(c)
    return out


def condition(step: dict) -> Column:
    """All that a step asks for, or one of its alternatives, of an event with __fired (its rules), __upload and __outbound.  Nulls ask in vain."""
    tests = [F.lower("event_type").isin(*map(str.lower, step["event_types"]))] if "event_types" in step else []
    tests += [F.lower("tool").isin(*map(str.lower, step["tools"]))] if "tools" in step else []
    tests += [F.arrays_overlap("__fired", F.array(*map(F.lit, step["finding_rules"])))] if "finding_rules" in step else []
    tests += [F.rlike(column, F.lit(java_pattern(step[k]))) for k, column in _PATTERNS.items() if k in step]
    tests += [F.col(f"__{k}") for k in ("upload", "outbound") if step.get(k)]
    tests += [F.startswith("tool", F.lit("mcp__"))] if step.get("mcp") else []
    whole = F.coalesce(reduce(and_, tests), F.lit(False)) if tests else F.lit(False)
    return reduce(or_, map(condition, step.get("or") or []), whole)


def sequence_findings(events: DataFrame, pack: list[dict], id: str = "event_id", most: int | None = None) -> DataFrame:
    """Greedy matches of a pack's sequences on transcript events: rule_id, severity, scope_key, first_event, last_event, first_time, last_time.

    events: those of detections() with a long id that orders events of one time; a step may ask for what detections() finds on an event.  Each
    scope has all matches of a sequence, or the first so many where most asks for that.  Events without a time are in none; no events give none.
    """
    events = cut(events)  # read by every rule, the sequences and the times
    fired = detections(events, keep=(id,)).groupBy(id).agg(F.collect_set("rule_id").alias("__fired"))  # no more than there are rules
    shapes = events.select("command").where("command <> ''").distinct().select(F.col("command").alias("__c"), C.is_upload(F.col("command")).alias("__upload"), C.is_outbound(F.col("command")).alias("__outbound"))
    e = events.join(fired, id, "left").join(shapes, F.col("command") == F.col("__c"), "left").drop("__c").withColumn("__at", F.unix_micros("time"))
    wanted = reduce(or_, (condition(s) for c in pack for s in c["steps"]))
    e = cut(e.where(wanted))  # rows that can be a step; every sequence reads them
    out = None
    for c in pack:
        link = c.get("link")
        key = {"session": F.col("session"), "artifact": F.col("artifact"), "case": F.lit("case")}[c["scope"]]
        rows = e.withColumn("__key", key).withColumn("__link", F.array_compact(LINKS[link]()) if link else F.lit(None).cast("array<string>"))
        chain = Chain(c["id"], tuple(Step(condition(s)) for s in c["steps"]), int(c.get("window_minutes", 0) * 60_000_000), "__link" if link else None)
        found = chain_matches(rows, chain, "__key", "__at", id, most).select(F.col("chain_id").alias("rule_id"), F.lit(c["severity"]).alias("severity"), F.col("__key").alias("scope_key"), "first_event", "last_event")
        out = found if out is None else out.unionByName(found)
    times = events.select(F.col(id).alias("__e"), "time")
    for end in ("first", "last"):
        out = out.join(times.withColumnRenamed("time", f"{end}_time"), F.col(f"{end}_event") == F.col("__e")).drop("__e")
    return out
