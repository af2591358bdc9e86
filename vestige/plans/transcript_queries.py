"""Queries on transcripts and telemetry lines: rows of the tables written in each dialect and read back, with SQL on the rows themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import sessions as D
from ..sinks import lines as K
from ..sources import carving as V, exports as X, lines as L, transcripts as S
from .queries import _t, query

_COLUMNS = ("session", "event_type", "text", "tool", "call_id", "command")


def _call() -> Column:
    return F.format_string("c%d-%d", "conv_id", "turn")


def _lines(turns: DataFrame, when: str, document: Column) -> DataFrame:
    return turns.where(when).select(F.col("conv_id").cast("string").alias("artifact"), F.to_json(document).alias("value"))



def _named(**parts: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in parts.items()))


_ID = "concat('c', conv_id, '-', turn)"
_TOLD = "SELECT CAST(conv_id AS VARCHAR) AS session, '{kind}' AS event_type, text, NULL AS tool, NULL AS call_id, NULL AS command FROM conversations WHERE {when}"
_CALLED = f"SELECT CAST(conv_id AS VARCHAR), 'tool_call', NULL, 'Bash', {_ID}, concat('ls -l ', conv_id) FROM conversations WHERE role = 'assistant'"
_RESULT = f"SELECT CAST(conv_id AS VARCHAR), 'tool_result', concat('done ', turn), NULL, {_ID}, NULL FROM conversations WHERE role = 'assistant'"
_BOTH = _TOLD.format(kind="human_prompt", when="role = 'user'{more}") + " UNION ALL " + _TOLD.format(kind="model_response", when="role = 'assistant' AND text <> ''")


def _ls() -> Column:
    return F.concat(F.lit("ls -l "), F.col("conv_id").cast("string"))


def _done() -> Column:
    return F.concat(F.lit("done "), F.col("turn").cast("string"))


@query(_BOTH.format(more="") + f" UNION ALL {_CALLED} UNION ALL {_RESULT}")
def session_transcripts(spark, d):
    turns = _t(spark, d, "conversations")
    base = {"sessionId": F.col("conv_id").cast("string"), "timestamp": F.lit("2024-05-01T10:00:00Z")}
    said = F.array(_named(type=F.lit("text"), text=F.col("text")))
    called = F.array(_named(type=F.lit("text"), text=F.col("text"), id=F.lit(None).cast("string"), name=F.lit(None).cast("string"), input=F.lit(None).cast("struct<command:string>")), _named(type=F.lit("tool_use"), text=F.lit(None).cast("string"), id=_call(), name=F.lit("Bash"), input=_named(command=_ls())))
    lines = [
        _lines(turns, "role = 'user' and turn % 4 = 0", _named(type=F.lit("user"), **base, message=_named(role=F.lit("user"), content=F.col("text")))),
        _lines(turns, "role = 'user' and turn % 4 <> 0", _named(type=F.lit("user"), **base, message=_named(role=F.lit("user"), content=said))),
        _lines(turns, "role = 'assistant'", _named(type=F.lit("assistant"), **base, message=_named(role=F.lit("assistant"), model=F.lit("m"), content=called))),
        _lines(turns, "role = 'assistant'", _named(type=F.lit("user"), **base, message=_named(role=F.lit("user"), content=F.array(_named(type=F.lit("tool_result"), tool_use_id=_call(), content=_done()))))),
    ]
    return S.session_lines(_all(lines)).select(*_COLUMNS)


def _all(lines: list[DataFrame]) -> DataFrame:
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out


@query(_BOTH.format(more=" AND text <> ''") + f" UNION ALL {_CALLED} UNION ALL {_RESULT} UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 'session_meta', CAST(conv_id AS VARCHAR), NULL, NULL, NULL FROM conversations")
def rollout_transcripts(spark, d):
    turns = _t(spark, d, "conversations")
    line = lambda kind, **payload: _named(timestamp=F.lit("2024-05-01T10:00:00Z"), type=F.lit(kind), payload=_named(**payload))
    arguments = F.to_json(_named(command=F.array(F.lit("ls"), F.lit("-l"), F.col("conv_id").cast("string"))))
    lines = [
        _lines(turns.select("conv_id").distinct(), "true", line("session_meta", id=F.col("conv_id").cast("string"))),
        _lines(turns, "role in ('user', 'assistant')", line("response_item", type=F.lit("message"), role=F.col("role"), content=F.array(_named(type=F.lit("input_text"), text=F.col("text"))))),
        _lines(turns, "role = 'assistant'", line("response_item", type=F.lit("function_call"), name=F.lit("Bash"), call_id=_call(), arguments=arguments)),
        _lines(turns, "role = 'assistant'", line("response_item", type=F.lit("function_call_output"), call_id=_call(), output=_done())),
    ]
    return S.rollout_lines(_all(lines)).select(*_COLUMNS)


@query(_BOTH.format(more=" AND text <> ''") + f" UNION ALL {_CALLED} UNION ALL {_RESULT}")
def chat_transcripts(spark, d):
    turns = _t(spark, d, "conversations")
    base = {"session_id": F.col("conv_id").cast("string"), "timestamp": F.lit(1714557600)}
    calls = F.array(_named(id=_call(), function=_named(name=F.lit("Bash"), arguments=F.to_json(_named(command=_ls())))))
    lines = [
        _lines(turns, "role = 'user' and turn % 4 = 0", _named(role=F.lit("user"), **base, content=F.col("text"))),
        _lines(turns, "role = 'user' and turn % 4 <> 0", _named(role=F.lit("user"), **base, parts=F.array(_named(text=F.col("text"))))),
        _lines(turns, "role = 'assistant'", _named(role=F.lit("assistant"), **base, content=F.col("text"), tool_calls=calls)),
        _lines(turns, "role = 'assistant'", _named(role=F.lit("tool"), **base, tool_call_id=_call(), content=_done())),
    ]
    return S.chat_lines(_all(lines)).select(*_COLUMNS)


_AT = "2024-05-01T10:00:00Z"
_KINDS = ("cloud", "cloud", "cloud", "dns", "network", "container", "cloud", "dns", "cloud", "dns")
_SOURCES = ("cloudtrail", "gcp", "azure", "zeek-dns", "zeek-ssl", "podman", "github", "bind", "s3", "dnsmasq")
_COMMANDS = ("s3:DeleteObject", "v1.compute.delete", "Microsoft.Compute/delete", None, None, "podman start", "repo.destroy", "A", "REST.GET.OBJECT", "AAAA")
_PEOPLE = ("{u}", "{u}", "{u}", None, None, None, "{u}", None, "{u}", None)
_HOSTS = (None, None, None, "h{u}.example.org", "h{u}.example.org", None, None, "h{u}.example.org", None, "h{u}.example.org")


def _cases(values) -> str:
    def sql(v: str) -> str:
        return "concat('" + v.replace("{u}", "', CAST(user_id AS VARCHAR), '") + "')"

    return f"CASE event_id % {len(values)} {' '.join(f'WHEN {i} THEN {sql(v)}' for i, v in enumerate(values) if v)} END"


@query(f"""SELECT event_id, {_cases(_KINDS)} AS kind, {_cases(_SOURCES)} AS source, {_cases(_COMMANDS)} AS cmdline, {_cases(_PEOPLE)} AS "user", {_cases(_HOSTS)} AS dest_host,
CASE WHEN event_id % 10 <> 9 THEN 1714557600 END AS seconds FROM events""")
def telemetry_lines(spark, d):
    u = F.col("user_id").cast("string")
    host = F.concat(F.lit("H"), u, F.lit(".example.org."))
    at = F.lit(_AT)
    forms = (
        F.to_json(_named(eventTime=at, eventSource=F.lit("s3.amazonaws.com"), eventName=F.lit("DeleteObject"), userIdentity=_named(arn=u))),
        F.to_json(_named(timestamp=at, protoPayload=_named(methodName=F.lit("v1.compute.delete"), authenticationInfo=_named(principalEmail=u)))),
        F.to_json(_named(time=at, operationName=_named(value=F.lit("Microsoft.Compute/delete")), caller=u)),
        F.to_json(_named(ts=F.lit(1714557600), query=host)),
        F.to_json(_named(ts=F.lit(1714557600), server_name=host)),
        F.to_json(_named(Time=at, Type=F.lit("Container"), Status=F.lit("start"), Image=F.lit("i"))),
        F.to_json(_named(created_at=at, action=F.lit("repo.destroy"), actor=u)),
        F.concat(F.lit("01-May-2024 10:00:00.123 queries: info: client @0x7f 10.0.0.1#5353 (x): query: "), host, F.lit(" IN A +E(0)K")),
        F.concat(F.lit("79a5 bucket [01/May/2024:10:00:00 +0000] 10.0.0.1 "), u, F.lit(" 3E57 REST.GET.OBJECT key \"GET /key HTTP/1.1\" 200")),
        F.concat(F.lit("May  1 10:00:00 dnsmasq[12]: query[AAAA] "), host, F.lit(" from 10.0.0.1")),
    )
    lines = _t(spark, d, "events").select("event_id", F.element_at(F.array(*forms), (F.col("event_id") % len(forms) + 1).cast("int")).alias("value"))
    return L.by_line(lines).select("event_id", "kind", "source", "cmdline", "user", "dest_host", F.unix_seconds("time").alias("seconds"))


@query("""WITH x AS (SELECT *, epoch_us(ts) AS u, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS UNBOUNDED PRECEDING) AS told FROM events)
SELECT c.user_id, c.event_id, arg_max(r.event_id, (r.u, r.event_id)) AS refused_event FROM x c JOIN x r ON c.user_id = r.user_id AND c.told = r.told AND c.props = r.props AND (r.u, r.event_id) < (c.u, c.event_id) AND r.event_type = 'error' AND c.event_type = 'click' GROUP BY 1, 2""")
def autonomous_retry(spark, d):
    k = F.col("event_type")
    events = _t(spark, d, "events").withColumn("u", F.unix_micros(F.col("ts").cast("timestamp")))
    return D.refused_then_repeated(events, "user_id", ["props"], k == "error", k == "click", k == "signup", "u", "event_id")


_UUID = "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1), substr(h, 18, 3), '-', substr(h, 21, 12))"
_NAMED = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat(event_type, '|', user_id, '|', event_id{more})))"


def _found(spark, d) -> DataFrame:
    severity = F.when(F.col("value") > 80, "CRITICAL").when(F.col("value") > 40, "MEDIUM").otherwise("odd")
    return _t(spark, d, "events").select(F.col("event_type").alias("rule_id"), severity.alias("severity"), F.concat(F.lit('a "'), F.col("props"), F.lit('"')).alias("title"), F.col("user_id").alias("session_id"), F.col("event_id").cast("string").alias("ref"))


def _fields(lines: DataFrame, **paths: str) -> DataFrame:
    return lines.select(*(F.get_json_object("value", p).alias(n) for n, p in paths.items()))


@query(f"""SELECT event_type AS rule, CASE WHEN value > 80 THEN 'error' WHEN value > 40 THEN 'warning' ELSE 'none' END AS level, concat('a "', props, '"') AS message, {_UUID} AS fingerprint, CAST(event_id AS VARCHAR) AS uri FROM (SELECT *, {_NAMED.format(more='')} AS h FROM events)""")
def sarif_results(spark, d):
    return _fields(K.sarif_results(_found(spark, d)), rule="$.ruleId", level="$.level", message="$.message.text", fingerprint="$.partialFingerprints['id/v1']", uri="$.locations[0].physicalLocation.artifactLocation.uri")


@query(f"""SELECT concat('note--', {_UUID}) AS id, concat('a "', props, '" Severity: ', CASE WHEN value > 80 THEN 'CRITICAL' WHEN value > 40 THEN 'MEDIUM' ELSE 'odd' END, '. Evidence: ', event_id) AS content FROM (SELECT *, {_NAMED.format(more=", '|a " + chr(34) + "', props, '" + chr(34) + "'")} AS h FROM events)""")
def stix_notes(spark, d):
    return _fields(K.stix_notes(_found(spark, d), "report--1"), id="$.id", content="$.content")


@query("""SELECT CAST(epoch_us(ts) * 1000 AS VARCHAR) AS nanos, CASE event_type WHEN 'view' THEN 'execute_tool' WHEN 'click' THEN 'chat' ELSE event_type END AS operation, CAST(user_id AS VARCHAR) AS session, CASE WHEN event_type = 'view' THEN 'gen_ai.tool.name' END AS third, props AS body FROM events""")
def otlp_records(spark, d):
    k = F.col("event_type")
    events = _t(spark, d, "events").select("ts", F.when(k == "view", "tool_call").when(k == "click", "human_prompt").otherwise(k).alias("event_type"), F.col("props").alias("text"), F.col("user_id").alias("session"), F.lit(None).cast("string").alias("model"), F.when(k == "view", "Bash").alias("tool"))
    return _fields(K.otlp_records(events), nanos="$.timeUnixNano", operation="$.attributes[0].value.stringValue", session="$.attributes[1].value.stringValue", third="$.attributes[2].key", body="$.body.stringValue")


def _exported(spark, d):
    """Conversations as exports: of three, a tree with the node on screen, a tree without one, and a list; every third turn has a sibling that was left behind."""
    c = _t(spark, d, "conversations").where("text is not null")
    node = lambda prefix, text: F.struct(F.concat(F.lit(prefix), F.col("turn").cast("string")).alias("id"), F.when(F.col("turn") > 0, F.concat(F.lit("n"), (F.col("turn") - 1).cast("string"))).alias("parent"), F.struct(F.struct(F.col("role").alias("role")).alias("author"), F.struct(F.array(text).alias("parts")).alias("content"), F.col("turn").cast("double").alias("create_time")).alias("message"))
    nodes = F.when((F.col("turn") % 3 == 1) & (F.col("conv_id") % 3 < 2), F.array(node("n", F.col("text")), node("a", F.concat(F.lit("draft "), F.col("text"))))).otherwise(F.array(node("n", F.col("text"))))
    flat = F.struct(F.concat(F.lit("n"), F.col("turn").cast("string")).alias("uuid"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.col("text"))
    g = c.select("conv_id", "turn", nodes.alias("nodes"), flat.alias("flat")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "nodes", "flat"))).alias("all"), F.max("turn").alias("top"))
    tree = F.map_from_entries(F.transform(F.flatten(F.transform("all", lambda x: x["nodes"])), lambda n: F.struct(n["id"], n)))
    current = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("n"), F.col("top").cast("string")))
    as_tree = F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), current.alias("current_node"), tree.alias("mapping")))
    return g.select(F.when(F.col("conv_id") % 3 < 2, as_tree).otherwise(F.to_json(F.struct(F.col("conv_id").cast("string").alias("uuid"), F.transform("all", lambda x: x["flat"]).alias("chat_messages")))).alias("raw"))


@query("""WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL), n AS (SELECT conv_id, 'n' || turn AS node_id, turn, role, text FROM c UNION ALL SELECT conv_id, 'a' || turn, turn, role, 'draft ' || text FROM c WHERE turn % 3 = 1 AND conv_id % 3 < 2)
SELECT CAST(conv_id AS VARCHAR) AS conv_id, node_id, CASE WHEN conv_id % 3 < 2 THEN 'tree' ELSE 'list' END AS product, role, sha256(text) AS text_sha256, CASE WHEN conv_id % 3 = 1 AND turn >= 1 AND (SELECT count(*) FROM c WHERE c.conv_id = n.conv_id) > 1 THEN 'unresolved' WHEN node_id LIKE 'a%' THEN 'alternate' ELSE 'active' END AS branch FROM n""")
def export_branches(spark, d):
    m = X.messages(_exported(spark, d), "raw")
    return m.select("conv_id", "node_id", "product", "role", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "branch")


@query("""SELECT CAST(conv_id AS VARCHAR) AS path, role, sha256(text) AS text_sha256 FROM conversations WHERE text IS NOT NULL AND turn % 5 <> 2""")
def carved_messages(spark, d):
    """Each conversation's messages in one damaged file: junk between them, every fifth cut short, every third inside another object."""
    c = _t(spark, d, "conversations").where("text is not null")
    whole = F.to_json(_named(role=F.col("role"), content=F.col("text")))
    told = F.when(F.col("turn") % 5 == 2, F.substr(whole, F.lit(1), F.length(whole) - 2)).when(F.col("turn") % 3 == 0, F.concat(F.lit('{"outer": [1, '), whole, F.lit("], "))).otherwise(whole)
    junk = F.concat(F.unhex(F.lit("fffe007b227d")), F.lit(' {"a": {"b": 1}} ]} ').cast("binary"))
    turns = c.select("conv_id", "turn", F.concat(junk, told.cast("binary")).alias("bytes")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "bytes"))).alias("all"))
    files = turns.select(F.col("conv_id").cast("string").alias("path"), F.aggregate("all", F.lit(b""), lambda out, x: F.concat(out, x["bytes"])).alias("content"))
    return V.carve(files, piece=512, most=65536).select("path", "role", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
