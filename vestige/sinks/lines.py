"""Events and findings as documents of other tools, one string a row: write them with df.write.text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import SEVERITIES, rank, uuid5


def ocsf_findings(findings: DataFrame) -> DataFrame:
    """Detection findings (class 2004) of rule_id, severity, title, ts."""
    severity = F.lit(5) - rank(F.col("severity"), SEVERITIES)
    doc = F.struct(F.lit(2004).alias("class_uid"), F.lit(2).alias("category_uid"), F.greatest(severity, F.lit(0)).alias("severity_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), F.struct(F.col("rule_id").alias("uid"), F.col("title").alias("title")).alias("finding_info"))
    return findings.select(F.to_json(doc).alias("value"))


def timesketch(events: DataFrame) -> DataFrame:
    """JSON lines of message, datetime, timestamp_desc."""
    return events.select(F.to_json(F.struct(F.col("message"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("datetime"), F.col("kind").alias("timestamp_desc"))).alias("value"))


def l2t_csv(events: DataFrame) -> DataFrame:
    """The 17 comma-separated columns of a super timeline, for df.write.csv."""
    blank = F.lit("-")
    return events.select(F.date_format("ts", "MM/dd/yyyy").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"), F.lit("UTC").alias("timezone"), F.lit("....").alias("MACB"), F.lit("LOG").alias("source"), F.col("kind").alias("sourcetype"), F.col("kind").alias("type"), F.col("user"), blank.alias("host"), F.substring("message", 1, 80).alias("short"), F.col("message").alias("desc"), F.lit(2).alias("version"), blank.alias("filename"), blank.alias("inode"), blank.alias("notes"), blank.alias("format"), blank.alias("extra"))


def dot(edges: DataFrame) -> DataFrame:
    """Edge lines of a Graphviz digraph (from, to, relation); nulls are empty names."""

    def quoted(c: str) -> Column:
        return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    return edges.select(F.concat(quoted("from"), F.lit(" -> "), quoted("to"), F.lit(" [label="), quoted("relation"), F.lit("];")).alias("value"))


def digraph(edges: DataFrame, name: str = "events") -> DataFrame:
    """A whole Graphviz file: its head, dot()'s lines and its end, in the order of the partitions."""
    head, end = (edges.sparkSession.range(1).select(F.lit(x).alias("value")) for x in (f"digraph {name} {{", "}"))
    return head.unionByName(dot(edges)).unionByName(end)


#: Namespace of the identifiers that are made from what they name, and the SARIF levels of severities.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}


def _identity(*parts: str) -> Column:
    return uuid5(NAMESPACE, F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)))


def sarif_results(findings: DataFrame) -> DataFrame:
    """Results of SARIF 2.1 from rule_id, severity, title, session_id, ref: equal findings have equal fingerprints; nulls are left out."""
    level = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair)), F.col("severity")), F.lit("none"))
    place = F.array(F.struct(F.struct(F.struct(F.col("ref").alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    doc = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.struct(_identity("rule_id", "session_id", "ref").alias("id/v1")).alias("partialFingerprints"), F.when(F.col("ref").isNotNull(), place).alias("locations"), F.struct(F.col("session_id").cast("string").alias("session_id")).alias("properties"))
    return findings.select(F.to_json(doc).alias("value"))


def otlp_records(events: DataFrame) -> DataFrame:
    """Log records with generative-AI attributes from ts, event_type, text, session, model, tool; attributes without a value are left out."""
    kind = F.col("event_type")
    operation = F.when(kind == "tool_call", "execute_tool").when(kind == "agent_spawn", "create_agent").when(kind.isin("model_response", "human_prompt"), "chat").otherwise(kind)
    values = {"gen_ai.operation.name": operation, "session.id": F.col("session"), "gen_ai.request.model": F.col("model"), "gen_ai.tool.name": F.col("tool")}
    pairs = F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value"))) for k, v in values.items()))
    nanos = F.concat(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.lit("000"))
    doc = F.struct(nanos.alias("timeUnixNano"), F.lit("INFO").alias("severityText"), F.struct(F.col("text").alias("stringValue")).alias("body"), F.filter(pairs, lambda p: p.isNotNull()).alias("attributes"))
    return events.select(F.to_json(doc).alias("value"))


def stix_notes(findings: DataFrame, report: str, created: str = "1970-01-01T00:00:00.000Z") -> DataFrame:
    """Notes of STIX 2.1 on a report, from rule_id, severity, title, session_id, ref: equal findings have equal ids, whenever they are written."""
    content = F.concat_ws(" ", F.col("title"), F.concat(F.lit("Severity: "), F.col("severity"), F.lit(".")), F.concat(F.lit("Evidence: "), F.col("ref")))
    fixed = {"type": "note", "spec_version": "2.1", "created": created, "modified": created}
    doc = F.struct(*(F.lit(v).alias(k) for k, v in fixed.items()), F.concat(F.lit("note--"), _identity("rule_id", "session_id", "ref", "title")).alias("id"), F.col("title").alias("abstract"), content.alias("content"), F.array(F.lit(report)).alias("object_refs"))
    return findings.select(F.to_json(doc).alias("value"))


def mermaid(edges: DataFrame) -> DataFrame:
    """Edge lines of a Mermaid flowchart (from, to, relation): nodes are named by a digest, with what would end a label written as entities; nulls are empty."""

    def label(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for bad, good in (("#", "#35;"), ('"', "#quot;"), ("|", "#124;"), ("\n", " ")):
            text = F.replace(text, F.lit(bad), F.lit(good))
        return text

    def node(c: str) -> Column:
        return F.concat(F.lit("n"), F.substring(F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"), 256), 1, 12), F.lit('["'), label(c), F.lit('"]'))

    return edges.select(F.concat(node("from"), F.lit(' -->|"'), label("relation"), F.lit('"| '), node("to")).alias("value"))
