"""Readers of telemetry dialects into one record: time, kind, exe, cmdline, pid, user, dest_host, dest_ip, file_path, source."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import epoch_time, url_host

FIELDS = {"time": "timestamp", "kind": "string", "exe": "string", "cmdline": "string", "pid": "long", "user": "string", "dest_host": "string", "dest_ip": "string", "file_path": "string"}
#: Names under which generic records hold a field.
ALIASES = {"time": ("time", "timestamp", "ts", "@timestamp"), "exe": ("exe", "image", "process", "binary"), "cmdline": ("cmdline", "command_line", "command"), "pid": ("pid", "process_id"), "user": ("user", "username"), "dest_host": ("dest_host", "host", "domain", "query"), "dest_ip": ("dest_ip", "ip", "dst_ip"), "file_path": ("file_path", "path", "file"), "kind": ("kind", "event_type", "type")}


def parse_time(text: Column) -> Column:
    """Common layouts, or seconds to nanoseconds since 1970."""
    number = text.try_cast("double")
    scaled = F.when(number < 100_000_000_000, (number * 1_000_000).cast("long")).otherwise(number.cast("long"))
    return F.coalesce(F.try_to_timestamp(text), F.when(number < 100_000_000_000, F.timestamp_micros(scaled)).otherwise(epoch_time(scaled)))


def record(df: DataFrame, source: str, **fields: Column) -> DataFrame:
    return df.select(*(fields.get(n, F.lit(None)).cast(k).alias(n) for n, k in FIELDS.items()), F.lit(source).alias("source"))


def _get(doc: Column, *paths: str) -> Column:
    return F.coalesce(*(F.get_json_object(doc, p) for p in paths))


def _generic(get) -> dict[str, Column]:
    found = {n: F.coalesce(*(get(a) for a in names)) for n, names in ALIASES.items()}
    return found | {"time": parse_time(found["time"]), "pid": found["pid"].try_cast("long")}


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    return record(spark.read.text(path).where("value like '{%'"), "jsonl", **_generic(lambda a: F.get_json_object("value", f"$['{a}']")))


def csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    names = {c.lower(): c for c in raw.columns}
    return record(raw, "csv", **_generic(lambda a: F.col(f"`{names[a]}`") if a in names else F.lit(None).cast("string")))


def falco(spark: SparkSession, path: str) -> DataFrame:
    v = F.col("value")
    return record(spark.read.text(path), "falco", time=parse_time(_get(v, "$.time")), kind=F.lit("process"), exe=_get(v, "$.output_fields['proc.exepath']", "$.output_fields['proc.name']"), cmdline=_get(v, "$.output_fields['proc.cmdline']"), pid=_get(v, "$.output_fields['proc.pid']").try_cast("long"), user=_get(v, "$.output_fields['user.name']"), file_path=_get(v, "$.output_fields['fd.name']"))


def tetragon(spark: SparkSession, path: str) -> DataFrame:
    v, kinds = F.col("value"), ("process_exec", "process_exit", "process_kprobe")
    p = lambda name: _get(v, *(f"$.{k}.process.{name}" for k in kinds))
    kind = F.when(_get(v, "$.process_exec").isNotNull(), "process").when(_get(v, "$.process_exit").isNotNull(), "exit").otherwise("file")
    return record(spark.read.text(path), "tetragon", time=parse_time(_get(v, "$.time")), kind=kind, exe=p("binary"), cmdline=F.concat_ws(" ", p("binary"), p("arguments")), pid=p("pid").try_cast("long"), user=p("uid"))


def docker(spark: SparkSession, path: str) -> DataFrame:
    v = F.col("value")
    return record(spark.read.text(path), "docker", time=epoch_time(_get(v, "$.timeNano", "$.time").cast("long")), kind=F.lit("container"), exe=_get(v, "$.from", "$.Actor.Attributes.image"), cmdline=_get(v, "$.status", "$.Action"))


def kubernetes(spark: SparkSession, path: str) -> DataFrame:
    v = F.col("value")
    return record(spark.read.text(path), "kubernetes", time=parse_time(_get(v, "$.requestReceivedTimestamp", "$.stageTimestamp")), kind=F.lit("cloud"), cmdline=F.concat_ws(" ", _get(v, "$.verb"), _get(v, "$.objectRef.resource"), _get(v, "$.objectRef.name")), user=_get(v, "$.user.username"))


def squid(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    url = F.get(f, F.lit(6))
    return record(spark.read.text(path), "squid", time=parse_time(F.get(f, F.lit(0))), kind=F.lit("network"), user=F.nullif(F.get(f, F.lit(7)), F.lit("-")), dest_host=F.coalesce(url_host(url), F.regexp_extract(url, r"^([^:/]+):\d+\z", 1)))


def auth_log(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """Lines of an authentication log, whose times have no year: the given one, else the latest that is not behind the file's own time by more than a day."""
    line = r"^(\w{3}\s+\d+ [\d:]{8}) \S+ ([\w-]+)(?:\[(\d+)\])?: (.*)"
    g = lambda i: F.regexp_extract("value", line, i)
    at = lambda y: F.try_to_timestamp(F.concat(y.cast("string"), F.lit(" "), F.regexp_replace(g(1), r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    rows = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("written")).where(F.col("value").rlike(line))
    latest = at(F.year("written"))
    when = at(F.lit(year)) if year else F.when(latest > F.col("written") + F.expr("interval 1 day"), at(F.year("written") - 1)).otherwise(latest)
    return record(rows, "auth", time=when, kind=F.lit("auth"), exe=g(2), pid=g(3).try_cast("long"), user=F.nullif(F.regexp_extract(g(4), r"(?:for (?:invalid user )?|user=)(\w+)", 1), F.lit("")), dest_ip=F.nullif(F.regexp_extract(g(4), r"from ([0-9a-fA-F.:]+)", 1), F.lit("")), cmdline=F.nullif(F.regexp_extract(g(4), r"COMMAND=(.*)", 1), F.lit("")))


def auditd(spark: SparkSession, path: str) -> DataFrame:
    """Records of one serial number are one event: the joined fields of its lines."""
    g = lambda p: F.max(F.nullif(F.regexp_extract("value", p, 1), F.lit("")))
    serial = F.regexp_extract("value", r"msg=audit\([\d.]+:(\d+)\)", 1)
    arguments = F.regexp_replace(F.max(F.when(F.col("value").contains("type=EXECVE"), F.array_join(F.regexp_extract_all("value", F.lit(r'\ba\d+="([^"]*)"'), 1), " "))), r"\s+\z", "")
    rows = spark.read.text(path).withColumn("serial", serial).where("serial <> ''").groupBy("serial").agg(g(r"msg=audit\(([\d.]+):").alias("t"), g(r'\bexe="([^"]*)"').alias("x"), g(r"\bpid=(\d+)").alias("p"), g(r"\bauid=(\d+)").alias("u"), g(r'type=PATH.*\bname="([^"]*)"').alias("f"), arguments.alias("c"))
    return record(rows, "auditd", time=parse_time(F.col("t")), kind=F.when(F.col("c").isNotNull(), "process").otherwise("file"), exe=F.col("x"), cmdline=F.col("c"), pid=F.col("p").cast("long"), user=F.col("u"), file_path=F.col("f"))


READERS = {"jsonl": jsonl, "csv": csv, "falco": falco, "tetragon": tetragon, "docker": docker, "kubernetes": kubernetes, "squid": squid, "auditd": auditd, "auth": auth_log}


def sniff(sample: str) -> str:
    """The dialect of a file's first line."""
    if "type=" in sample and "msg=audit(" in sample:
        return "auditd"
    if sample.startswith("{"):
        for key, name in (("output_fields", "falco"), ("process_exec", "tetragon"), ("process_exit", "tetragon"), ("process_kprobe", "tetragon"), ("timeNano", "docker"), ("objectRef", "kubernetes")):
            if f'"{key}"' in sample:
                return name
        return "jsonl"
    if re.match(r"[A-Z][a-z]{2}\s+\d+ [\d:]{8} \S+ [\w-]+(?:\[\d+\])?: ", sample):
        return "auth"
    return "squid" if sample[:10].isdigit() and "." in sample[:12] else "csv"


def load(spark: SparkSession, path: str) -> DataFrame:
    """The records of a file in whichever dialect it is."""
    head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    return READERS[sniff(head[0].value if head else "")](spark, path)
