"""Telemetry whose dialect each line tells by itself, read in one pass into the record of `telemetry`.

Lines of no known dialect, null and empty ones give no rows; a field that a line lacks is null; repeated lines are repeated records.  Other
columns of the input stay beside the record, which must not share their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .telemetry import FIELDS, _get, parse_time


def _has(v: Column, *paths: str) -> Column:
    out = F.lit(True)
    for p in paths:
        out = out & F.get_json_object(v, p).isNotNull()
    return F.startswith(F.ltrim(v), F.lit("{")) & out


def _part(v: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(v, pattern, i), F.lit(""))


def _name(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"\.\z", "")


def _cloudtrail(v: Column) -> dict[str, Column]:
    service = F.regexp_replace(_get(v, "$.eventSource"), r"\.amazonaws\.com\z", "")
    return {"time": parse_time(_get(v, "$.eventTime")), "kind": F.lit("cloud"), "cmdline": F.concat(service, F.lit(":"), _get(v, "$.eventName")), "user": _get(v, "$.userIdentity.arn", "$.userIdentity.principalId", "$.userIdentity.userName")}


def _gcp(v: Column) -> dict[str, Column]:
    return {"time": parse_time(_get(v, "$.timestamp", "$.receiveTimestamp")), "kind": F.lit("cloud"), "cmdline": _get(v, "$.protoPayload.methodName"), "user": _get(v, "$.protoPayload.authenticationInfo.principalEmail"), "file_path": _get(v, "$.protoPayload.resourceName")}


def _azure(v: Column) -> dict[str, Column]:
    return {"time": parse_time(_get(v, "$.eventTimestamp", "$.time")), "kind": F.lit("cloud"), "cmdline": _get(v, "$.operationName.value", "$.operationName"), "user": _get(v, "$.caller", "$.identity.claims.name"), "file_path": _get(v, "$.resourceId")}


def _zeek(kind: str, host: str) -> Callable[[Column], dict[str, Column]]:
    return lambda v: {"time": parse_time(_get(v, "$.ts")), "kind": F.lit(kind), "dest_host": _name(_get(v, f"$.{host}")), "dest_ip": _get(v, "$['id.resp_h']"), "cmdline": _get(v, "$.method") if host == "host" else F.lit(None), "file_path": _get(v, "$.uri") if host == "host" else F.lit(None)}


def _podman(v: Column) -> dict[str, Column]:
    return {"time": F.coalesce(parse_time(_get(v, "$.Time")), parse_time(_get(v, "$.timeNano"))), "kind": F.lit("container"), "exe": _get(v, "$.Image"), "cmdline": F.concat(F.lit("podman "), _get(v, "$.Status"))}


def _github(v: Column) -> dict[str, Column]:
    return {"time": parse_time(_get(v, "$['@timestamp']", "$.created_at")), "kind": F.lit("cloud"), "cmdline": _get(v, "$.action"), "user": _get(v, "$.actor"), "file_path": _get(v, "$.repo", "$.org")}


def _gitlab(v: Column) -> dict[str, Column]:
    return {"time": parse_time(_get(v, "$.created_at")), "kind": F.lit("cloud"), "cmdline": _get(v, "$.event_name", "$.details.custom_message", "$.details.add", "$.details.remove", "$.details.change"), "user": _get(v, "$.details.author_name"), "file_path": _get(v, "$.details.entity_path", "$.details.target_details")}


_BIND = r"^(?:(\d{2}-\w{3}-\d{4} [\d:]{8})\S* )?.*client (?:@\S+ )?([0-9a-fA-F.:]+)#\d+.*: query: (\S+) IN (\w+)"
_DNSMASQ = r"dnsmasq\[\d+\]: query\[(\w+)\] (\S+) from (\S+)"
_UNBOUND = r"unbound.*info: ([0-9a-fA-F.:]+) (\S+) (\w+) IN"
_S3 = r"^\S+ (\S+) \[([^\]]+)\] (\S+) (\S+) \S+ ([A-Z]+\.[A-Z.]+\S*) (\S+) "

#: Dialect: how a line tells it, and what it holds.  The first that fits is taken.
DIALECTS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], dict[str, Column]]]] = {
    "cloudtrail": (lambda v: _has(v, "$.eventSource", "$.eventName"), _cloudtrail),
    "gcp": (lambda v: _has(v, "$.protoPayload"), _gcp),
    "azure": (lambda v: _has(v, "$.operationName"), _azure),
    "zeek-dns": (lambda v: _has(v, "$.ts", "$.query"), _zeek("dns", "query")),
    "zeek-http": (lambda v: _has(v, "$.ts", "$.method"), _zeek("network", "host")),
    "zeek-ssl": (lambda v: _has(v, "$.ts", "$.server_name"), _zeek("network", "server_name")),
    "podman": (lambda v: _has(v, "$.Status") & (F.lower(_get(v, "$.Type")) == "container") & (_get(v, "$.Status") != "health_status"), _podman),
    "github": (lambda v: _has(v, "$.action", "$.actor"), _github),
    "gitlab": (lambda v: _has(v, "$.details", "$.created_at"), _gitlab),
    "bind": (lambda v: v.rlike(_BIND), lambda v: {"time": F.try_to_timestamp(_part(v, _BIND, 1), F.lit("dd-MMM-yyyy HH:mm:ss")), "kind": F.lit("dns"), "dest_host": _name(_part(v, _BIND, 3)), "cmdline": _part(v, _BIND, 4)}),
    "dnsmasq": (lambda v: v.rlike(_DNSMASQ), lambda v: {"kind": F.lit("dns"), "dest_host": _name(_part(v, _DNSMASQ, 2)), "cmdline": _part(v, _DNSMASQ, 1)}),
    "unbound": (lambda v: v.rlike(_UNBOUND), lambda v: {"kind": F.lit("dns"), "dest_host": _name(_part(v, _UNBOUND, 2)), "cmdline": _part(v, _UNBOUND, 3)}),
    "s3": (lambda v: v.rlike(_S3), lambda v: {"time": F.try_to_timestamp(_part(v, _S3, 2), F.lit("dd/MMM/yyyy:HH:mm:ss Z")), "kind": F.lit("cloud"), "cmdline": _part(v, _S3, 5), "user": F.nullif(_part(v, _S3, 4), F.lit("-")), "file_path": F.concat_ws("/", _part(v, _S3, 1), F.nullif(_part(v, _S3, 6), F.lit("-")))}),
}


def by_line(lines: DataFrame, value: str = "value") -> DataFrame:
    """The records of lines that may be of different dialects."""

    def of(v: Column, name: str, fields: Callable[[Column], dict[str, Column]]) -> Column:
        held = fields(v)
        return F.struct(*(held.get(n, F.lit(None)).cast(k).alias(n) for n, k in FIELDS.items()), F.lit(name).alias("source"))

    def read_line(v: Column) -> Column:
        return F.coalesce(*(F.when(test(v), of(v, name, fields)) for name, (test, fields) in DIALECTS.items()))

    # In a lambda the line is read once, and only as the dialect that it is; outside, each field would repeat all of it.
    found = F.filter(F.transform(F.array(value), read_line), lambda r: r.isNotNull())
    return lines.select(*(F.col(f"`{c}`") for c in lines.columns if c != value), F.inline(found))


def read(spark: SparkSession, path: str) -> DataFrame:
    return by_line(spark.read.text(path))
