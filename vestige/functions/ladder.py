"""How well a telemetry record explains a tool call, as points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import executable, squeeze, token_overlap

#: Points of an equal command, a wrapped one, a truncated one, the same program, and an equal file or destination; the share of
#: words that the same program must have, and the length that truncated telemetry must have.
EQUAL, WRAPPED, TRUNCATED, PROGRAM, NAMED, SHARE, SHORT = 100, 90, 70, 60, 80, 0.6, 8


def process_points(command: Column, cmdline: Column) -> Column:
    """Points of a process record for a command: equal but for white space, the command inside the line, a line cut short inside the command,
    or the same program with enough of the same words, for the command or one part of a compound one.  Null or empty: 0."""
    a, b = squeeze(command), squeeze(cmdline)

    def alike(part: Column) -> Column:
        return (executable(F.get(F.split(part, " "), F.lit(0))) == executable(F.get(F.split(b, " "), F.lit(0)))) & (token_overlap(F.split(part, " "), F.split(b, " ")) >= SHARE)

    parts = F.filter(F.transform(F.split(a, r" ?(?:&&|\|\||;|\|) ?"), F.trim), lambda p: p != "")
    ladder = F.when(a == b, EQUAL).when(F.contains(b, a), WRAPPED).when(F.contains(a, b) & (F.length(b) > SHORT), TRUNCATED).when(alike(a) | F.exists(parts, alike), PROGRAM).otherwise(0)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0).otherwise(ladder)


def file_points(named: Column, path: Column) -> Column:
    """Points of a file record: the same path, or one ends with the other behind a slash, in any case and with either slash.  Null or empty: 0."""
    a, b = (F.translate(F.lower(c), "\\", "/") for c in (named, path))
    plain = lambda c: F.regexp_replace(c, "^/", "")
    same = (a == b) | F.endswith(b, F.concat(F.lit("/"), plain(a))) | F.endswith(a, F.concat(F.lit("/"), plain(b)))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0).when(same, NAMED).otherwise(0)


def network_points(host: Column, address: Column, name: Column) -> Column:
    """Points of a network record: the wanted host is its address, its name or a domain above its name.  Null or empty: 0."""
    want, named = F.lower(host), F.lower(F.coalesce(name, F.lit("")))
    same = (want == F.lower(F.coalesce(address, F.lit("")))) | ((named != "") & ((want == named) | F.endswith(named, F.concat(F.lit("."), want))))
    return F.when(F.coalesce(want, F.lit("")) == "", 0).when(same, NAMED).otherwise(0)


#: From how many points on a pair of a kind rests on what, and with what confidence.
BASES = {
    "process": ((100, "same command line", "HIGH"), (90, "same command inside a shell wrapper", "HIGH"), (70, "command matches a truncated telemetry copy", "MEDIUM"), (1, "same program with most arguments shared", "LOW")),
    "file": ((1, "same file path", "MEDIUM"),),
    "network": ((1, "same destination", "MEDIUM"),),
    "cloud": ((95, "same cloud operation on the named resource", "HIGH"), (75, "same cloud operation; the command named no resource", "MEDIUM"), (1, "same cloud operation; the record names no resource", "LOW")),
}


def basis(kind: Column, points: Column) -> Column:
    """(basis, confidence) of a pair's kind and points, as a struct; null for other kinds and for no points."""
    steps = [((kind == k) & (points >= least), F.struct(F.lit(text).alias("basis"), F.lit(sure).alias("confidence"))) for k, rows in BASES.items() for least, text, sure in rows]
    out = F.when(*steps[0])
    for when, value in steps[1:]:
        out = out.when(when, value)
    return out
