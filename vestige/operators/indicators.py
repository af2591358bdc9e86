"""Indicators of known incidents against texts, hosts and packages."""

from __future__ import annotations

import json
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import host_of, refang, version

#: Labels joined by dots.
NAME = r"[a-z0-9_-]+(?:\.[a-z0-9_-]+)+"
_NAME, _DOT, _INSIDE = re.compile(NAME), re.compile(r"\.[a-z0-9_-]"), frozenset("abcdefghijklmnopqrstuvwxyz0123456789_-")
#: Bytes of values that one automaton holds; more values are more passes over the texts, which send hits alone.
BLOCK_BYTES = 8 << 20
#: Kinds, and the least length of a value that is searched for in texts.
LEAST = {"domain": 1, "url": 8, "path": 6, "repo": 6, "string": 8, "package": 1, "sha256": 64}
#: The object paths of STIX patterns and the attribute types of MISP events that give a kind.
STIX = {"domain-name:value": "domain", "url:value": "url", "ipv4-addr:value": "domain", "ipv6-addr:value": "domain", "file:hashes.'SHA-256'": "sha256", "file:name": "path"}
MISP = {"domain": "domain", "hostname": "domain", "ip-dst": "domain", "ip-src": "domain", "url": "url", "sha256": "sha256", "filename": "path"}
_FOUND = "incident string, kind string, value string, low string, below string, exact array<string>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """Indicators of files that are incident packs, STIX bundles or MISP events: incident, kind, value, low, below, exact (versions of a package).

    Each file is read whole by one task.  A file that is no JSON or none of these gives no rows; so does an indicator of another kind.
    """

    def read(batches):
        for b in batches:
            rows = []
            for text in b.column("value").to_pylist():
                try:
                    doc = json.loads(text)
                except ValueError:
                    continue
                rows += _pack(doc) if isinstance(doc, dict) else []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)] + [pa.array([r[5] for r in rows], pa.list_(pa.string()))], names=["incident", "kind", "value", "low", "below", "exact"])

    return usable(spark.read.text(path, wholetext=True).mapInArrow(read, _FOUND))


def _pack(doc: dict) -> list[tuple]:
    rows = []
    for i in doc.get("incidents") or []:
        rows += [(i.get("id"), x.get("kind"), x.get("value"), x.get("low"), x.get("below"), x.get("versions")) for x in i.get("indicators") or [] if isinstance(x, dict)]
    if doc.get("type") == "bundle":
        for o in doc.get("objects") or []:
            if o.get("type") == "indicator":
                rows += [(o.get("id"), STIX.get(p.strip()), v, None, None, None) for p, v in re.findall(r"([a-z0-9-]+:[\w.'-]+)\s*=\s*'((?:[^'\\]|\\.)*)'", o.get("pattern") or "")]
    for e in [doc.get("Event"), *[r.get("Event") for r in doc.get("response") or [] if isinstance(r, dict)]]:
        for a in (e or {}).get("Attribute") or []:
            rows.append((e.get("uuid") or str(e.get("id")), MISP.get(a.get("type")), a.get("value"), None, None, None))
    return [r for r in rows if isinstance(r[1], str) and isinstance(r[2], str)]


def usable(indicators: DataFrame) -> DataFrame:
    """Indicators as they are matched, each once: refanged, lower case but for paths and strings, hosts without a dot at their end, addresses without a
    scheme.  Those of no known kind, and values too short to match safely, go; so does a domain without a dot or colon."""
    kind, value = F.lower(F.trim("kind")), F.trim(refang(F.col("value")))
    low = F.when(kind == "domain", F.regexp_replace(F.lower(value), r"\.\z", "")).when(kind == "url", F.regexp_replace(F.lower(value), "^https?://", "")).when(kind.isin("package", "sha256"), F.lower(value)).otherwise(value)
    least = F.create_map(*(x for k, n in LEAST.items() for x in (F.lit(k), F.lit(n))))
    rows = indicators.withColumn("kind", kind).withColumn("value", low).where(F.length("value") >= least[F.col("kind")])
    return rows.where((F.col("kind") != "domain") | F.rlike("value", F.lit("[.:]"))).where((F.col("kind") != "sha256") | (F.length("value") == 64)).distinct()


def _bounded(text: str, start: int, stop: int) -> bool:
    """Whether text[start:stop] stands as a whole host name or the end of one; a dot behind it may only end a sentence."""
    inside = lambda c: "a" <= c <= "z" or "0" <= c <= "9" or c in "_-"
    before, after, beyond = text[start - 1 : start], text[stop : stop + 1], text[stop + 1 : stop + 2]
    return not (before and inside(before)) and not (after and inside(after)) and not (after == "." and beyond and inside(beyond))


def _lower(text: str) -> str:
    """A text in lower case, of as many characters."""
    return text.lower() if text.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _names(low: str):
    """(place, name) of the dotted names of a text in lower case: labels as far as they go, joined by single dots."""
    stop = 0
    for dot in _DOT.finditer(low):
        start = dot.start()
        if start < stop:
            continue
        while start > 0 and low[start - 1] in _INSIDE:
            start -= 1
        if start < dot.start():
            name = _NAME.match(low, start)
            stop = name.end()
            yield start, name.group()


def in_texts(rows: DataFrame, keys: list[str], text: str, indicators: DataFrame) -> DataFrame:
    """Which indicators (of usable()) stand in which texts: the keys, kind, value, first_at (code points), n (places).

    Domains of plain labels are looked up by equality: a text's dotted names, and what they end with, are joined with them, so a text is read once
    however many there are.  All other values of a block are searched for at once by an automaton with failure links; a text is read once for
    each block.  Case does not matter; a domain must stand as a whole name or the end of one.  Null texts hold nothing; repeated rows each have
    their hits; an empty list finds none.
    """
    values = indicators.where(F.col("kind").isin("domain", "url", "path", "repo", "string")).groupBy("kind", F.lower("value").alias("low")).agg(F.min("value").alias("value"))
    plain = (F.col("kind") == "domain") & F.rlike("low", F.lit(rf"^{NAME}\z"))
    source = rows.select(*keys, F.col(text).cast("string").alias("__text")).where("__text is not null")
    schema = ", ".join(f"`{c}` {t}" for c, t in source.select(*keys).dtypes)

    own = values.where(plain).select(F.col("low").alias("__low"), F.col("kind").alias("__kind"), F.col("value").alias("__value"))
    rest = values.where(~plain)
    size = rest.agg(F.sum(F.octet_length("low"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    sc, out = rows.sparkSession.sparkContext, None
    for block in range(blocks):
        listed = rest.where(F.pmod(F.xxhash64("kind", "low"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        shared = sc.broadcast([(r.low, r.kind, r.value) for r in listed])

        def search(batches, shared=shared, named=block == 0):
            machine = ahocorasick.Automaton()
            for low, kind, value in shared.value:
                machine.add_word(low, [*machine.get(low, []), (len(low), kind, value)])
            if shared.value:
                machine.make_automaton()
            for b in batches:
                place, hits = [], []
                for i, text in enumerate(b.column("__text").to_pylist()):
                    low, found = _lower(text), {}
                    for end, ends_here in machine.iter(low) if shared.value else ():
                        for n, kind, value in ends_here:
                            if kind != "domain" or _bounded(low, end - n + 1, end + 1):
                                first, count = found.get((value, kind, value), (end - n + 1, 0))
                                found[value, kind, value] = first, count + 1
                    for start, name in _names(low) if named else ():
                        at = 0
                        while "." in name[at:]:
                            first, count = found.get((name[at:], None, None), (start + at, 0))
                            found[name[at:], None, None] = first, count + 1
                            at = name.find(".", at) + 1
                    place += [i] * len(found)
                    hits += [(*k, *v) for k, v in found.items()]
                some = pa.array(place, pa.int64())
                cols = [b.column(c).take(some) for c in range(len(keys))]
                cols += [pa.array([h[c] for h in hits], pa.string() if c < 3 else pa.int64()) for c in range(5)]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "__low", "kind", "value", "first_at", "n"])

        part = source.mapInArrow(search, schema + ", __low string, kind string, value string, first_at long, n long")
        out = part if out is None else out.unionByName(part)
    named = out.join(own, (F.col("kind").isNull()) & (out["__low"] == own["__low"]), "left")
    return named.select(*keys, F.coalesce("kind", "__kind").alias("kind"), F.coalesce("value", "__value").alias("value"), "first_at", "n").where("value is not null")


def suffixes(host: Column) -> Column:
    """A host and the domains above it."""
    labels = F.split(host_of(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def of_hosts(rows: DataFrame, host: str, indicators: DataFrame) -> DataFrame:
    """Rows whose host is an indicator's domain or under it: the rows' columns and value.

    Each different host is looked up once, by its own name and every domain above it, which are equality keys; then rows fetch their host's domains.
    """
    domains = indicators.where("kind = 'domain'").select("value").distinct()
    hosts = rows.where(F.col(host).isNotNull()).select(F.col(host).alias("__host")).distinct()
    known = hosts.withColumn("value", F.explode(F.array_distinct(suffixes(F.col("__host"))))).join(domains, "value")
    return rows.join(known, rows[host] == known["__host"]).drop("__host")


def of_packages(rows: DataFrame, name: str, at: str, indicators: DataFrame) -> DataFrame:
    """Rows of packages that an indicator names, at a version it covers: the rows' columns and value.

    An indicator with exact versions covers these, one with bounds what is at least low and under below, one with neither all; a row without a
    version is covered only by the last.
    """
    p = indicators.where("kind = 'package'").select(F.col("value").alias("__name"), F.col("low").alias("__low"), F.col("below").alias("__below"), F.col("exact").alias("__exact"))
    v, known = version(F.col(at)), F.col(at).isNotNull()
    listed = F.coalesce(F.size("__exact"), F.lit(0)) > 0
    bounded = (F.col("__low").isNull() | (v >= version(F.col("__low")))) & (F.col("__below").isNull() | (v < version(F.col("__below"))))
    covered = F.when(listed, known & F.array_contains("__exact", F.col(at))).when(F.col("__low").isNull() & F.col("__below").isNull(), F.lit(True)).otherwise(known & bounded)
    return rows.join(p, F.lower(F.col(name)) == F.col("__name")).where(covered).drop("__low", "__below", "__exact").withColumnRenamed("__name", "value").distinct()
