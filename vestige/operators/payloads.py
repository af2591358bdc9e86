"""Payloads hidden in texts by layers of encoding and compression."""

from __future__ import annotations

import base64
import binascii
import bz2
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .graphs import cut

#: Layers followed; the longest encoded run that is decoded; the most bytes that one decompression may give, and the ratio that makes a bomb of it.
LAYERS, MOST_ENCODED, MOST_BYTES, BOMB = 4, 1 << 20, 4 << 20, 100
#: Least lengths of runs that may be hex, base64 and base32.
HEX, BASE64, BASE32 = 32, 24, 32
#: Characters that are not printable.
CONTROLS = [chr(c) for c in (*range(32), 127) if chr(c) not in "\n\r\t"]
_COLUMNS = ["chain", "outcome", "payload"]


def candidates(text: Column) -> Column:
    """Runs of a text that may be encoded; a line's end between two characters of such a run is no end of it, and a part of a longer run is no run."""
    joined = F.regexp_replace(F.replace(text, F.lit("\\\n"), F.lit("")), r"(?<=[A-Za-z0-9+/=])(?:\r?\n|\r)(?=[A-Za-z0-9+/=])", "")
    patterns = (rf"(?:\\x[0-9a-fA-F]{{2}}){{{HEX // 2},}}+", rf"(?<![A-Za-z0-9+/])(?:[0-9a-fA-F]{{2}}){{{HEX // 2},}}+(?![A-Za-z0-9+/=])", rf"[A-Za-z0-9+/_-]{{{BASE64},}}+={{0,2}}", rf"(?<![A-Za-z0-9+/_-])[A-Za-z2-7]{{{BASE32},}}+={{0,6}}(?![A-Za-z0-9+/_=-])")
    found = lambda t: F.array_distinct(F.concat(*(F.regexp_extract_all(t, F.lit(p), 0) for p in patterns)))
    # The joined text is made once; the lambda holds it.
    return F.get(F.transform(F.array(joined), found), F.lit(0))


def _decoded(run: str) -> list[tuple[str, bytes]]:
    """What a run may be, as hex first: its digits are base64 too."""
    out, plain = [], run.replace("\\x", "")
    if len(plain) >= HEX and len(plain) % 2 == 0:
        try:
            return [("hex", binascii.unhexlify(plain))]
        except (binascii.Error, ValueError):
            pass
    bare = run.rstrip("=")
    worded = run.islower() and run.isalpha()  # a long word
    if len(run) >= BASE64 and not worded and len(bare) % 4 != 1:
        try:
            out.append(("base64", base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4), validate=True)))
        except (binascii.Error, ValueError):
            pass
    if len(run) >= BASE32 and not worded:
        try:
            out.append(("base32", base64.b32decode(bare.upper() + "=" * (-len(bare) % 8))))
        except (binascii.Error, ValueError):
            pass
    return out


def _inflated(raw: bytes) -> tuple[list[str], bytes, str]:
    """(compressions, bytes, outcome) of what lies below up to LAYERS compressions; outcome is "" unless one is broken or a bomb."""
    names: list[str] = []
    for _ in range(LAYERS):
        if raw[:2] == b"\x1f\x8b":
            name, machine = "gzip", zlib.decompressobj(31)
        elif raw[:1] == b"\x78" and raw[1:2] in (b"\x01", b"\x5e", b"\x9c", b"\xda"):
            name, machine = "zlib", zlib.decompressobj()
        elif raw[:3] == b"BZh":
            name, machine = "bzip2", bz2.BZ2Decompressor()
        else:
            break
        try:
            out = machine.decompress(raw, MOST_BYTES)
        except (zlib.error, OSError, ValueError):
            return names, raw, "broken"
        if len(out) >= MOST_BYTES:
            return names, b"", "bomb" if len(out) > BOMB * len(raw) else "long"
        if not out:
            return names, raw, "broken"
        names.append(name)
        raw = out
    return names, raw, ""


def _text(raw: bytes) -> tuple[str | None, str | None]:
    """(text, its layer's name) of readable bytes: UTF-8, or UTF-16LE, with 85 of 100 characters printable and 8 bytes at least."""
    low, high = raw[0::2], raw[1::2]
    wide = len(raw) >= 16 and len(raw) % 2 == 0 and high.count(0) * 10 >= len(high) * 6 and low.count(0) * 10 < len(low)
    try:
        text = raw.decode("utf-16-le" if wide else "utf-8")
    except UnicodeDecodeError:
        return None, None
    printable = len(text) - sum(map(text.count, CONTROLS))
    return (text, "utf16le" if wide else None) if len(raw) >= 8 and printable * 100 >= len(text) * 85 and text.strip() else (None, None)


def read_run(run: str) -> tuple[str, str, str | None]:
    """(chain of layers, outcome, text) of an encoded run: outcome is text, binary, broken, bomb or long."""
    if len(run) > MOST_ENCODED:
        return "", "long", None
    worst = ("", "none", None)
    for name, raw in _decoded(run):
        names, below, outcome = _inflated(raw)
        text, wide = (None, None) if outcome else _text(below)
        chain = ">".join([name, *names, *([wide] if wide else [])])
        if text is not None:
            return chain, "text", text
        if worst[1] in ("none", "binary"):
            worst = (chain, outcome or "binary", None)
    return worst


def payloads(rows: DataFrame, key: str, text: str, layers: int = LAYERS) -> DataFrame:
    """What the encoded runs of texts hold: key, depth (from 1), chain (the layers of that depth), outcome, payload (null unless readable), within (SHA-256 of the
    text that held it; null at depth 1).

    Each round takes the candidates of all texts that the last one found, decodes them in Arrow batches and is written, so a chain of layers costs as
    many short passes.  outcome: text, binary, broken (a stream that fails, or ends without output; what a cut one gives is read), bomb, or long (beyond the bounds above).  A payload
    that one text holds twice is given once.  Null and empty texts hold nothing; an empty table has no rows; rows with one key share it.
    """

    def decode(batches):
        for b in batches:
            found = [read_run(r) for r in b.column("run").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("within"), *(pa.array([f[i] for f in found], pa.string()) for i in range(3))], names=["key", "within", *_COLUMNS])

    kind = dict(rows.dtypes)[key]
    front, out = rows.select(F.col(key).alias("key"), F.lit(None).cast("string").alias("within"), F.col(text).cast("string").alias("text")), None
    for depth in range(1, layers + 1):
        runs = front.select("key", "within", F.explode(candidates(F.col("text"))).alias("run"))
        found = runs.mapInArrow(decode, f"key {kind}, within string, chain string, outcome string, payload string").where("outcome <> 'none'")
        found = cut(found.groupBy("key", "within", "outcome", "payload").agg(F.min("chain").alias("chain")).withColumn("depth", F.lit(depth)))
        out = found if out is None else out.unionByName(found)
        front = found.where("outcome = 'text'").select("key", F.sha2(F.col("payload").cast("binary"), 256).alias("within"), F.col("payload").alias("text"))
        if front.isEmpty():
            break
    return out.select(F.col("key").alias(key), "depth", "chain", "outcome", "payload", "within")


def powershell(command: Column) -> Column:
    """What -EncodedCommand hands to a PowerShell: base64 of UTF-16LE; null where there is none or it can't be decoded."""
    run = F.regexp_extract(command, r"(?i)\s[-/](?:e|ec|en|enc|enco|encod|encode|encoded|encodedc|encodedco|encodedcom|encodedcomm|encodedcomma|encodedcomman|encodedcommand)\s+[\"']?([A-Za-z0-9+/]{4,}={0,2})", 1)
    raw = F.try_to_binary(run, F.lit("base64"))
    return F.when((run != "") & F.rlike(command, F.lit(r"(?i)\b(?:powershell|pwsh)(?:\.exe)?\b")) & (F.octet_length(raw) % 2 == 0), F.decode(raw, "UTF-16LE"))
