"""Messages carved out of damaged files: JSON objects of a message's shape, wherever they stand in the bytes."""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of a piece that one row holds; the longest object that is looked for, and so how far a piece reads beyond its end.
PIECE, LONGEST = 4 << 20, 256 << 10
SCHEMA = "path string, start long, stop long, role string, text string"
_OPENS = re.compile(rb'\{\s*"')
_MARKS = re.compile(rb'[{}"]|\\.', re.S)
#: Names of the side that speaks, and of what it says.
_SIDES, _SAID = ("role", "sender", "author"), ("content", "text", "parts", "message")


def _end(raw: bytes, start: int, most: int) -> int | None:
    """Behind the bracket that closes the object at start, by counting brackets outside strings; None if there is none within most bytes."""
    depth, quoted = 0, False
    for m in _MARKS.finditer(raw, start, min(len(raw), start + most)):
        mark = raw[m.start()]
        if mark == 0x22:
            quoted = not quoted
        elif not quoted and mark == 0x7B:
            depth += 1
        elif not quoted and mark == 0x7D:
            depth -= 1
            if depth == 0:
                return m.end()
    return None


def _text(value) -> str | None:
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        return next((t for t in (_text(value.get(k)) for k in _SAID) if t is not None), None)
    if isinstance(value, list):
        parts = [t for t in map(_text, value) if t is not None]
        return "\n".join(parts) if parts else None
    return None


def message(raw: bytes) -> tuple[str, str] | None:
    """(role, text) of an object of a message's shape: a side that speaks and what it says; None for any other."""
    try:
        doc = json.loads(raw.decode("utf-8"))
    except (ValueError, RecursionError):
        return None
    if not isinstance(doc, dict):
        return None
    side = next((doc[k] for k in _SIDES if k in doc), None)
    side = side.get("role") if isinstance(side, dict) else side
    said = next((t for t in (_text(doc.get(k)) for k in _SAID) if t is not None), None)
    return (side, said) if isinstance(side, str) and side and said is not None else None


def objects(raw: bytes, own: int, most: int = LONGEST) -> list[tuple[int, int, str, str]]:
    """(start, stop, role, text) of every message that begins in the first own bytes, those inside others too."""
    out = []
    for m in _OPENS.finditer(raw):
        if m.start() >= own:
            break
        stop = _end(raw, m.start(), most)
        if stop is not None and (found := message(raw[m.start() : stop])) is not None:
            out.append((m.start(), stop, *found))
    return out


def carve(files: DataFrame, piece: int = PIECE, most: int = LONGEST) -> DataFrame:
    """The messages in files (path, content: bytes) as SCHEMA, each once: from a file's start, the first that begins, then the first behind its end, and so on.

    A file is cut into pieces that reach most bytes into the next one, dealt out to tasks; a piece gives all messages that begin in it, inside others or
    not, so what is found does not hang on the cuts, and an object across a cut is found by the piece that it begins in.  Which of them count is then
    chosen by places alone, file by file.  An object longer than most bytes is not found, but those inside it are.  Null and empty
    files hold none; text that is no UTF-8 in an object rules it out alone.
    """
    cut = files.where(F.octet_length("content") > 0).select("path", "content", F.explode(F.sequence(F.lit(0), F.octet_length("content") - 1, F.lit(piece))).alias("base"))
    pieces = cut.select("path", F.col("base").cast("long").alias("base"), F.substring("content", F.col("base") + 1, F.lit(piece + most)).alias("bytes")).repartition("path", "base")

    def read(batches):
        for b in batches:
            rows = [(p, base + s, base + e, role, text) for p, base, raw in zip(*(b.column(c).to_pylist() for c in ("path", "base", "bytes"))) for s, e, role, text in objects(raw, piece, most)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["path", "start", "stop", "role", "text"])

    found = pieces.mapInArrow(read, SCHEMA)

    def outer(rows: pd.DataFrame) -> pd.DataFrame:
        kept, behind = [], -1
        for r in rows.sort_values("start").itertuples(index=False):
            if r.start >= behind:
                kept.append((r.path, r.start))
                behind = r.stop
        return pd.DataFrame(kept, columns=["path", "start"])

    chosen = found.select("path", "start", "stop").groupBy("path").applyInPandas(outer, "path string, start long")
    return found.join(chosen, ["path", "start"]).select("path", "start", "stop", "role", "text")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The messages in the files of a folder; a file is read whole, so none may be over the 2 GB that a binary value holds."""
    return carve(spark.read.format("binaryFile").load(path).select("path", "content"))
