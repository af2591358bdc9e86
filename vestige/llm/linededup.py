"""Line deduplication by a segment-partition edit join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import columns, components, fresh, numbered, prepare, saved

#: Edits within which two lines are one class; normalised characters below which lines are compared for equality alone.
THRESHOLD, LEAST = 1, 8
#: Lines of a cell above which shared one-edit patterns replace pairs.
CROWD = 40
#: Bits of the filter that keeps most lines' texts from being shuffled (1 MB; more candidates only let more texts through).
FILTER_BITS = 1 << 23

_DIGITS = bytes(48 if 48 <= c <= 57 else c for c in range(256))


def normalise(text: str | None, fold: bool = False) -> list[str]:
    """The lines of a text: lower case, white-space runs as one space, with fold each digit as 0; blank lines are empty strings."""
    if not text:
        return []
    if fold:
        text = text.encode("utf-8", "surrogatepass").translate(_DIGITS).decode("utf-8", "surrogatepass")
    return [" ".join(line.split()) for line in text.lower().split("\n")]


def line_id(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def segments(n: int, threshold: int) -> list[tuple[int, int]]:
    """(start, size) of the threshold + 1 near-equal parts of n characters; the longer ones come last."""
    parts = threshold + 1
    size, longer = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        z = size + (i >= parts - longer)
        out.append((at, z))
        at += z
    return out


def _cell(length: int, part: int, piece: str) -> int:
    h = xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass"), length * 16 + part)
    return h - (1 << 64) if h >> 63 else h


def index_cells(line: str, threshold: int) -> list[int]:
    """The line's entries in the index of its length: one for each segment."""
    n = len(line)
    return [_cell(n, i, line[p : p + z]) for i, (p, z) in enumerate(segments(n, threshold))]


def probe_cells(line: str, threshold: int) -> list[int]:
    """Cells of lines of its length or up to threshold shorter that its substrings reach, its own segments aside.

    For part i at p, only starts that leave at most i edits on the left and the rest on the right can belong to a match.
    """
    n, out = len(line), set()
    for length in range(max(n - threshold, LEAST), n + 1):
        shift = n - length
        for i, (p, z) in enumerate(segments(length, threshold)):
            rest = threshold - i
            for at in range(max(0, p - i, p + shift - rest), min(n - z, p + i, p + shift + rest) + 1):
                if shift or at != p:
                    out.add(_cell(length, i, line[at : at + z]))
    return sorted(out)


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k: bit-parallel over a diagonal band of 2k + 1 cells, behind the shared ends."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > k:
        return False
    lead = 0
    while lead < len(b) and a[lead] == b[lead]:
        lead += 1
    a, b = a[lead:], b[lead:]
    while b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not b or k == 0:
        return len(a) <= k
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    n, m, width = len(a), len(b), 2 * k + 1
    full, top = (1 << width) - 1, 1 << (2 * k)
    # Bit r of column j is row j + r - k of a.  vp, vn: vertical differences; the score follows the lowest row of the band, then the last row.
    vp, vn, score = full ^ ((1 << k) - 1), 0, k
    for j in range(m):
        at = j - k
        eq = where.get(b[j], 0)
        eq = (eq >> at if at >= 0 else eq << -at) & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j + k < n:
            score += not d0 & top
        else:
            bit = 1 << (n - 1 - j + k)
            score += bool(hp & bit) - bool(hn & bit)
        moved = d0 >> 1
        vp = (hn | ~(moved | hp)) & full
        vn = moved & hp
    return score <= k


_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_BASES = (911382323, 972663749, 1000003013, 1361236361)


def patterns(line: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(at, x, y, role) of one-edit patterns, (x, y) a 124-bit hash.

    Role 0: the line with position at open (lines that share it differ there alone).  Role 1: the line without one character, and
    role 2: the line itself, both with at = -1 (a line shares its own with exactly those that have one character more).
    """
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(c)
    found = []
    for p, base in zip(map(np.uint64, _PRIMES), _BASES):
        power = np.ones(n, np.uint64)
        filled = 1
        while filled < n:  # powers by doubling
            step = min(filled, n - filled)
            power[filled : filled + step] = power[:step] * np.uint64(pow(base, filled, int(p))) % p
            filled += step
        total = np.concatenate([[np.uint64(0)], np.cumsum(c * power % p)]) % p
        before, behind = total[:-1], (total[-1] + p - total[1:]) % p
        opened = (before + behind) % p
        without = (before + behind * np.uint64(pow(base, -1, int(p))) % p) % p
        found.append(np.concatenate([opened, without, total[-1:]]))
    x, y = (found[0] << np.uint64(31) | found[1]).astype(np.int64), (found[2] << np.uint64(31) | found[3]).astype(np.int64)
    keep = np.concatenate([np.ones(n, bool), [True], (c[1:] != c[:-1]), [True]]) if n else np.ones(1, bool)
    at = np.concatenate([np.arange(n), np.full(n + 1, -1)])
    # Deleting any of a run of equal characters gives one string; keep strings of a length apart from those of another.
    role = np.concatenate([np.zeros(n, np.int64), np.ones(n, np.int64), [2]])
    size = np.concatenate([np.full(n, n), np.full(n, n - 1), [n]])
    x = x ^ (size.astype(np.int64) << np.int64(40))
    return at[keep], x[keep], y[keep], role[keep]


def occurrences(docs: DataFrame, threshold: int = THRESHOLD, fold: bool = False) -> DataFrame:
    """A row for each line with text of docs (doc_id, row, text): doc_id, row, line_no, id, cells, probes."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for i in range(0, len(texts), 64):
                take, number, ids, cells, probes = [], [], [], [], []
                for k, text in enumerate(texts[i : i + 64], i):
                    for j, line in enumerate(normalise(text, fold)):
                        if line:
                            take.append(k)
                            number.append(j)
                            ids.append(line_id(line))
                            long = len(line) >= LEAST
                            cells.append(index_cells(line, threshold) if long else [])
                            probes.append(probe_cells(line, threshold) if long else [])
                own = pa.array(take, pa.int64())
                long_list = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(own), b.column("row").take(own), pa.array(number, pa.int32()), pa.array(ids, pa.binary()), pa.array(cells, long_list), pa.array(probes, long_list)], names=["doc_id", "row", "line_no", "id", "cells", "probes"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, line_no int, id binary, cells array<long>, probes array<long>")


def _texts(docs: DataFrame, wanted: DataFrame, fold: bool) -> DataFrame:
    """(id, line) of the distinct lines of docs whose id is in wanted."""
    slot = F.shiftright(F.conv(F.hex(F.substring("id", 1, 3)), 16, 10).cast("long"), 1)  # ids are hashes: their first 23 bits are even
    words = wanted.select(slot.alias("s")).groupBy((F.col("s") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words:  # at most FILTER_BITS / 64 rows
        bits[r.w] = r.bits
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in batches:
            lines = [x for text in b.column("text").to_pylist() for x in set(normalise(text, fold)) if len(x) >= LEAST]
            ids = [line_id(x) for x in lines]
            first = np.frombuffer(b"".join(ids), np.uint8).reshape(-1, 16)[:, :3].astype(np.int64)
            s = (first[:, 0] << 16 | first[:, 1] << 8 | first[:, 2]) >> 1
            take = np.flatnonzero(shared.value[s >> 6] >> (s & 63) & 1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in take], pa.binary()), pa.array([lines[k] for k in take], pa.string())], names=["id", "line"])

    lines = docs.select("text").mapInArrow(run, "id binary, line string")
    return lines.distinct().join(wanted, "id", "left_semi")


def _crowd_links(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, counts) among lines of crowded cells, in rows that grow with their characters: stars have the classes of all links."""

    def run(batches):
        for b in batches:
            for id, line in zip(b.column("id").to_pylist(), b.column("line").to_pylist()):
                at, x, y, role = patterns(line)
                yield pa.RecordBatch.from_arrays([pa.array([id] * len(at), pa.binary()), pa.array(at.astype(np.int32)), pa.array(x), pa.array(y), pa.array(role.astype(np.int8))], names=["id", "at", "x", "y", "role"])

    rows = texts.mapInArrow(run, "id binary, at int, x long, y long, role byte")
    n, own = F.count("*").alias("n"), F.max(F.col("role") == 2).alias("own")
    groups = rows.groupBy("at", "x", "y").agg(n, own).where("n > 1 and (at >= 0 or own)")
    live = saved(rows.join(groups, ["at", "x", "y"]))
    heads = live.where("at < 0 and role = 2").select("at", "x", "y", F.col("id").alias("head")).unionByName(live.where("at >= 0").groupBy("at", "x", "y").agg(F.min("id").alias("head")))
    edges = live.join(heads, ["at", "x", "y"]).where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    counts = live.select("id", F.when((F.col("at") >= 0) | (F.col("role") == 2), F.col("n") - 1).otherwise(F.lit(1)).alias("k"))
    return edges.distinct(), counts


def links(docs: DataFrame, found: DataFrame, threshold: int = THRESHOLD, fold: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, counts): edges (a, b) whose components are those of all pairs of distinct lines within threshold edits, and the number of such
    pairs of each line (id, n_links).  found: what occurrences() gives for docs.

    Cells of up to CROWD lines are joined by index entry against index and probe entries, and each pair is verified.  At a threshold of 1,
    the lines of larger cells share one-edit patterns instead (a shared pattern is a link and each link shares one), so a group of near
    copies grows linearly.  A larger threshold joins every cell pair by pair.
    """
    entries = found.where(F.size("cells") > 0).select("id", F.explode(F.concat(F.transform("cells", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("own"))), F.transform("probes", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("own"))))).alias("e")).select("id", "e.cell", "e.own").distinct()
    sizes = entries.groupBy("cell").agg(F.count("*").alias("n"), F.max("own").alias("some")).where("n > 1 and some")
    live = saved(entries.join(sizes.select("cell", "n"), "cell"))
    crowd = CROWD if threshold == 1 else 1 << 62
    small, other = live.where((F.col("n") <= crowd) & F.col("own")), live.where(F.col("n") <= crowd).select("cell", F.col("id").alias("other"), F.col("own").alias("also"))
    pairs = small.join(other, "cell").where("id < other or (id > other and not also)").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    crowded = live.where(F.col("n") > crowd).select("id").distinct().withColumn("crowded", F.lit(True))
    pairs = pairs.join(crowded.select(F.col("id").alias("a"), F.col("crowded").alias("ca")), "a", "left").join(crowded.select(F.col("id").alias("b"), F.col("crowded").alias("cb")), "b", "left")
    pairs = saved(pairs.where("ca is null or cb is null").select("a", "b"))
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(crowded.select("id")).distinct()
    texts = saved(_texts(docs, saved(wanted), fold))

    def verify(batches):
        for b in batches:
            ok = [within(x, y, threshold) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield b.filter(pa.array(ok, pa.bool_())).drop_columns(["x", "y"])

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    near = saved(both.select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary"))
    star, counts = _crowd_links(texts.join(crowded, "id", "left_semi"))
    edges = near.select("a", "b").unionByName(star)
    one = F.lit(1).alias("k")
    every = near.select(F.col("a").alias("id"), one).unionByName(near.select(F.col("b").alias("id"), one)).unionByName(counts)
    return edges, every.groupBy("id").agg(F.sum("k").cast("long").alias("n_links"))


def _classes(docs: DataFrame, threshold: int, fold: bool) -> DataFrame:
    """doc_id, row, line_no of each line with text, its class's first line as (class_doc, class_row, class_line), n_links, kept."""
    prepare(docs.sparkSession)
    found = saved(occurrences(docs, threshold, fold))
    edges, counts = links(docs, found, threshold, fold)
    roots = components(edges)
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row", "line_no")
    firsts = found.groupBy("id").agg(F.min(place).alias("first")).join(roots.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left").withColumn("root", F.coalesce("root", "id"))
    firsts = saved(firsts)
    linked = firsts.where("n_links > 0")
    best = linked.groupBy("root").agg(F.min("first").alias("best"))
    named = linked.join(best, "root").select("id", "best", "n_links").unionByName(firsts.where("n_links is null").select("id", F.col("first").alias("best"), F.lit(0).cast("long").alias("n_links")))
    kept = (F.col("row") == F.col("best.row")) & (F.col("line_no") == F.col("best.line_no"))
    return found.select("doc_id", "row", "line_no", "id").join(named, "id").select("doc_id", "row", "line_no", F.col("best.doc_id").alias("class_doc"), F.col("best.row").alias("class_row"), F.col("best.line_no").alias("class_line"), "n_links", kept.alias("kept"))


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, fold: bool = False) -> DataFrame:
    """A row for each line with text: doc_id, line_no (from 0), its class as the first line of it (class_doc, class_line), n_links, kept.

    Lines are compared as normalise() gives them; with fold, lines that differ in figures alone are equal.  Equal ones are one text; n_links counts the other texts within threshold edits, and a
    class is what links reach.  Lines under LEAST characters have no links but equality.  The line kept is the class's first by (doc_id, row,
    line number), null ids last.  Null, empty and blank texts have no lines; an empty table has no rows; repeated rows count as rows.
    """
    keyed = numbered(columns(docs, doc_id="long", text="string"))
    return _classes(keyed, threshold, fold).drop("row", "class_row")


def without_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, fold: bool = False) -> DataFrame:
    """docs with only the kept line of each class, and blank lines; text and n_chars (where there is one) change, no row goes.

    A null text stays null; a text of which no line is left is empty.
    """
    place, out_lines = fresh(docs, "place", "lines_out")
    keyed = numbered(docs, place)
    lines = _classes(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(place).alias("row"), F.col("text").cast("string").alias("text")), threshold, fold)
    gone = lines.where(~F.col("kept")).groupBy(F.col("row").alias(place)).agg(F.collect_set("line_no").alias(out_lines))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(out_lines, i)), "\n")
    out = keyed.join(gone, place, "left").withColumn("text", F.when(F.col(out_lines).isNull() | F.col("text").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
