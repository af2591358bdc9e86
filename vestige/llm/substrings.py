"""Removal of long repeated passages with prefix-partitioned suffix trees."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns, numbered, prepare, saved, text_words

#: Words of a window, and of the word sequences by whose least hash the windows are dealt out.
WINDOW, ANCHOR = 35, 8
#: Most words of a group of suffixes, which one tree holds; larger groups are split by the next of these prefix lengths, which are words of a window.
GROUP_WORDS, PREFIXES = 400_000, (12, 20)
#: Shares in which the windows of one prefix are counted.
SALTS = 64
#: Bytes of text that are hashed at once.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1), modulo 2^64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = _powers[base] = np.cumprod(got)
    return got[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _ranges(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """Hashes of symbols[a:b] for many ranges, the same wherever a range stands."""
    n = len(symbols)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * _power(base, n))])
    return _mix((total[b] - total[a]) * _power(pow(base, -1, 1 << 64), n + 1)[a] + (b - a).astype(np.uint64))


class Words:
    """Places and hashes of the words of some texts, end to end, with one space between.

    These hashes deal words out and tell where a window may repeat in its own run; that words are equal is never concluded from them.
    """

    def __init__(self, raws: list[bytes]):
        lists = [r.split() for r in raws]
        self.raw = b" ".join(b" ".join(x) for x in lists if x) + b" "
        symbols = np.frombuffer(self.raw, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[symbols]])))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.cumsum([0, *map(len, lists)])  # the number of each text's first word
        self.hash = _ranges(symbols.astype(np.uint64) + np.uint64(1), self.start, self.end, _BYTE)
        self.doc = np.searchsorted(self.first[1:], np.arange(len(self.start)), side="right")

    def slice(self, a: int, b: int) -> bytes:
        return self.raw[self.start[a] : self.end[b - 1]]

    def prefixes(self, starts: np.ndarray, n: int) -> np.ndarray:
        return _ranges(self.hash, starts, starts + n, _WORD).view(np.int64)

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(n, 2) longs: 128 bits of BLAKE2b of each range's words with one space between.  Two different ranges never share one in practice."""
        view = memoryview(self.raw)
        found = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(self.start[starts].tolist(), self.end[ends - 1].tolist())])
        return np.frombuffer(found, np.int64).reshape(-1, 2)

    def runs(self, window: int, anchor: int) -> tuple[np.ndarray, ...]:
        """(text, start, n, key, own, content): maximal runs of n consecutive windows with one key, the least hash of an anchor's words inside.

        Equal windows have equal keys.  own: the run's words hold some anchor twice, so they may hold a window twice.  start: the word's
        number in its text; content: digest of all the run's words.
        """
        n, width = len(self.hash), window - anchor + 1
        if n < window:
            return tuple(np.zeros(z, t) for z, t in ((0, np.int64), (0, np.int64), (0, np.int64), (0, np.int64), (0, bool), ((0, 2), np.int64)))
        least = _ranges(self.hash, np.arange(n - anchor + 1), np.arange(anchor, n + 1), _WORD)
        order = np.argsort(least, kind="stable")
        again = np.zeros(len(least) + 1, np.int64)  # places before which an equal anchor stands within reach of one window more
        again[1 + order[1:][(least[order[1:]] == least[order[:-1]]) & (order[1:] - order[:-1] <= width)]] = 1
        again = np.cumsum(again)
        size = 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if width > size:
            least = np.minimum(least[: size - width], least[width - size :])
        at = np.arange(n - window + 1)
        inside = np.flatnonzero(self.doc[at] == self.doc[at + window - 1])
        if not len(inside):
            return tuple(np.zeros(z, t) for z, t in ((0, np.int64), (0, np.int64), (0, np.int64), (0, np.int64), (0, bool), ((0, 2), np.int64)))
        key = least[inside]
        new = np.flatnonzero(np.concatenate([[True], (inside[1:] != inside[:-1] + 1) | (key[1:] != key[:-1]) | (self.doc[inside[1:]] != self.doc[inside[:-1]])]))
        count = np.diff(np.append(new, len(inside)))
        start = inside[new]
        return self.doc[start], start - self.first[self.doc[start]], count, key[new].view(np.int64), again[start + count + width - 1] > again[start], self.digests(start, start + count + window - 1)


def _raw(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _chunks(texts: list[str | None]):
    """(first, Words) over runs of texts of about CHUNK_BYTES; a longer text is a run of its own."""
    held, first, size = [], 0, 0
    for i, raw in enumerate(_raw(texts)):
        if held and size + len(raw) > CHUNK_BYTES:
            yield first, Words(held)
            held, first, size = [], i, 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, Words(held)


class SuffixTree:
    """The suffix tree of some word sequences, as its leaves in order and the depth of the node that each two neighbours part at.

    An internal node is a run of leaves whose neighbours all part at its depth or deeper.  Sequences end in symbols of their own, so no
    path runs on from one to the next.  Depths are exact up to twice the deepest asked for, which is as far as suffixes are sorted.
    """

    def __init__(self, sequences: list[bytes], depth: int):
        names: dict[bytes, int] = {}
        lists = [s.split() for s in sequences]
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1
        n = int(self.sizes.sum()) + len(lists)
        text = np.empty(n, np.int64)
        ends = self.first + self.sizes
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = np.fromiter((names.setdefault(w, len(names)) for x in lists for w in x), np.int64, n - len(lists))
        text[ends] = len(names) + np.arange(len(lists))
        # Ranks of all suffixes by their first 1, 2, 4 ... words.
        ranks = [np.unique(text, return_inverse=True)[1]]
        while 1 << len(ranks) - 1 < depth:
            reach, rank = 1 << len(ranks) - 1, ranks[-1]
            behind = np.zeros(n, np.int64)
            behind[:-reach] = rank[reach:] + 1
            ranks.append(np.unique(rank * (n + 1) + behind, return_inverse=True)[1])
        self.leaves = np.argsort(ranks[-1], kind="stable")
        a, b = self.leaves[:-1].copy(), self.leaves[1:].copy()
        self.parting = np.zeros(max(0, n - 1), np.int64)
        for level in range(len(ranks) - 1, -1, -1):  # equal halves first: the depth in binary
            rank, within = ranks[level], np.maximum(a, b) < n
            same = np.zeros(len(a), bool)
            same[within] = rank[a[within]] == rank[b[within]]
            self.parting[same] += 1 << level
            a[same] += 1 << level
            b[same] += 1 << level

    def deep_nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last): the leaves below each topmost internal node of the depth or deeper; each node is a maximal repeat."""
        deep = np.diff(np.concatenate([[0], (self.parting >= depth).astype(np.int8), [0]]))
        return np.flatnonzero(deep > 0), np.flatnonzero(deep < 0)


def deep_windows(stretches: list[bytes], window: int) -> list[np.ndarray]:
    """For each stretch, which of its windows start at a leaf below an internal node of depth window or more."""
    tree = SuffixTree(stretches, window)
    below = np.zeros(len(tree.leaves) + 1, np.int64)
    first, last = tree.deep_nodes(window)
    below[first] += 1
    below[last + 1] -= 1
    repeated = np.zeros(len(tree.leaves), bool)
    repeated[tree.leaves[np.cumsum(below[:-1]) > 0]] = True
    return [repeated[a : a + n - window + 1] for a, n in zip(tree.first.tolist(), tree.sizes.tolist())]


def _spans(row: list[int], start: list[int], flags: list[np.ndarray], window: int) -> pa.RecordBatch:
    rows, a, b = [], [], []
    for r, s, f in zip(row, start, flags):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], f.astype(np.int8), [0]])))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
            rows.append(r)
            a.append(s + x)
            b.append(s + y + window - 1)
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["row", "start", "stop"])


_RUNS = pa.schema([("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("own", pa.bool_()), ("c1", pa.int64()), ("c2", pa.int64())])
_PIECES = pa.schema([("row", pa.int64()), ("start", pa.int32()), ("key", pa.int64()), ("stretch", pa.binary()), ("crowd", pa.bool_()), ("p0", pa.int64()), ("p1", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())])


def _trees(pieces: DataFrame, window: int) -> DataFrame:
    """Spans of repeated windows in pieces (group, row, start, stretch): groups meet in a partition, and each tree holds some whole groups."""

    def trees(batches):
        held, last, total = [], None, 0

        def grow():
            rows, starts, stretches = ([h[i] for h in held] for i in range(3))
            return _spans(rows, starts, deep_windows(stretches, window), window)

        for b in batches:
            for r, s, k, x in zip(*(b.column(c).to_pylist() for c in ("row", "start", "group", "stretch"))):
                if total >= GROUP_WORDS and k != last:
                    yield grow()
                    held, total = [], 0
                held.append((r, s, x))
                last, total = k, total + x.count(b" ") + 1
        if held:
            yield grow()

    return pieces.select("group", "row", "start", "stretch").repartition("group").sortWithinPartitions("group").mapInArrow(trees, "row long, start int, stop int")


def _counted(pieces: DataFrame, *keys: str) -> DataFrame:
    """The pieces whose keys stand more than once, and how often (n).

    A group's pieces are counted and joined in SALTS shares, and only the shares' counts meet, so no task reads a whole large group.
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).cast("int"))
    shares = salted.groupBy(*keys, "salt").agg(F.count("*").alias("n"))
    totals = shares.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1")
    return salted.join(totals.select(*keys, "n", F.explode("salts").alias("salt")), [*keys, "salt"]).drop("salt")


def repeated_spans(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(row, start, stop): ranges of words covered by windows that start anywhere else too; they may overlap.  keyed: (row, text).

    A suffix is dealt out by a prefix.  The first is the anchor: the word sequence of least hash in the window, which equal windows share, so
    that neighbouring suffixes travel as one stretch.  Stretches of equal digests are one first.  A group that is above GROUP_WORDS with
    the anchor alone is split by its windows' first words, as many of PREFIXES as it takes; windows that are still too many to fit are equal
    in all their words, or are told apart by the digest of these: that node is deep itself, and needs no tree below it.
    """

    def scan(batches):
        for b in batches:
            rows = b.column("row").to_numpy()
            for first, words in _chunks(b.column("text").to_pylist()):
                doc, start, n, key, own, content = words.runs(window, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(rows[first + doc]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key), pa.array(own), pa.array(content[:, 0]), pa.array(content[:, 1])], schema=_RUNS)

    runs = saved(keyed.mapInArrow(scan, "row long, start int, n int, key long, own boolean, c1 long, c2 long"))
    # A key that stands once, in a run that can't hold a window twice, repeats nothing; that is most of the text, and goes no further.
    again = runs.groupBy("key").agg(F.count("*").alias("runs"), F.max("own").alias("own")).where("runs > 1 or own").select("key")
    runs = saved(runs.join(again, "key", "left_semi"))
    alike = runs.groupBy("key", "c1", "c2").agg(F.count("*").alias("copies"), F.min("row").alias("first"), F.max("own").alias("own"), F.first("n").alias("n"))
    groups = alike.groupBy("key").agg(F.count("*").alias("variants"), F.max("own").alias("own"), F.sum(F.col("n") + window - 1).alias("words")).where("variants > 1 or own")
    live = alike.drop("own", "n").join(groups.select("key", "words"), "key", "left").where("copies > 1 or words is not null")
    found = saved(runs.join(live, ["key", "c1", "c2"]).where((F.col("copies") > 1) | (F.col("row") == F.col("first"))).select("row", "start", "n", "key", "copies", ((F.col("row") == F.col("first")) & F.col("words").isNotNull()).alias("open"), F.coalesce(F.col("words") > GROUP_WORDS, F.lit(False)).alias("crowd")))
    direct = found.where("copies > 1").select("row", "start", (F.col("start") + F.col("n") + window - 1).alias("stop"))
    asked = found.where("open").groupBy("row").agg(F.collect_list(F.struct("start", "n", "key", "crowd")).alias("asked"))

    def cut(batches):
        for b in batches:
            rows, texts, asked = (b.column(c).to_pylist() for c in ("row", "text", "asked"))
            for r, text, some in zip(rows, texts, asked):
                words, out = Words(_raw([text])), []
                for x in some:
                    s, n, k = x["start"], x["n"], x["key"]
                    if x["crowd"]:
                        at = np.arange(s, s + n)
                        hashes = [words.prefixes(at, p).tolist() for p in PREFIXES]
                        out += [(r, i, k, words.slice(i, i + window), True, p, q, *c) for i, p, q, c in zip(at.tolist(), *hashes, words.digests(at, at + window).tolist())]
                    else:
                        out.append((r, s, k, words.slice(s, s + n + window - 1), False, 0, 0, 0, 0))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)], schema=_PIECES)

    pieces = saved(keyed.join(asked, "row").mapInArrow(cut, "row long, start int, key long, stretch binary, crowd boolean, p0 long, p1 long, c1 long, c2 long"))
    grown = [pieces.where(~F.col("crowd")).withColumn("group", F.col("key"))]
    left = pieces.where("crowd")
    for p in ("p0", "p1"):
        sized = _counted(left, "key", p)
        grown.append(sized.where(F.col("n") * window <= GROUP_WORDS).withColumn("group", F.xxhash64("key", p)).drop("n"))
        left = sized.where(F.col("n") * window > GROUP_WORDS).drop("n")
    whole = _counted(left, "c1", "c2").select("row", "start", (F.col("start") + window).alias("stop"))
    spans = [direct, *(_trees(g, window) for g in grown), whole]
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_removed, kept (the words left, joined by one space), spans (what is removed).

    A word goes if a window over it, of that many words of one document, starts anywhere else too.  Null texts have no words; texts of
    fewer words than a window lose none; repeated rows are each other's copies; an empty table has no rows.
    """
    prepare(docs.sparkSession)
    keyed = numbered(columns(docs, doc_id="long", text="string"))
    gone = repeated_spans(keyed.select("row", "text"), window).distinct().groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))

    def strike(batches):
        for b in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                words = text_words(text)
                cover = np.zeros(len(words) + 1, np.int64)
                for g in gone or ():
                    cover[g["start"]] += 1
                    cover[g["stop"]] -= 1
                hit = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                n_words.append(len(words))
                n_removed.append(int(hit.sum()))
                kept.append(b" ".join([w for w, h in zip(words, hit.tolist()) if not h]).decode("utf-8", "surrogatepass"))
                spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(edge[::2], edge[1::2])])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return keyed.join(gone, "row", "left").select("doc_id", "text", "gone").mapInArrow(strike, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,stop:long>>")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_words, n_removed, kept_sha256."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
