"""Benchmark decontamination with an FM-index for each shard of the training text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns, fresh, prepare, saved

#: Words of training text in a shard (a longer document is a shard of its own), rows of the suffix array between samples,
#: occurrences located at a time, and bytes of benchmark text that are searched for in one pass over the shards: about 60 times as many bytes in
#: each worker, for a window's 13 words at 4 bytes.
SHARD_WORDS, SAMPLE, LOCATE, BLOCK_BYTES = 400_000, 16, 1 << 18, 4 << 20

_MAP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and non-ASCII characters; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_MAP).split()


class Queries:
    """Windows of benchmark items over their own vocabulary (ids from 1); 0 is every other word.  Each window's items are numbers in names."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = 13):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        rows, own = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
        for item, text in items:
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)), np.int32)
            if len(ids):
                some = np.lib.stride_tricks.sliding_window_view(ids, window) if len(ids) >= window else np.pad(ids, (0, window - len(ids)))[None]
                rows.append(some)
                own.append(np.full(len(some), number[item], np.int32))
        every, owner = np.concatenate(rows), np.concatenate(own)
        self.matrix, which = np.unique(every, axis=0, return_inverse=True)
        self.lengths = (self.matrix > 0).sum(axis=1)
        pairs = np.unique(which.ravel().astype(np.int64) * max(1, len(self.names)) + owner)
        self.owners = (pairs % max(1, len(self.names))).astype(np.int32)
        self.first = np.searchsorted(pairs // max(1, len(self.names)), np.arange(len(self.matrix) + 1))

    def items(self, windows: np.ndarray) -> np.ndarray:
        """The numbers of the items that have some of the windows."""
        return np.unique(np.concatenate([self.owners[self.first[w] : self.first[w + 1]] for w in windows.tolist()]))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order, by prefix doubling over those whose rank is still shared; the last symbol occurs once and is the least."""
    n, base = len(text), int(text.max()) + 1
    width = max(1, int(62 // np.log2(max(base, 2))))
    padded = np.concatenate([text.astype(np.int64), np.zeros(width, np.int64)])
    key = padded[:n].copy()
    for k in range(1, width):
        key = key * base + padded[k : n + k]
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    shared = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))  # places in sa
    h = width
    while len(shared):
        at = sa[shared]
        second = np.where(at + h < n, rank[np.minimum(at + h, n - 1)], -1)
        order = np.argsort(rank[at] * (n + 1) + second + 1, kind="stable")
        at, second = at[order], second[order]
        first = rank[at]
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        sa[shared] = at
        rank[at] = np.maximum.accumulate(np.where(fresh, shared, 0))
        shared = shared[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return sa


class FMIndex:
    """Backward search and locate over one shard: wavelet-matrix ranks of the Burrows-Wheeler transform and sampled suffix positions."""

    def __init__(self, text: np.ndarray):
        """text: symbols from 1 up; 0 stands between and for what no query holds."""
        text = np.append(text.astype(np.int64) + 1, 0)  # a terminator below all
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.bits = max(1, int(text.max()).bit_length())
        self.levels, self.zeros = [], []
        row = bwt
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(self.n - self.levels[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        kept = sa % SAMPLE == 0
        self.sampled = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
        self.samples = sa[kept].astype(np.int32)
        starts = np.zeros(len(self.before), np.int64)
        self.start = self.descend(np.arange(len(self.before)), starts)

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, cum, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros):
            ones = cum[at]
            at = np.where((symbol >> level) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands in the transform before at."""
        return self.descend(symbol, at) - self.start[symbol]

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for cum, zeros in zip(self.levels, self.zeros):
            ones = cum[at]
            bit = cum[at + 1] - ones
            out = 2 * out + bit
            at = np.where(bit == 1, zeros + ones, at - ones)
        return out

    def search(self, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, low, high): windows that occur, with their rows of the suffix array."""
        alive = np.arange(len(q.matrix))
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for step in range(q.matrix.shape[1]):
            at = q.lengths[alive] - 1 - step
            some = np.flatnonzero(at >= 0)
            symbol = q.matrix[alive[some], at[some]].astype(np.int64) + 1
            inside = symbol < len(self.before) - 1
            s = np.where(inside, symbol, 0)
            lo[some] = np.where(inside, self.before[s] + self.rank(s, lo[some]), 0)
            hi[some] = np.where(inside, self.before[s] + self.rank(s, hi[some]), 0)
            left = lo < hi
            alive, lo, hi = alive[left], lo[left], hi[left]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array: steps back to the nearest sample."""
        out, steps, todo = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            at = rows[todo]
            hit = self.sampled[at + 1] > self.sampled[at]
            done = todo[hit]
            out[done] = self.samples[self.sampled[at[hit]]] + steps[done]
            todo = todo[~hit]
            at = at[~hit]
            s = self.symbol(at)
            rows[todo] = self.before[s] + self.rank(s, at)
            steps[todo] += 1
        return out


def search_shard(symbols: list[np.ndarray], q: Queries) -> tuple[list[np.ndarray], list[list[str]]]:
    """For each document of a shard (its words' ids): which words are hit, and the items whose windows occur."""
    sizes = np.array([len(s) for s in symbols], np.int64)
    ends = np.cumsum(sizes)
    every = np.concatenate([*symbols, np.zeros(0, np.int32)])
    doc = np.repeat(np.arange(len(symbols), dtype=np.int32), sizes)
    # A run of words that no window holds, and a change of document, is one 0.
    fence = np.zeros(len(every), bool)
    fence[ends[:-1][ends[:-1] < len(every)]] = True
    kept = (every > 0) | np.concatenate([[True], every[1:] != every[:-1]])[: len(every)]
    where = np.flatnonzero(kept)
    text, place = every[where], where
    breaks = np.flatnonzero(fence[where] & (text > 0))
    text, place = np.insert(text, breaks, 0), np.insert(place, breaks, -1)
    cover = np.zeros(len(every) + 1, np.int32)
    pairs = np.zeros(0, np.int64)
    if len(text) and len(q.matrix):
        index = FMIndex(text)
        window, lo, hi = index.search(q)
        count = hi - lo
        for a in range(0, int(count.sum()), LOCATE):
            number = np.arange(a, min(a + LOCATE, int(count.sum())))
            which = np.searchsorted(np.cumsum(count), number, side="right")
            rows = lo[which] + number - (np.cumsum(count) - count)[which]
            at = place[index.locate(rows)]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + q.lengths[window[which]], -1)
            pairs = np.union1d(pairs, doc[at].astype(np.int64) * len(q.matrix) + window[which])
    items: list[list[str]] = [[] for _ in symbols]
    for some in np.split(pairs, np.flatnonzero(np.diff(pairs // max(1, len(q.matrix)))) + 1) if len(pairs) else []:
        items[int(some[0]) // len(q.matrix)] = [q.names[k] for k in q.items(some % len(q.matrix)).tolist()]
    hit = np.cumsum(cover[:-1]) > 0
    return np.split(hit, ends[:-1]) if len(symbols) else [], items


def spans(hit: np.ndarray) -> list[dict]:
    """The merged runs of hit words, as half-open ranges of word numbers."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_FOUND = ("n_words", "spans", "items")
_KINDS = ("long", "array<struct<start:long,stop:long>>", "array<string>")


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> tuple[DataFrame, list[str]]:
    """docs with three columns more, and their names: n_words, spans (merged ranges of hit words), items (ids whose windows occur, sorted).

    The names get an underscore more where docs has them.  A shard is a run of a partition's rows; nothing is shuffled.  The benchmark is the
    stated query set: it goes to the tasks in blocks of about BLOCK_BYTES by item, each a further pass over the rows that adds to the same
    columns.  A pass is written before the next one, so one block is in the workers at a time, and its broadcast is bounded.  Null texts and
    items have no words; an item of fewer words than a window is one window; a null item_id is named "null".
    """
    spark = prepare(docs.sparkSession)
    names = fresh(docs, *_FOUND)
    bench = columns(benchmark, item_id="string", text="string").na.fill("null", ["item_id"])
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = docs
    for block in range(blocks):
        some = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Queries([tuple(r) for r in some], window))
        out = _pass(saved(out) if block else out, shared, names, first=block == 0)
    return out, names


def _pass(rows: DataFrame, shared, found: list[str], first: bool) -> DataFrame:
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields if first or f.name not in found]
    schema = ", ".join(f"`{n}` {k}" for n, k in [*kinds, *zip(found, _KINDS)])
    names = [*(n for n, _ in kinds), *found]

    def run(batches):
        q = shared.value
        get = q.vocabulary.get
        held, symbols, total = [], [], 0

        def flush():
            hits, items = search_shard(symbols, q)
            at = 0
            for b in held:
                n = b.num_rows
                own, some = hits[at : at + n], items[at : at + n]
                if not first:
                    for h, old, more, i in zip(own, b.column(found[1]).to_pylist(), b.column(found[2]).to_pylist(), range(n)):
                        some[i] = sorted({*some[i], *more})
                        for s in old:
                            h[s["start"] : s["stop"]] = True
                cols = b.columns[: len(kinds)] + [pa.array([len(h) for h in own], pa.int64()), pa.array([spans(h) for h in own], _SPANS), pa.array(some, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at += n

        for b in batches:
            for i in range(0, b.num_rows, 64):  # a batch may hold more than a shard
                part = b.slice(i, 64)
                for text in part.column("text").to_pylist():
                    w = words(text)
                    symbols.append(np.fromiter(map(get, w, [0] * len(w)), np.int32, len(w)))
                    total += len(w)
                held.append(part)
                if total >= SHARD_WORDS:
                    yield from flush()
                    held, symbols, total = [], [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, schema)


def _measured(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, list[str]]:
    """annotate()'s rows and names, with two columns and names more: n_hit and bad."""
    rows, names = annotate(docs, benchmark, window)
    hit, bad = fresh(rows, "n_hit", "bad")
    n_hit = F.aggregate(names[1], F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return rows.withColumn(hit, n_hit).withColumn(bad, (F.col(hit) > 0) & (20 * F.col(hit) >= F.col(names[0]))), [*names, hit, bad]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    Repeated rows are judged alike; an empty table has no rows; an empty benchmark hits nothing.
    """
    rows, _ = _measured(columns(docs, doc_id="long", text="string"), benchmark, window)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), F.col("bad").alias("contaminated"), "items", "spans")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """docs without the contaminated ones; the others are unchanged, with all their columns, whatever these are named."""
    rows, names = _measured(docs, benchmark, window)
    return rows.where(~F.col(names[-1])).select(*(F.col(f"`{c}`") for c in docs.columns))
