"""Packing by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import SLICE_BYTES, coded, columns, gathered, joined, prepare
from .vocabulary import pretokens_of_each

#: Tokens that are packed together; a task holds no more than this and one Arrow batch.
BLOCK_TOKENS = 2_000_000
#: Longest cut of what is left of a document beyond whole sequences.
PIECE = 512
#: Pre-tokens whose ids a worker remembers before it starts anew: about 30 MB.
MEMORY = 200_000


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part (0 to k-1) of each item: a heap of partial partitions, the two most uneven merged largest with smallest, until one is left."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    # A partial partition: sums less the least of them, falling, and for each its tree of merged slots.
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    left, right, fresh = list(range(n)), [-1] * n, n
    # Slots that are empty need no entry: a partition lists its non-zero sums alone, so early merges are short.
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, tie, b, tb = heapq.heappop(heap)
        over = len(a) + len(b) - k
        sums, trees = np.concatenate([a, b]), np.concatenate([ta, tb])
        if over > 0:  # a's smallest `over` slots meet b's largest, in opposite order
            x, y = slice(len(a) - over, len(a)), slice(0, over)
            joined = a[x] + b[y][::-1]
            new = np.arange(fresh, fresh + over)
            left += ta[x].tolist()
            right += tb[y][::-1].tolist()
            fresh += over
            sums, trees = np.concatenate([a[: len(a) - over], joined, b[over:]]), np.concatenate([ta[: len(a) - over], new, tb[over:]])
        order = np.argsort(-sums, kind="stable")
        sums, trees = sums[order], trees[order]
        if len(sums) == k and sums[-1] > 0:  # only the differences matter; zero slots stay listed once all are in use
            sums = sums - sums[-1]
        spread = int(sums[0] - (sums[-1] if len(sums) == k else 0))
        heapq.heappush(heap, (-spread, tie, sums, trees))
    part = np.zeros(n, np.int64)
    for p, root in enumerate(heap[0][3].tolist()):
        stack = [root]
        while stack:
            t = stack.pop()
            if t < n:
                part[t] = p
            else:
                stack += (left[t], right[t])
    return part


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each item (none over capacity) and their number, which rises whenever a window's sum exceeds the capacity."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    if len(sizes) and k > 1 and k * capacity - total < sizes.max():  # so full that no division is likely to fit
        k += 1
    while True:
        part = differencing(sizes, k)
        if len(sizes) == 0 or np.bincount(part, sizes, k).max() <= capacity:
            return part, k
        k += 1


class _Ids:
    """Ids of whole texts.

    Texts are cut at white space, which no pre-token crosses, and each different word of a run of texts is looked at once.  The ids of its
    pre-tokens are remembered; unknown ones go to the library many at a time, as one text: each ends with the only ids that end a word, which
    tell them apart.  Texts with a special string go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        end = self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for name, i in names.items() if name.endswith(end)]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"\n": -1}
        self.pool, self.start, self.size, self.again = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def forget(self) -> None:
        """Pre-tokens that no later run of texts has had go; all of them, where that leaves too many."""
        keep = np.flatnonzero(self.again)
        if 2 * len(keep) > MEMORY:
            return self.clear()
        names = [w for w, k in self.known.items() if k < 0 or self.again[k]]
        self.known = dict(zip(names, range(-1, len(keep))))
        self.pool, self.size = gathered(self.pool, self.start[keep], self.size[keep]), self.size[keep]
        self.start, self.again = np.cumsum(self.size) - self.size, np.zeros(len(keep), bool)

    def learn(self, new: list[str]) -> None:
        pools = [self.pool]
        for i in range(0, len(new), 5000):
            some = new[i : i + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise AssertionError("a pre-token has more ends than one")
            self.start = np.concatenate([self.start, sum(map(len, pools)) + np.concatenate([[0], ends[:-1]])])
            self.size = np.concatenate([self.size, np.diff(ends, prepend=0)])
            self.known.update(zip(some, range(len(self.known) - 1, len(self.known) - 1 + len(some))))
            pools.append(ids)
        self.pool = np.concatenate(pools)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > MEMORY:
            self.forget()
        special = pc.match_substring(texts, "<|").fill_null(False)
        odd = np.flatnonzero(np.asarray(special))
        codes, ends, different = coded(pc.if_else(special, "", texts))
        parts = pretokens_of_each(different)
        old = len(self.known) - 1
        self.learn(list(set(parts).difference(self.known)))
        number = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        inside = number >= 0
        self.again = np.concatenate([self.again, np.zeros(len(self.known) - 1 - old, bool)])
        self.again[number[inside & (number < old)]] = True
        edge = np.concatenate([[0], np.cumsum(inside)[~inside]])
        number = number[inside]
        each = np.concatenate([[0], np.cumsum(self.size[number])])[edge]  # where each word's ids begin among those of all different words
        size = np.diff(each)[codes]
        ids = gathered(gathered(self.pool, self.start[number], self.size[number]), each[codes], size)
        out = np.split(ids, np.concatenate([[0], np.cumsum(size)])[ends][:-1]) if len(texts) else []
        for i in odd.tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


@lru_cache(maxsize=2)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def pack_block(ids: list[np.ndarray], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) for every piece of the documents' ids; windows count from 0."""
    pieces, whole = [], 0
    out = []
    for d, x in enumerate(ids):
        n = len(x)
        full = n // capacity
        out += [(d, i * capacity, capacity, whole + i, 0) for i in range(full)]
        whole += full
        pieces += [(d, s, min(PIECE, n - s)) for s in range(full * capacity, n, PIECE)]
    part, _ = windows(np.array([p[2] for p in pieces], np.int64), capacity)
    at: dict[int, int] = {}
    for (d, s, n), w in zip(pieces, part.tolist()):
        o = at.get(w, 0)
        out.append((d, s, n, whole + w, o))
        at[w] = o + n
    return out


def pack(docs: DataFrame, path: str, capacity: int = 4096, stop: int = 2) -> DataFrame:
    """Pieces of documents in sequences of at most capacity tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the tokenizer's ids and then the id stop.  Whole sequences are cut off first; what is left is cut at PIECE tokens, and
    the pieces of each block of BLOCK_TOKENS go to near-equal windows by differencing.  Blocks are runs of a partition's rows, so nothing is
    shuffled or collected, and a lost task repeats alone.  Null and empty texts are one id, the stop.  Repeated rows are packed as often as
    they come.  sequence_id is the partition's number times 2^32 plus a count; an empty table has no rows.
    """
    prepare(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    last = np.array([stop], np.uint32)

    def flush(doc_ids, ids, base):
        rows = pack_block(ids, capacity)
        cols = [[], [], [], [], [], [], []]
        for d, s, n, w, o in rows:
            for c, v in zip(cols, (doc_ids[d], s, n, zlib.crc32(ids[d][s : s + n]), len(ids[d]), base + w, o)):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names), base + 1 + max((r[3] for r in rows), default=-1)

    def run(batches):
        encoder, base = _ids(path), TaskContext.get().partitionId() << 32
        doc_ids, ids, held = [], [], 0
        for keys, texts in joined(batches, SLICE_BYTES // 2):
            new = [np.concatenate([x, last]) for x in encoder.encode(texts)]
            doc_ids += keys.to_pylist()
            ids += new
            held += sum(map(len, new))
            if held >= BLOCK_TOKENS:
                out, base = flush(doc_ids, ids, base)
                yield out
                doc_ids, ids, held = [], [], 0
        if ids:
            yield flush(doc_ids, ids, base)[0]

    return columns(docs, doc_id="long", text="string").mapInArrow(run, ", ".join(f"{n} long" for n in names))
