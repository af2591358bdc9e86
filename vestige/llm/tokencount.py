"""Token counts by a compiled finite-state transducer."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns, prepare
from .vocabulary import Vocabulary, pretokens

#: Symbols in a chunk; states compiled before the table starts anew (bounds a worker's memory, never a result).
CHUNK, MOST_STATES = 512, 150_000
_SHIFT, _BIAS = 64, 32


class Transducer:
    """Deterministic transitions over symbols (a byte, or a byte plus 256 where it ends a word), each with the tokens it emits.

    A state holds, for each suffix of the word so far that some token may still extend, the last token before that suffix and the number of
    tokens there relative to now.  The last token of a prefix is the one suffix token whose pair with the token before it stays unmerged.  A
    transition emits the change in the number of tokens, which may be negative.  A final symbol leads back to the start.  States and
    transitions are compiled when first met.
    """

    START = 0

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.inner = {t[:k] for t in vocabulary.ids for k in range(1, len(t))}
        self.pairs: dict[tuple, bool] = {}
        self.column = np.full(512, -1, np.int16)
        self.clear()

    def clear(self) -> None:
        start = ((), ((0, (), 0),))
        self.states, self.known = [start], {start: 0}
        self.used = 0
        self.column[:] = -1
        self.table = np.full((1024, 64), -1, np.int32)

    def unmerged(self, a: tuple, b: tuple) -> bool:
        """Whether a before b are both tokens of their joined symbols."""
        if (got := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            got = self.pairs[a, b] = self.v.encode(a + b) == ([a, b] if a else [b])
        return got

    def compile(self, state: int, symbol: int) -> int:
        suffix, live = self.states[state]
        tail = suffix + (symbol,)
        for length, before, count in sorted(live, reverse=True):
            token = tail[len(tail) - length - 1 :]
            if token in self.v.ids and self.unmerged(before, token):
                break
        else:
            raise AssertionError("a byte has no token")
        emitted = count + 1
        if symbol >= 256:
            return self.START * _SHIFT + emitted + _BIAS
        kept = [(n + 1, b, c - emitted) for n, b, c in live if tail[len(tail) - n - 1 :] in self.inner]
        longest = max((n for n, _, _ in kept), default=0)
        new = (tail[len(tail) - longest :], tuple(sorted([*kept, (0, token, 0)])))
        if (to := self.known.get(new)) is None:
            to = self.known[new] = len(self.states)
            self.states.append(new)
            if to >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return to * _SHIFT + emitted + _BIAS

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and what is emitted, for many lanes at once."""
        cols = self.column[symbols]
        if (cols < 0).any():
            for s in np.unique(symbols[cols < 0]):
                if self.used == self.table.shape[1]:
                    self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
                self.column[s], self.used = self.used, self.used + 1
            cols = self.column[symbols]
        got = self.table[states, cols]
        if (got < 0).any():
            for s, x in {(int(s), int(x)) for s, x in zip(states[got < 0], symbols[got < 0])}:
                value = self.compile(s, x)
                self.table[s, self.column[x]] = value
            got = self.table[states, cols]
        return got // _SHIFT, got % _SHIFT - _BIAS

    def run(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each run of symbols (runs begin at starts and are not empty), by chunks whose state maps are composed.

        A chunk's map from the state before it is (head, body, state after): a final symbol always leads to the start, so all entries agree
        behind the first one; only the head before it depends on the entry.  All bodies run at once, in lanes.  An exclusive scan that joins
        maps pairwise, at doubling distances, gives each chunk its entry; then the heads run from their entries.
        """
        if len(self.states) > MOST_STATES:
            self.clear()
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int64)
        cuts = np.unique(np.concatenate([np.arange(0, n, CHUNK), starts]))
        ends = np.append(cuts[1:], n)
        finals = np.flatnonzero(symbols >= 256)
        at = np.searchsorted(finals, cuts)
        reset = np.append(finals, n)[at] + 1
        own = np.isin(cuts, starts)  # a run's first chunk has the start as its entry
        head = np.where(own, cuts, np.minimum(reset, ends))
        pure = ~own & (reset > ends)  # no final symbol inside: its map is all head
        body, after = self.lanes(symbols, head, ends, np.zeros(len(cuts), np.int64))
        # The scan: source[k] is the chunk whose exit state, carried through the pure chunks between, is chunk k's entry.
        source = np.where(pure, np.arange(len(cuts)) - 1, np.arange(len(cuts)))
        while (moved := source[source] != source).any():
            source = np.where(moved, source[source], source)
        entry = np.zeros(len(cuts), np.int64)
        first = np.flatnonzero(~own)
        before = source[first - 1]
        begin = np.where(pure[first - 1], ends[before], cuts[first])  # a word longer than a chunk is read on from its source's exit
        lead, _ = self.lanes(symbols, np.where(pure[first], cuts[first], begin), np.where(pure[first], cuts[first], head[first]), after[before])
        entry[first] = lead
        # A word that ends in no later chunk of its run cannot be: the last symbol of a run is final.
        total = body + entry
        return np.add.reduceat(total, np.searchsorted(cuts, starts))

    def lanes(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is emitted from begin to end in each lane, and the states there."""
        count, states = np.zeros(len(begin), np.int64), states.astype(np.int64)
        order = np.argsort(begin - end, kind="stable")  # the longest first, so that running lanes are a prefix
        b, length = begin[order], (end - begin)[order]
        s, c = states[order], count[order]
        running = len(order)
        for k in range(int(length[0]) if len(length) else 0):
            running = int(np.searchsorted(-length[:running], -k, side="left"))
            s[:running], emitted = self.step(s[:running], symbols[b[:running] + k])
            c[:running] += emitted
        states[order], count[order] = s, c
        return count, states


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(Vocabulary(path))


def count_texts(texts: list[str | None], path: str) -> np.ndarray:
    """Tokens of each whole text; null counts as empty."""
    t = transducer(path)
    out, lists, rows = np.zeros(len(texts), np.int64), [], []
    for i, text in enumerate(texts):
        words = []
        if text:
            parts = t.v.split(text) if "<|" in text else [text]
            out[i] = len(parts) - 1
            for part in parts:
                words += pretokens(part)
        if words:
            lists.append(" ".join(words))
            rows.append(i)
    if rows:
        raw = [x.encode("utf-8", "surrogatepass") for x in lists]
        joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        gap = joined == 32
        final = np.append(gap[1:], True)
        symbols = (joined.astype(np.int16) + 256 * final)[~gap]
        starts = np.cumsum([0, *(len(x) + 1 for x in raw[:-1])])
        out[rows] += t.run(symbols, starts - np.searchsorted(np.flatnonzero(gap), starts))
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row for each row of docs, in one pass without a shuffle.

    path: a word-end byte-pair .json file that every executor has.  Null and empty texts have 0 bytes and 0 tokens; a null doc_id stays null.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            n = count_texts(texts, path)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len((x or "").encode("utf-8", "surrogatepass")) for x in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
