"""Toxic spans and scores by a linear-chain conditional random field."""

from __future__ import annotations

import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns, prepare, saved

#: Documented bounds of the training sample: documents of each label, and the characters of a document that may be in it.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 20_000
#: Least documents of the rarer label that a feature is in, and least log-odds at which it is kept and at which it tags a token.
LEAST_DOCS, KEEP_ODDS, TAG_ODDS = 4, 1.0, 2.0
#: Words of a training chain; chains whose gradient is summed at a time; rounds of gradient ascent; words a worker remembers.
CHAIN, BLOCK, ROUNDS, MEMORY = 64, 8192, 40, 1_000_000
PREDICT = 0.3

_word = re.compile(r"[^\W\d_]+")


def lower(text: str | None) -> str:
    """Lower case, but for characters whose lower case is longer, so that places stay those of the text."""
    text = text or ""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def features(word: str) -> list[str]:
    """The word, its beginnings of 3 to 8 letters and its ends of 3 to 5; the word is lower-cased."""
    n = len(word)
    return [word + "$", *(word[:k] + "-" for k in range(3, min(n, 9))), *("-" + word[-k:] for k in range(3, min(n, 6)))]


class Crf:
    """Two tags; a token's evidence for the toxic one is bias plus its features' weights, and neighbouring tags have transition weights."""

    def __init__(self, weights: dict[str, float], bias: float, transitions: np.ndarray, calibration: np.ndarray):
        self.weights, self.bias, self.transitions, self.calibration = weights, bias, transitions, calibration
        self.memo: dict[str, float] = {}
        plain = np.exp(transitions) * np.array([1.0, np.exp(bias)])
        values, vectors = np.linalg.eig(plain)
        order = np.argsort(-values.real)
        values, vectors = values.real[order], vectors.real[:, order]
        inverse = np.linalg.inv(vectors)
        #: plain^k = first + ratio^k * second, but for a factor: so a gap of any length is one step.
        self.first, self.second, self.ratio = np.outer(vectors[:, 0], inverse[0]), np.outer(vectors[:, 1], inverse[1]), values[1] / values[0]

    def evidence(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMORY:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
        except KeyError:
            for w in set(words).difference(memo):
                memo[w] = sum(self.weights.get(f, 0.0) for f in features(w))
            return np.fromiter(map(memo.__getitem__, words), np.float64, len(words))

    def marginals(self, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, probabilities of the toxic tag) of the tokens with evidence of their own; all others count, in closed form, between them."""
        at = np.flatnonzero(evidence)
        if not len(at):
            return at, np.zeros(0)
        gaps = np.diff(np.concatenate([[-1], at, [len(evidence)]])) - 1
        power = self.ratio ** gaps.astype(np.float64)
        between = self.first[None] + power[:, None, None] * self.second[None]
        step, e = np.exp(self.transitions), np.exp(self.bias + evidence[at])
        # A hop: the gap's tokens, then the next token's transition; the first gap has no tag before it.
        hops = (between[1:-1] @ step).tolist()
        x, y = 1.0, 1.0
        if gaps[0]:  # the first of all tokens has no transition before it
            x, y = (np.array([1.0, np.exp(self.bias)]) @ (self.first + self.ratio ** (gaps[0] - 1.0) * self.second) @ step).tolist()
        forward, es = [], e.tolist()
        for k, v in enumerate(es):
            if k:
                (p, q), (r, s) = hops[k - 1]
                x, y = x * p + y * r, x * q + y * s
            y *= v
            t = x + y
            x, y = x / t, y / t
            forward.append((x, y))
        (c00, c01), (c10, c11) = between[-1].tolist()
        x, y = (c00 + c01, c10 + c11) if gaps[-1] else (1.0, 1.0)
        out = [0.0] * len(es)
        for k in range(len(es) - 1, -1, -1):
            f0, f1 = forward[k]
            out[k] = f1 * y / (f0 * x + f1 * y)
            if k:
                (p, q), (r, s) = hops[k - 1]
                y *= es[k]
                x, y = p * x + q * y, r * x + s * y
                t = x + y
                x, y = x / t, y / t
        return at, np.clip(np.array(out), 0.0, 1.0)

    def summary(self, p: np.ndarray, n: int) -> np.ndarray:
        """What the document's score is made of: a constant, the largest marginal, the expected toxic tokens, and their share."""
        top, total = float(p.max(initial=0.0)), float(p.sum())
        return np.array([1.0, np.log((top + 1e-4) / (1 - top + 1e-4)), np.log1p(total), np.sqrt(total / max(n, 1)), np.log1p(n)])

    def tag(self, text: str | None) -> tuple[float, list[dict]]:
        """Score, and spans {start, stop, probability} in characters of tokens that are more likely toxic than not."""
        lowered = lower(text)
        words = _word.findall(lowered)
        at, p = self.marginals(self.evidence(words))
        score = float(1 / (1 + np.exp(-np.clip(self.summary(p, len(words)) @ self.calibration, -30, 30))))
        spans, likely = [], dict(zip(at[p >= 0.5].tolist(), p[p >= 0.5].tolist()))
        if likely:
            for k, m in enumerate(_word.finditer(lowered)):
                if k in likely:
                    spans.append({"start": m.start(), "stop": m.end(), "probability": likely[k]})
        return score, spans


class _Block:
    """Chains of one block, longest first, and the gradient of their likelihood: what training holds grows with a block, not the sample."""

    def __init__(self, length: np.ndarray, gold: np.ndarray, cell: np.ndarray, feature: np.ndarray, start: int):
        self.length, self.gold = length[start : start + BLOCK], gold[start : start + BLOCK]
        low, high = np.searchsorted(cell, [start * CHAIN, (start + BLOCK) * CHAIN])
        self.cell, self.feature = cell[low:high] - start * CHAIN, feature[low:high]
        self.live = [int((self.length > t).sum()) for t in range(CHAIN)]
        self.mask = np.arange(CHAIN)[None] < self.length[:, None]
        self.observed = np.zeros((2, 2))
        np.add.at(self.observed, (self.gold[:, :-1][self.mask[:, 1:]], self.gold[:, 1:][self.mask[:, 1:]]), 1)

    def gradient(self, x: np.ndarray) -> np.ndarray:
        """Observed less expected counts of features, tag and transitions, at the parameters x."""
        n, count, mask, live = len(self.length), len(x) - 5, self.mask, self.live
        bias, a = x[count], np.exp(x[count + 1 :].reshape(2, 2))
        s = np.bincount(self.cell, x[self.feature], n * CHAIN)
        e = np.exp(np.clip(s.reshape(n, CHAIN) + bias, -30, 30))
        f0, f1, b0, b1 = (np.ones((n, CHAIN)) for _ in range(4))
        for t in range(CHAIN):
            k = live[t]
            p0, p1 = (f0[:k, t - 1] * a[0, 0] + f1[:k, t - 1] * a[1, 0], f0[:k, t - 1] * a[0, 1] + f1[:k, t - 1] * a[1, 1]) if t else (np.ones(k), np.ones(k))
            p1 = p1 * e[:k, t]
            z = p0 + p1
            f0[:k, t], f1[:k, t] = p0 / z, p1 / z
        for t in range(CHAIN - 2, -1, -1):
            k = live[t + 1]
            q0, q1 = b0[:k, t + 1], b1[:k, t + 1] * e[:k, t + 1]
            p0, p1 = a[0, 0] * q0 + a[0, 1] * q1, a[1, 0] * q0 + a[1, 1] * q1
            z = p0 + p1
            b0[:k, t], b1[:k, t] = p0 / z, p1 / z
        p = np.where(mask, f1 * b1 / (f0 * b0 + f1 * b1), 0.0)
        r1 = b1[:, 1:] * e[:, 1:]
        pair = np.stack([f0[:, :-1] * a[0, 0] * b0[:, 1:], f0[:, :-1] * a[0, 1] * r1, f1[:, :-1] * a[1, 0] * b0[:, 1:], f1[:, :-1] * a[1, 1] * r1])
        pair /= pair.sum(axis=0)
        pair *= mask[None, :, 1:]
        g = np.where(mask, self.gold - p, 0.0).ravel()
        return np.concatenate([np.bincount(self.feature, g[self.cell], count), [g.sum()], self.observed.ravel() - pair.sum(axis=(1, 2))])


def train(examples: list[tuple[str, int]], drawn_from: dict[int, int] | None = None) -> Crf:
    """A field from (text, label): features' log-odds tag the tokens of toxic documents, the tags train the field, the labels its calibration.

    drawn_from: documents of each label that the examples are drawn from.  Each label has its share of these in the calibration, so a
    probability means the same whether the sample holds all of them or is capped; without it, the examples are all there is.
    """
    same: dict[str, str] = {}  # equal words are one object
    docs = [([same.setdefault(w, w) for w in _word.findall(lower(t))], int(y)) for t, y in examples]
    seen = [Counter(), Counter()]
    number = [sum(y == k for _, y in docs) for k in (0, 1)]
    memo: dict[str, list[str]] = {}
    for words, y in docs:
        own = set()
        for w in set(words):
            own.update(memo.setdefault(w, features(w)))
        seen[y].update(own)
    odds = {f: np.log((n + 0.5) / (number[1] + 1)) - np.log((seen[0][f] + 0.5) / (number[0] + 1)) for f, n in seen[1].items() if n >= LEAST_DOCS}
    kept = {f: k for k, f in enumerate(sorted(f for f, o in odds.items() if o >= KEEP_ODDS))}
    names = list(kept)
    strength = {w: max((odds[f] for f in fs if f in kept), default=-9.0) for w, fs in memo.items()}
    ids = {w: [kept[f] for f in fs if f in kept] for w, fs in memo.items()}
    chains = [(words[i : i + CHAIN], y) for words, y in docs for i in range(0, len(words), CHAIN)]
    n = len(chains)
    if not n or not kept:
        return Crf({}, -8.0, np.zeros((2, 2)), np.array([-2.0, 0.0, 0.0, 0.0, 0.0]))
    length = np.array([len(c) for c, _ in chains])
    order = np.argsort(-length, kind="stable")
    chains, length = [chains[i] for i in order], length[order]
    gold = np.zeros((n, CHAIN), np.int8)
    cell, feature = array("q"), array("i")
    for r, (words, y) in enumerate(chains):
        for c, w in enumerate(words):
            if ids[w]:
                cell.extend([r * CHAIN + c] * len(ids[w]))
                feature.extend(ids[w])
                gold[r, c] = y and strength[w] >= TAG_ODDS
    cell, feature = np.frombuffer(cell, np.int64), np.frombuffer(feature, np.int32)
    blocks = [_Block(length, gold, cell, feature, i) for i in range(0, n, BLOCK)]
    x = np.concatenate([np.zeros(len(kept)), [-4.0], np.zeros(4)])
    m, v = np.zeros_like(x), np.zeros_like(x)
    scale = 1.0 / max(1, int(gold.sum()))
    for step in range(1, ROUNDS + 1):
        grad = sum(b.gradient(x) for b in blocks)
        grad[: len(kept)] -= 0.5 * x[: len(kept)]
        grad *= scale
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad**2
        x = x + 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-6)
    crf = Crf({f: float(x[k]) for f, k in kept.items() if x[k]}, float(x[len(names)]), x[len(names) + 1 :].reshape(2, 2), np.zeros(5))
    table = np.array([crf.summary(crf.marginals(crf.evidence(words))[1], len(words)) for words, _ in docs])
    y = np.array([y for _, y in docs], float)
    whole = [(drawn_from or {}).get(k, number[k]) for k in (0, 1)]
    share = [w / max(1, sum(whole)) / max(1, k) * len(docs) for w, k in zip(whole, number)]  # 1.0 for both where nothing is capped
    weight = np.where(y > 0, share[1], share[0])
    beta = np.zeros(5)
    for _ in range(25):  # Newton's steps, lightly damped
        p = 1 / (1 + np.exp(-np.clip(table @ beta, -30, 30)))
        h = (table * (weight * p * (1 - p))[:, None]).T @ table + 0.05 * np.eye(5)
        beta = beta + np.linalg.solve(h, table.T @ (weight * (y - p)) - 0.05 * beta)
    crf.calibration = beta
    crf.memo = {}
    return crf


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(texts and labels of at most SAMPLE_DOCS documents of each label and SAMPLE_CHARS characters, none of them held out; the number of
    documents of each label that they are drawn from).

    Only rows whose crc32(doc_id as text) mod 4 is not 2 are read; those with the least hashes of doc_id are taken.  A doc_id that several
    rows have counts once, with its least text.  Ids are chosen first, below a hash that about twice the wanted number lies under, so that
    neither the driver nor a shuffle gets texts that are not in the sample, however many partitions there are.
    """
    open_ = columns(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic in (0, 1)").where("crc32(cast(doc_id as string)) % 4 != 2").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = columns(docs, doc_id="long", text="string").where(F.length("text") <= SAMPLE_CHARS)
    both = saved(texts.select("doc_id").distinct().join(open_, "doc_id").withColumn("h", F.xxhash64("doc_id")))
    chosen = []
    whole = {r.toxic: r.n for r in both.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    for label, n in sorted(whole.items()):
        rows = both.where(F.col("toxic") == label)
        few = rows.where(F.col("h") < (1 << 64) * 2 * SAMPLE_DOCS // n - (1 << 63)) if n > 2 * SAMPLE_DOCS else rows
        got = few.orderBy("h", "doc_id").limit(SAMPLE_DOCS).collect()
        if len(got) < min(n, SAMPLE_DOCS):
            got = rows.orderBy("h", "doc_id").limit(SAMPLE_DOCS).collect()
        chosen += [(r.doc_id, r.toxic) for r in got]
    if not chosen:
        return [], whole
    # At most 2 * SAMPLE_DOCS ids: small enough to broadcast.
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    return [(r.text, r.toxic) for r in found.orderBy("toxic", F.xxhash64("doc_id"), "doc_id").toLocalIterator()], whole


def score(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, score, spans for each row of docs; null and empty texts have the score of a text without evidence and no spans."""
    shared = docs.sparkSession.sparkContext.broadcast((crf.weights, crf.bias, crf.transitions, crf.calibration))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64())]))

    def run(batches):
        model = Crf(*shared.value)
        for b in batches:
            got = [model.tag(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s for s, _ in got], pa.float64()), pa.array([x for _, x in got], spans)], names=["doc_id", "score", "spans"])

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,stop:long,probability:double>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans: a row for each row of docs.

    A null doc_id is not held out.  Repeated rows score alike.  A text of any length is scored whole.  Without labels of both kinds every score is the same.
    """
    prepare(docs.sparkSession)
    rows = score(docs, train(*training_sample(docs, labels)))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= PREDICT, 1).otherwise(0).alias("predicted"), "spans")
