"""Masked pseudo-likelihood of documents under a bidirectional window network."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame, functions as F

from .common import coded, columns, gathered, joined, numbered, prepare, saved

#: Words known by name (the most frequent), classes of the two-step output, buckets that all other words share by hash.
NAMED, CLASSES, BUCKETS = 1984, 32, 64
SIZE = NAMED + BUCKETS  # the outputs; SIZE / CLASSES in a class
#: Words on either side that predict the one between, and the widths of the network.
SIDE, EMBED, HIDDEN = 2, 16, 32
#: Rounds over all documents after which weights are averaged, tokens of a step, and its size.
ROUNDS, BATCH, RATE = 1, 4096, 0.05
#: Unnamed tokens, the most frequent first, whose shares of their buckets every worker has (16 bytes each); those of the others are joined.
SHARED = 1 << 17
#: Tokens that are scored at once, and weights of a row in which shards' weights are shuffled.
BLOCK, SLICE = 8_192, 8_192

_words = re.compile(r"\w+|[^\w\s]").findall
_marked = re.compile(r"\w+|[^\w\s]|\n").findall
_INSIDE = SIZE // CLASSES


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of word characters and single other characters; none for null."""
    return _words((text or "").lower())


def token_hashes(different: list[str]) -> np.ndarray:
    """What tokens are known by: 64 bits of SipHash, signed."""
    out = np.empty(len(different), object)
    out[:] = different
    return hash_array(out, categorize=False).view(np.int64)


def tokenised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, ends, hashes): the tokens of some texts, end to end, as places in the hashes of their different tokens; ends[i] is text i's last place.

    No token crosses white space, so each different word between white space is looked at once.
    """
    words, ends, different = coded(texts)
    parts = _marked("\n".join([*different, ""]).lower())
    known = dict.fromkeys(["\n", *parts])
    known.update(zip(known, range(-1, len(known) - 1)))
    places = np.fromiter(map(known.__getitem__, parts), np.int32, len(parts))
    real = places >= 0
    edge = np.concatenate([[0], np.cumsum(real)[~real]])
    size = np.diff(edge)[words]
    codes = gathered(places[real], edge[:-1][words], size)
    del known["\n"]
    return codes, np.concatenate([[0], np.cumsum(size)])[ends], token_hashes(list(known))


class Ids:
    """Ids of tokens by their hashes: named ones, and hash buckets for the rest; SIZE is what is beyond a text's ends.

    shares: log P(token | bucket) of the tokens after the named ones, in order of their hashes.
    """

    def __init__(self, named: np.ndarray, shared: np.ndarray, shares: np.ndarray):
        self.order = np.argsort(named, kind="stable")
        self.named, self.shared, self.shares = named[self.order], shared, shares

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.named, hashes)
        hit = np.zeros(len(hashes), bool)
        hit[at < len(self.named)] = self.named[at[at < len(self.named)]] == hashes[at < len(self.named)]
        out = (NAMED + bucket_of(hashes)).astype(np.int32)
        out[hit] = self.order[at[hit]]
        return out

    def share(self, hashes: np.ndarray) -> np.ndarray:
        """log P(token | bucket) of unnamed tokens; NaN where it isn't shared."""
        out = np.full(len(hashes), np.nan)
        at = np.searchsorted(self.shared, hashes)
        ok = np.flatnonzero(at < len(self.shared))
        ok = ok[self.shared[at[ok]] == hashes[ok]]
        out[ok] = self.shares[at[ok]]
        return out


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.uint64) % np.uint64(BUCKETS)


SHAPES = {"embed": (SIZE + 1, EMBED), "w1": (2 * SIDE * EMBED, HIDDEN), "b1": (HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wi": (CLASSES, HIDDEN, _INSIDE), "bi": (CLASSES, _INSIDE)}


def start(counts: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The untrained network: without its sides, an output is as likely as its counts (and one more each) make it."""
    rng = np.random.default_rng(7)
    model = {k: (rng.normal(0, 0.1, s) if len(s) > 1 and k != "bi" else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}
    if counts is not None:
        table = np.log(counts.reshape(_INSIDE, CLASSES).T + 1.0)
        model["bi"], model["bc"] = table.astype(np.float32), np.log(np.exp(table).sum(axis=1)).astype(np.float32)
        model["bc"] -= model["bc"].max()
        model["bi"] -= model["bi"].max(axis=1, keepdims=True)
    return model


def pack(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def contexts(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The SIDE ids before and after each position of texts that stand end to end."""
    n = len(ids)
    first = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0))
    last = np.repeat(ends, np.diff(ends, prepend=0))
    at = np.arange(n)
    out = np.full((n, 2 * SIDE), SIZE, np.int32)
    for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        to = at + d
        inside = (to >= first) & (to < last)
        out[inside, k] = ids[to[inside]]
    return out


def _hidden(model: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.take(model["embed"], context, axis=0).reshape(len(context), -1)
    return e, np.tanh(e @ model["w1"] + model["b1"])


def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order, runs): rows ordered by the target's class, and (class, first, end) of each class that has rows."""
    order = np.argsort((target % CLASSES).astype(np.uint16), kind="stable")
    cuts = np.searchsorted((target % CLASSES)[order], np.arange(CLASSES + 1)).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place.  Weights stay far from where exponentials of float32 end."""
    np.exp(x, out=x)
    x *= (1 / (x @ np.ones(x.shape[1], x.dtype)))[:, None]
    return x


def log_probabilities(model: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(target | both sides): the target's class, then the target within it.  Classes take every CLASSES-th id."""
    out = np.empty(len(target))
    for i in range(0, len(target), BLOCK):
        order, runs = _by_class(target[i : i + BLOCK])
        goal = target[i : i + BLOCK][order]
        _, h = _hidden(model, np.take(context[i : i + BLOCK], order, axis=0))
        every = np.arange(len(goal))
        x = h @ model["wc"]
        x += model["bc"]
        got = x[every, goal % CLASSES] - np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))
        for c, a, b in runs:
            x = h[a:b] @ model["wi"][c]
            x += model["bi"][c]
            got[a:b] += x[every[: b - a], goal[a:b] // CLASSES] - np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))
        out[i + order] = got
    return out


def train(model: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, state: dict) -> None:
    """One step of Adagrad on a batch, in place."""
    n = len(target)
    order, runs = _by_class(target)
    context, target = np.take(context, order, axis=0), target[order]
    e, h = _hidden(model, context)
    group, member, every = target % CLASSES, target // CLASSES, np.arange(n)
    pc = h @ model["wc"]
    pc += model["bc"]
    _softmax(pc)
    pc[every, group] -= 1
    dh = pc @ model["wc"].T
    grads = {"wc": h.T @ pc, "bc": pc.sum(0), "wi": np.zeros_like(model["wi"]), "bi": np.zeros_like(model["bi"])}
    for c, a, b in runs:
        p = h[a:b] @ model["wi"][c]
        p += model["bi"][c]
        _softmax(p)
        p[every[: b - a], member[a:b]] -= 1
        np.dot(h[a:b].T, p, out=grads["wi"][c])
        p.sum(axis=0, out=grads["bi"][c])
        dh[a:b] += p @ model["wi"][c].T
    h *= h
    np.subtract(1, h, out=h)
    dh *= h
    grads["w1"], grads["b1"] = e.T @ dh, dh.sum(0)
    de = (dh @ model["w1"].T).reshape(-1, EMBED)
    flat = context.ravel().astype(np.uint16)
    by_id = np.argsort(flat, kind="stable")
    ids = flat[by_id]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    grads["embed"] = np.zeros_like(model["embed"])
    grads["embed"][ids[first]] = np.add.reduceat(np.take(de, by_id, axis=0), first, axis=0)
    for k, g in grads.items():
        g /= np.float32(np.sqrt(n))
        if k not in state:
            state[k] = np.full_like(g, 1e-6)
        state[k] += g * g
        model[k] -= np.float32(RATE) * g / np.sqrt(state[k])


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)


_TABLE = pa.schema([("doc_ids", pa.list_(pa.int64())), ("ends", pa.binary()), ("codes", pa.binary()), ("hashes", pa.binary())])


def token_table(docs: DataFrame) -> DataFrame:
    """The tokens of all documents, written once: a row is some documents' ids and what tokenised() gives for them (longs, but codes are ints)."""

    def run(batches):
        for doc_ids, texts in joined(batches):
            codes, ends, hashes = tokenised(texts)
            yield pa.RecordBatch.from_arrays([pa.array([doc_ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (ends, codes.astype(np.int32), hashes))], schema=_TABLE)

    return saved(columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_ids array<long>, ends binary, codes binary, hashes binary"))


def _read(batches):
    """(doc_ids, codes, ends, hashes) of each row."""
    for b in batches:
        for k in range(b.num_rows):
            ends, codes, hashes = (np.frombuffer(b.column(c)[k].as_buffer(), t) for c, t in (("ends", np.int64), ("codes", np.int32), ("hashes", np.int64)))
            yield b.column("doc_ids")[k].values, codes, ends, hashes


def vocabulary(table: DataFrame) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(hashes of the NAMED most frequent tokens over every document, equal counts in order of their hash; each output's count; w, n and bucket of all
    other tokens)."""

    def count(batches):
        held, size = [], 0

        def flush():
            w, n = _counted(held)
            return pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], names=["w", "n"])

        for _, codes, _, hashes in _read(batches):
            held.append((hashes, np.bincount(codes, minlength=len(hashes))))
            size += len(hashes)
            if size > 1_000_000:  # what has been counted is joined; if that is still long, it goes on, and the grouped sum joins it
                held = [_counted(held)]
                size = len(held[0][0])
                if size > 500_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = saved(table.select("doc_ids", "ends", "codes", "hashes").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "w").limit(NAMED).toPandas()
    if len(top) < NAMED:
        others = counts.limit(0)
    else:
        n, w = int(top.n.iloc[-1]), int(top.w.iloc[-1])
        others = counts.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("w") > w)))
    others, each = others.withColumn("bucket", F.expr(f"pmod(w, {BUCKETS})")), np.zeros(SIZE)
    each[: len(top)] = top.n
    for r in others.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        each[NAMED + r.bucket] = r.n
    return top.w.to_numpy(np.int64), each, others


def within_buckets(others: DataFrame) -> DataFrame:
    """w, n, and as p log P(token | bucket) of the unnamed tokens: a token's count in its bucket's and one more, which all unseen tokens share."""
    sums = others.groupBy("bucket").agg(F.sum("n").alias("total"))
    return others.join(F.broadcast(sums), "bucket").select("w", "n", F.log(F.col("n") / (F.col("total") + 1)).alias("p"))


def fit(table: DataFrame, named: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The network after some rounds in which each partition trains on all its documents and the weights are averaged by tokens.

    Weights move as SLICE-long rows, summed in two grouped steps, so no task holds those of all partitions; the driver receives one model.
    """
    spark = table.sparkSession
    ids = spark.sparkContext.broadcast(Ids(named, np.zeros(0, np.int64), np.zeros(0)))
    flat = pack(start(counts))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(flat)

        def learn(batches):
            model, state, done = unpack(shared.value.copy()), {}, 0
            rng = np.random.default_rng(turn)
            for _, codes, ends, hashes in _read(batches):
                own = ids.value.of(hashes)[codes]
                context = contexts(own, ends)
                for some in np.array_split(rng.permutation(len(own)), max(1, round(len(own) / BATCH))) if len(own) else []:
                    train(model, np.take(context, some, axis=0), own[some], state)
                done += len(own)
            if done:
                w = pack(model).astype(np.float64) * done
                parts = [w[a : a + SLICE].tobytes() for a in range(0, len(w), SLICE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([zlib.crc32(parts[0]) % 64] * len(parts), pa.int32()), pa.array([float(done)] * len(parts)), pa.array(parts, pa.binary())], names=["part", "salt", "n", "w"])

        def add(batches):
            total: dict[tuple, list] = {}
            for b in batches:
                for part, n, w in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), b.column("w").to_pylist()):
                    got = total.setdefault(part, [0.0, 0.0])
                    got[0] += n
                    got[1] = got[1] + np.frombuffer(w)
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([x[0] for x in total.values()], pa.float64()), pa.array([x[1].tobytes() for x in total.values()], pa.binary())], names=["part", "salt", "n", "w"])

        kind = "part int, salt int, n double, w binary"
        rows = table.mapInArrow(learn, kind).repartition("part", "salt").mapInArrow(add, kind).repartition("part").mapInArrow(add, kind).collect()
        if not rows:
            break
        flat = np.concatenate([np.frombuffer(r.w) / r.n for r in sorted(rows, key=lambda r: r.part)])
    return unpack(flat)


def scores(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, log_likelihood (summed over the tokens, each given both sides), mean.

    An unnamed token has its bucket's probability times its own share of the bucket.  Null and empty texts have no tokens, a sum of 0 and a
    null mean.  Repeated rows score alike.  A text of any length is scored whole.  An empty table has no rows.
    """
    spark = prepare(docs.sparkSession)
    table = token_table(docs)
    named, counts, others = vocabulary(table)
    rare = within_buckets(others)
    often = rare.orderBy(F.desc("n"), "w").limit(SHARED).select("w", "n", "p").toPandas().sort_values("w")
    shared = spark.sparkContext.broadcast((Ids(named, often.w.to_numpy(np.int64), often.p.to_numpy(float)), fit(table, named, counts)))

    def run(batches):
        ids, model = shared.value
        for doc_ids, codes, ends, hashes in _read(batches):
            each, share = ids.of(hashes), np.zeros(len(hashes))
            unnamed = each >= NAMED
            share[unnamed] = ids.share(hashes[unnamed])
            asked = np.isnan(share)  # by a join
            share[asked] = 0
            own = each[codes]
            got = np.concatenate([[0.0], np.cumsum(log_probabilities(model, contexts(own, ends), own) + share[codes])])
            n, size = np.diff(ends, prepend=0), max(1, len(hashes))
            place = np.flatnonzero(asked[codes])
            pairs, k = np.unique(np.repeat(np.arange(len(n)), n)[place] * size + codes[place], return_counts=True)
            at = np.searchsorted(pairs, np.arange(len(n) + 1) * size)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), x) for x in (pa.array(hashes[pairs % size]), pa.array(k.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(n), pa.array(np.diff(got[np.concatenate([[0], ends])])), *lists], names=["doc_id", "n_tokens", "named", "w", "k"])

    # The network runs once: both its parts are read from one table.
    found = numbered(saved(table.mapInArrow(run, "doc_id long, n_tokens long, named double, w array<long>, k array<int>")))
    asked = found.select("row", F.explode(F.arrays_zip("w", "k")).alias("x")).select("row", F.col("x.w").alias("w"), F.col("x.k").alias("k"))
    shares = asked.join(rare, "w").groupBy("row").agg(F.sum(F.col("k") * F.col("p")).alias("p"))
    ll = F.col("named") + F.coalesce("p", F.lit(0.0))
    return found.drop("w", "k").join(shares, "row", "left").select("doc_id", "n_tokens", ll.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, ll / F.col("n_tokens")).alias("mean"))
