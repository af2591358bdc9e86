"""Cross-tokenizer alignment: tokens of two tokenizers linked where their byte ranges end together, and counted over the corpus."""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .common import columns, gathered, joined, prepare, saved

#: Units whose alignment a worker remembers before it starts anew (about 100 MB), and the longest one that is remembered.
MEMORY, LONGEST = 300_000, 64
#: Units that are tokenized and merged end to end.
RUN = 5000
#: Pairs up to which their counts are broadcast (about 50 MB); more are joined by a shuffle, with the same result.
MOST_PAIRS = 1_000_000
#: Fixed value: the split of byte-level tokenizers.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_HEX = re.compile(r"<0x([0-9A-F]{2})>")


def merged_ends(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> tuple[list[str], list[tuple[int, int]], bool]:
    """(groups, links, whole) of two runs of tokens by the byte ends of each: two pointers that move on at the smaller end.

    A group is what lies between two ends that both have; tokens of no bytes at such an end all link.  whole: both runs end together.
    """
    groups, links, i, j, from_a, from_b = [], [], 0, 0, 0, 0
    while i < len(a) and j < len(b):
        if ends_a[i] < ends_b[j]:
            i += 1
        elif ends_b[j] < ends_a[i]:
            j += 1
        else:
            at, k, m = ends_a[i], i + 1, j + 1
            while k < len(a) and ends_a[k] == at:
                k += 1
            while m < len(b) and ends_b[m] == at:
                m += 1
            links += [(x, y) for x in a[i:k] for y in b[j:m]]
            groups.append(",".join(map(str, a[from_a:k])) + "|" + ",".join(map(str, b[from_b:m])))
            i, j, from_a, from_b = k, m, k, m
    return groups, links, i == len(a) and j == len(b)


def _ranked(spec: dict, names: dict[int, bytes]):
    """The faster library's encoder of a byte-level vocabulary whose ids follow its merges; None for any other."""
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    vocab = spec["model"]["vocab"]
    ordered = len({len(names[i]) for i in range(256)} | {1}) == 1 and all(vocab[x + y] == 256 + k for k, (x, y) in enumerate(merges)) and len(names) == 256 + len(merges)
    plain = spec.get("normalizer") is None and spec["pre_tokenizer"].get("use_regex", True) and spec["pre_tokenizer"]["type"] == "ByteLevel"
    if not ordered or not plain:
        return None
    return tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks={t: i for i, t in names.items()}, special_tokens={}).encode_ordinary


def _library(path: str):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class Aligner:
    """Alignments of whole texts, unit by unit.

    A unit is a stretch of space+text that begins with a space behind a character that is no white space, or at the text's start.  Both
    tokenizers cut there: the first one's split never joins such a space to what stands before it, and the second one has no piece with a
    space behind another character (looked up when loaded; else texts are one unit).  So each different unit is tokenized and merged once,
    many of them end to end as one text.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["id"] for t in spec["added_tokens"]}
        names = {i: bytes(back[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in added}
        self.bytes_a = [names.get(i, b"\xff\xff") for i in range(max(names) + 1)]
        self.encode_a = _ranked(spec, names) or _library(path_a)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _HEX.fullmatch(p)) and self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.cut = spec["pre_tokenizer"]["type"] == "ByteLevel" and not any(re.search("[^▁]▁", p) for p in pieces)
        self.space = self.b.piece_to_id("▁")
        #: What an id gives to a group's text: an A id and "," or, at the group's end, "|"; a B id and "," or ";".
        self.said = [f"{i}{c}" for n, c in ((len(names), ","), (len(names), "|"), (len(pieces), ","), (len(pieces), ";")) for i in range(n)] if len(names) == len(self.bytes_a) else []
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []  # a unit's groups, each with a ";" behind it
        self.figures = np.zeros((0, 4), np.int64)  # tokens of A and B, groups, links; A's are -1 where the bytes differ
        self.links, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, units: list[str]) -> None:
        """Tokenizes and merges units, each of which begins with a space."""
        closed = [u for u in units if not u[-1].isspace()]
        open_ends = [u for u in units if u[-1].isspace()]  # these can't stand before another unit
        found = [x for run in [*(closed[i : i + RUN] for i in range(0, len(closed), RUN)), *([u] for u in open_ends)] for x in self.merge(run)]
        figures = np.concatenate([f for f, _, _ in found])
        self.start = np.concatenate([self.start, len(self.links) + np.cumsum(figures[:, 3]) - figures[:, 3]])
        self.figures, self.links = np.concatenate([self.figures, figures]), np.concatenate([self.links, *(x for _, _, x in found)])
        self.known.update(zip([*closed, *open_ends], range(len(self.groups), len(self.groups) + len(units))))
        for _, groups, _ in found:
            self.groups += groups

    def merge(self, units: list[str]) -> list[tuple[np.ndarray, list[str], np.ndarray]]:
        """(figures, groups, links) of runs of the units.

        Tokens of all units are merged by their ends at once: a stable sort of two sorted runs moves two pointers over them.
        """
        text = "".join(units)
        raw = text.encode("utf-8", "surrogatepass")
        a = np.array(self.encode_a(text), np.int64)
        b = np.array(self.b.encode(text[1:], num_threads=1) if len(text) > 1 else [self.space], np.int64)  # an empty text would get no prefix
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != raw:
            if len(units) == 1:
                return [(np.array([[-1, 0, 0, 0]]), [""], np.zeros(0, np.int64))]
            half = len(units) // 2
            return self.merge(units[:half]) + self.merge(units[half:])
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.cumsum([len(u.encode("utf-8", "surrogatepass")) for u in units])
        cut_a, cut_b = (np.searchsorted(ends, cuts, side="right") for ends in (ends_a, ends_b))
        if not self.said or not self.size_a[a].all() or not self.size_b[b].all():  # tokens without bytes, or ids with holes
            return self._merge_each(a, b, ends_a, ends_b, cut_a, cut_b)
        both = np.concatenate([ends_a, ends_b])
        order = np.argsort(both, kind="stable")
        same = np.flatnonzero(both[order[1:]] == both[order[:-1]])
        last_a, last_b = order[same], order[same + 1] - len(a)
        shared = ends_a[last_a]
        links = a[last_a] << 32 | b[last_b]
        n_groups = np.diff(np.searchsorted(shared, cuts, side="right"), prepend=0)
        figures = np.stack([np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0), n_groups, n_groups], axis=1)
        code_a, code_b = a.copy(), b + 2 * len(self.bytes_a)
        code_a[last_a] += len(self.bytes_a)
        code_b[last_b] += len(self.bytes_b)
        rank = np.concatenate([2 * np.searchsorted(shared, ends_a), 2 * np.searchsorted(shared, ends_b) + 1])
        said = list(map(self.said.__getitem__, np.concatenate([code_a, code_b])[np.argsort(rank, kind="stable")].tolist()))
        at = [0, *(cut_a + cut_b).tolist()]
        return [(figures, ["".join(said[i:j]) for i, j in zip(at, at[1:])], links)]

    def _merge_each(self, a, b, ends_a, ends_b, cut_a, cut_b) -> list[tuple[np.ndarray, list[str], np.ndarray]]:
        out, i, j = [], 0, 0
        for k, m in zip(cut_a.tolist(), cut_b.tolist()):
            groups, links, _ = merged_ends(a[i:k].tolist(), b[j:m].tolist(), ends_a[i:k].tolist(), ends_b[j:m].tolist())
            out.append((np.array([[k - i, m - j, len(groups), len(links)]]), ["".join(f"{g};" for g in groups)], np.array([x << 32 | y for x, y in links], np.int64)))
            i, j = k, m
        return out

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(codes, ends, units): the units of all texts as places in the list of different ones; ends[i] is behind text i's last."""
        if not self.cut:
            different = list(dict.fromkeys(texts.to_pylist()))
            place = {t: i for i, t in enumerate(different)}
            return np.array([place[t] for t in texts.to_pylist()], np.int64), np.arange(1, len(texts) + 1), [" " + t for t in different]
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        codes, ends, different = words.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py(), words.dictionary.to_pylist()
        open_end = np.array([w == "" or w[-1].isspace() for w in different], bool)
        glued = open_end[codes]  # a space behind this part begins no unit, so the next part belongs to it
        glued[ends - 1] = False
        if not glued.any():
            return codes, ends, [" " + w for w in different]
        place = {w: i for i, w in enumerate(different)}
        head = np.flatnonzero(~np.concatenate([[False], glued[:-1]]))
        sizes = np.diff(np.append(head, len(codes)))
        out = codes[head]
        for i in np.flatnonzero(sizes > 1).tolist():
            whole = " ".join(different[c] for c in codes[head[i] : head[i] + sizes[i]].tolist())
            out[i] = place.setdefault(whole, len(place))
        return out, np.searchsorted(head, ends), [" " + w for w in place]

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
        """Of each text its figures (tokens of A and B, groups, links), digest and links; zeros, '' and none where it has no tokens.  Texts are not null."""
        if len(self.groups) > MEMORY:
            self.clear()
        codes, ends, different = self.units(texts)
        new = [u for u in different if u not in self.known]
        if new:
            self.learn(new)
        place = np.array([self.known[u] for u in different], np.int64)[codes]
        bounds = np.concatenate([[0], ends])
        figures = self.figures[place]
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(figures, axis=0)])
        total = sums[bounds[1:]] - sums[bounds[:-1]]
        bad = np.concatenate([[0], np.cumsum(figures[:, 0] < 0)])
        none = (bad[bounds[1:]] > bad[bounds[:-1]]) | (np.asarray(pc.binary_length(texts)) == 0)
        links = gathered(self.links, self.start[place], figures[:, 3])
        cuts = sums[bounds, 3]
        digests, own = [], []
        for i, skip in enumerate(none.tolist()):
            if skip:
                digests.append("")
                own.append(links[:0])
                continue
            groups = "".join(map(self.groups.__getitem__, place[bounds[i] : bounds[i + 1]].tolist()))[:-1]
            digests.append(hashlib.sha256(groups.encode()).hexdigest())
            own.append(links[cuts[i] : cuts[i + 1]])
        total[none] = 0
        for u in [u for u in different if len(u) > LONGEST]:  # a long unit is rarely met again
            self.known.pop(u, None)
        return total, digests, own


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each row of docs, written once: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and times (its different linked
    id pairs, as a's id times 2^32 plus b's, and how often it has each)."""

    def run(batches):
        aligner = _aligner(path_a, path_b)
        for keys, texts in joined(batches):
            figures, digests, links = aligner.align(pc.fill_null(texts, ""))
            found = [np.unique(x, return_counts=True) for x in links]
            offsets = np.cumsum([0, *(len(p) for p, _ in found)]).astype(np.int32)
            pairs, times = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(figures[:, k]) for k in range(4)), pa.array(digests, pa.string()), *lists], names=["doc_id", *_FIGURES, "groups_sha256", "pairs", "times"])

    schema = f"doc_id long, {', '.join(f'{n} long' for n in _FIGURES)}, groups_sha256 string, pairs array<long>, times array<int>"
    return saved(columns(docs, doc_id="long", text="string").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (links that hold it in all rows), best_a and best_b (the highest n of a pair with its A id, and with its B id)."""
    pairs = rows.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").cast("long").alias("n"))
    pairs = saved(pairs.withColumn("a", F.shiftright("pair", 32)).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    tops = [pairs.groupBy(side).agg(F.max("n").alias(f"best_{side}")) for side in "ab"]
    return pairs.join(tops[0], "a").join(tops[1], "b")


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a.

    path_a: a byte-level .json of the tokenizers library; path_b: a sentencepiece .model, on every executor.  n_best counts links whose pair
    is its B id's most frequent, n_best_a its A id's, ties included; count_sum adds the counts of all links' pairs.  Null and empty texts,
    and those whose tokens' bytes are not space+text, have zeros and '', and no part in the counts.  Repeated rows count as rows; a null
    doc_id stays null; an empty table has no rows.
    """
    prepare(docs.sparkSession)
    rows = aligned(docs, path_a, path_b)
    counts = saved(pair_counts(rows).select("pair", "n", (F.col("n") == F.col("best_b")).alias("top_b"), (F.col("n") == F.col("best_a")).alias("top_a")))
    if counts.count() <= MOST_PAIRS:
        counts = F.broadcast(counts)
    links = rows.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair").join(counts, "pair")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("top_b"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("n") * F.col("times")).cast("long").alias("count_sum"), F.sum(F.when(F.col("top_a"), F.col("times")).otherwise(0)).cast("long").alias("n_best_a"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("row", "doc_id", *_FIGURES, "groups_sha256").join(sums, "row", "left").select("doc_id", *_FIGURES, zero("n_best"), zero("count_sum"), "groups_sha256", zero("n_best_a"))
