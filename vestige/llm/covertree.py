"""Embedding near-duplicates by dual traversal of cover trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, prepare

#: Vectors in a block (a task holds two), most centres that a label's blocks are dealt by (one for each full block below that), members below which a node is not split.
BLOCK, CENTRES, LEAF = 2048, 64, 16
#: Kept between bounds and the threshold, for rounding.
SLACK = 1e-7


class CoverTree:
    """Nested levels over unit vectors, from radius 2 down by halves; each node has its point, its exact covering radius and its members.

    A node's point is its first child's point.  The next children are the first members that no child's radius covers yet.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.point, self.radius, self.members, self.children = [], [], [], []
        if len(x):
            stack = [(self.node(0, np.arange(len(x))), 1.0)]
            while stack:
                at, r = stack.pop()
                members = self.members[at]
                if len(members) <= LEAF or self.radius[at] == 0:
                    continue
                if self.radius[at] <= r:  # the level has this node alone
                    stack.append((at, r / 2))
                    continue
                left, centre = members, self.point[at]
                while len(left):
                    near = self.distances(left, centre) <= r
                    near |= left == centre
                    child = self.node(int(centre), left[near])
                    self.children[at].append(child)
                    stack.append((child, r / 2))
                    left = left[~near]
                    centre = left[0] if len(left) else -1

    def distances(self, members: np.ndarray, centre: int) -> np.ndarray:
        return np.linalg.norm(self.x[members] - self.x[centre], axis=1)

    def node(self, point: int, members: np.ndarray) -> int:
        self.point.append(point)
        self.members.append(members)
        self.radius.append(float(self.distances(members, point).max()))
        self.children.append([])
        return len(self.point) - 1


class _Found:
    """Links by side and member: weights of linked partners, and a union-find over both sides' members."""

    def __init__(self, sizes: tuple[int, int]):
        self.count = [np.zeros(n, np.int64) for n in sizes]
        self.offset = (0, sizes[0])
        self.parent = list(range(sum(sizes)))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def dual(a: CoverTree, b: CoverTree, weights: tuple[np.ndarray, np.ndarray], threshold: float, same: bool) -> _Found:
    """All pairs of members with cosine at least threshold, each once (same: a and b are one tree, pairs of different members).

    A pair of nodes is dropped if their points are further apart than the threshold's distance plus both covering radii, and taken whole, without
    looking at members, if even the two radii added stay within it; else the larger is split, down to leaves, whose cosines are computed.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    found = _Found((len(a.x), 0 if same else len(b.x)))
    wa, wb = weights
    ra, rb = np.array(a.radius), np.array(b.radius)
    sb = 0 if same else 1

    def star(i: np.ndarray, j: np.ndarray) -> None:
        root = int(i[0])
        for k in i[1:].tolist():
            found.union(root, k)
        for k in j.tolist():
            found.union(root, found.offset[sb] + k)

    def whole(i: np.ndarray, j: np.ndarray, one: bool) -> None:
        if one:
            found.count[0][i] += wa[i].sum() - wa[i]
        else:
            found.count[0][i] += wb[j].sum()
            found.count[sb][j] += wa[i].sum()
        star(i, j)

    def leaves(i: np.ndarray, j: np.ndarray, one: bool) -> None:
        hit = a.x[i] @ b.x[j].T >= threshold
        if one:
            np.fill_diagonal(hit, False)
        found.count[0][i] += hit @ wb[j]
        if not one:
            found.count[sb][j] += wa[i] @ hit
        for r, c in np.argwhere(hit).tolist():
            found.union(int(i[r]), found.offset[sb] + int(j[c]))

    stack = [(0, 0)] if len(a.x) and len(b.x) else []
    while stack:
        m, n = stack.pop()
        one = same and m == n
        if one and 2 * ra[m] <= reach - SLACK:
            whole(a.members[m], b.members[n], True)
            continue
        ca, cb = a.children[m] or [m], b.children[n] or [n]
        if ca == [m] and cb == [n]:
            leaves(a.members[m], b.members[n], one)
            continue
        ca, cb = np.array(ca), np.array(cb)
        pa_, pb = a.x[[a.point[k] for k in ca]], b.x[[b.point[k] for k in cb]]
        d = np.sqrt(np.maximum(0, 2 - 2 * (pa_ @ pb.T)))
        keep = d <= reach + SLACK + ra[ca][:, None] + rb[cb][None, :]
        if one:
            keep = np.triu(keep)
        for r, c in np.argwhere(keep).tolist():
            x, y = int(ca[r]), int(cb[c])
            if not (same and x == y) and d[r, c] + ra[x] + rb[y] <= reach - SLACK:
                whole(a.members[x], b.members[y], False)
            else:
                stack.append((x, y))
    return found


def _clean(vectors: DataFrame) -> DataFrame:
    """vec_id, label and unit (null where the vector links with nothing)."""

    def run(batches):
        for b in batches:
            units = []
            for v, label in zip(b.column("embedding").to_pylist(), b.column("label").to_pylist()):
                x = np.array([np.nan if c is None else c for c in v], np.float64) if v and label is not None else np.zeros(0)
                top = np.abs(x).max(initial=0)
                if not len(x) or not np.isfinite(x).all() or top == 0:
                    units.append(None)
                else:
                    x = x / top
                    units.append((x / np.sqrt(x @ x) + 0.0).tolist())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "label", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label string, unit array<double>")


def _cells(reps: DataFrame) -> DataFrame:
    """reps with cell (number of the nearest of its label's centres) and away (the distance)."""
    keyed = reps.withColumn("h", F.xxhash64("rep"))
    some = keyed.groupBy("label", "dim").agg(F.least(F.lit(CENTRES), F.ceil(F.count("*") / BLOCK)).alias("k"))
    centres = keyed.join(some, ["label", "dim"]).groupBy("label", "dim", F.pmod("h", "k").alias("c")).agg(F.min_by("unit", F.struct("h", "rep")).alias("unit"))
    lists = centres.groupBy("label", "dim").agg(F.sort_array(F.collect_list(F.struct("c", "unit"))).alias("centres"))  # at most CENTRES

    def run(batches):
        memo = {}
        for b in batches:
            cell, away = [], []
            for label, dim, x, cs in zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), b.column("unit").to_pylist(), b.column("centres")):
                if (label, dim) not in memo:
                    memo[label, dim] = np.array([c["unit"] for c in cs.as_py()])
                d = np.linalg.norm(memo[label, dim] - np.array(x), axis=1)
                cell.append(int(d.argmin()))
                away.append(float(d.min()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(cell, pa.int32()), pa.array(away)], names=["label", "dim", "unit", "rep", "copies", "h", "cell", "away"])

    joined = keyed.join(lists, ["label", "dim"]).select("label", "dim", "unit", "rep", "copies", "h", "centres")
    return joined.mapInArrow(run, "label string, dim int, unit array<double>, rep long, copies long, h long, cell int, away double")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors (vec_id, embedding, label).

    Vectors are compared where labels (and lengths) are equal and not null.  Null, empty and zero vectors and those with null or non-finite
    parts link with nothing.  Equal directions are one representative with a number of copies, so groups of copies never meet pair by pair.
    Each label's representatives are dealt by their nearest of CENTRES centres into blocks of about BLOCK; pairs of blocks whose bounds leave
    room for a link are joined, each in its own task, by dual traversal, which returns counts and a spanning forest, not pairs.
    """
    prepare(vectors.sparkSession)
    clean = _clean(vectors).checkpoint()
    usable = clean.where(F.col("unit").isNotNull())
    groups = usable.groupBy("label", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    cells = _cells(groups.withColumn("dim", F.size("unit"))).checkpoint()
    sizes = cells.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"))
    dealt = cells.join(sizes, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.shiftright("h", 8), F.ceil(F.col("n") / BLOCK))).select("label", "dim", "unit", "rep", "copies", "away", F.struct("cell", "part").alias("block"), F.struct("h", "rep").alias("order")).checkpoint()
    # A block's bound: the distance of its members from its first one is at most twice that from the cell's centre.
    blocks = dealt.groupBy("label", "dim", "block").agg(F.min_by("unit", "away").alias("mid"), (F.max("away") + F.min("away")).alias("r"))
    other = blocks.select("label", "dim", F.col("block").alias("block2"), F.col("mid").alias("mid2"), F.col("r").alias("r2"))
    gap = F.sqrt(F.aggregate(F.zip_with("mid", "mid2", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
    pairs = blocks.join(other, ["label", "dim"]).where("block <= block2").where(gap <= F.col("r") + F.col("r2") + reach).select("label", "dim", "block", "block2")
    sides = pairs.select("*", F.explode(F.when(F.col("block") == F.col("block2"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side")).withColumn("at", F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("block2")))
    members = sides.join(dealt.withColumnRenamed("block", "at"), ["label", "dim", "at"]).select("label", "dim", "block", "block2", "side", "rep", "copies", "unit")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        halves = [pdf[pdf.side == s].sort_values("rep") for s in (0, 1)]
        same = len(halves[1]) == 0
        dim = len(pdf.unit.iloc[0])
        xs = [np.array(h.unit.tolist(), np.float64).reshape(len(h), dim) for h in halves]
        ws = [h.copies.to_numpy(np.int64) for h in halves]
        ids = [h.rep.to_numpy(np.int64) for h in halves]
        a = CoverTree(xs[0])
        b = a if same else CoverTree(xs[1])
        f = dual(a, b, (ws[0], ws[0] if same else ws[1]), threshold, same)
        every = np.concatenate([ids[0]] if same else ids)
        roots = every[[f.find(i) for i in range(len(every))]]
        out = pd.DataFrame({"rep": every, "n": np.concatenate([f.count[0]] if same else f.count), "root": roots})
        return out[(out.n > 0) | (out.root != out.rep)]

    # Not (block <= block2) in one group of all: a key for each pair of blocks, at most two blocks of rows.
    links = members.groupBy("label", "dim", "block", "block2").applyInPandas(join, "rep long, n long, root long").checkpoint()
    counts = links.groupBy("rep").agg(F.sum("n").alias("others"))
    roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = groups.select("label", "unit", "rep", "copies").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("label", "unit", F.coalesce("root", "rep").alias("root"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return clean.join(named, ["label", "unit"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"), F.coalesce(F.coalesce("root", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
