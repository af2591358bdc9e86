"""SimHash near-duplicates through a segment-popcount embedding."""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import columns, components, fresh, lower_words, numbered, prepare

#: Bit ranges of the five groups of two-bit segments; two differing bits touch at most two, so three are always equal.
GROUPS = ((0, 14), (14, 28), (28, 40), (40, 52), (52, 64))
#: Cells of more fingerprints than this are joined by shared neighbours instead of pair by pair.
CROWD = 48
_LOW = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bits(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of hashes; runs are not empty."""
    ones = np.empty((len(starts), 64), np.int64)
    for k in range(8):  # a byte of the hash at a time bounds memory
        byte = ((hashes >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
        ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(np.unpackbits(byte[:, None], axis=1, bitorder="little"), starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_texts(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """Fingerprints (uint64) of whole texts: bit i is set if it is in over half the shingles' XXH64 hashes (seed 42)."""
    digest, hashes, counts = partial(xxhash.xxh64_intdigest, seed=42), [], []
    for text in texts:
        w = lower_words(text)
        n = max(len(w) - shingle + 1, min(len(w), 1))
        own = map(digest, map(b" ".join, zip(*(w[i:] for i in range(shingle))))) if len(w) >= shingle else map(digest, [b" ".join(w)] * n)
        hashes.append(np.fromiter(own, np.uint64, n))
        counts.append(n)
    out, n = np.zeros(len(texts), np.uint64), np.array(counts, np.int64)
    if n.sum():
        full = n > 0
        out[full] = _bits(np.concatenate(hashes), (np.cumsum(n) - n)[full], n[full])
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and fp (the fingerprint as a signed long), a row for each row of docs."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fingerprint_texts(b.column("text").to_pylist(), shingle).view(np.int64))], names=[*keep, "fp"])

    rows = docs.select(*keep, "text")
    return rows.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in rows.dtypes[:-1]) + ", fp long")


def thermometer(fp: Column) -> Column:
    """Each two-bit segment's popcount in unary: the Manhattan distance of popcounts is the bit_count of the xor of two of these."""
    low, high = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) whose connected components are those of all fingerprints at 2 or fewer differing bits.

    distinct: one column fp, each value once.  A cell is three equal groups of segment popcounts; cells of up to CROWD members are joined pair
    by pair, filtered by the Manhattan distance of all segment popcounts (never above the Hamming distance) and verified on the bits.
    Members of larger cells emit themselves and their 64 neighbours: two fingerprints are at distance 2 or less exactly if they share one of
    those, and all that share one are linked with each other, so a star to the least replaces the pairs.  Rows grow linearly with a group.
    """
    masks = [_signed(sum(((1 << b) - (1 << a)) for a, b in three)) for three in combinations(GROUPS, 3)]
    cells = distinct.withColumn("pop", thermometer(F.col("fp"))).select("fp", "pop", F.explode(F.array(*(F.struct(F.lit(i).alias("combo"), F.col("pop").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)))).alias("k")).select("k.combo", "k.cell", "fp", "pop")
    sizes = cells.groupBy("combo", "cell").agg(F.count("*").alias("n")).where("n > 1")
    live = cells.join(sizes, ["combo", "cell"]).checkpoint()
    small = live.where(F.col("n") <= CROWD)
    other = small.select("combo", "cell", F.col("fp").alias("fq"), F.col("pop").alias("poq"))
    pairs = small.join(other, ["combo", "cell"]).where("fp < fq").where(F.bit_count(F.col("pop").bitwiseXOR(F.col("poq"))) <= 2).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fq"))) <= 2)
    crowd = live.where(F.col("n") > CROWD).select("fp").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))
    near = crowd.select("fp", F.explode(flips).alias("ball"))
    heads = near.groupBy("ball").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(heads, "ball").where("fp > head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    return pairs.select(F.col("fp").alias("a"), F.col("fq").alias("b")).unionByName(stars).distinct()


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root): root is the least fingerprint reachable over links, for every distinct fingerprint that has one."""
    return components(links(prints.select("fp").distinct()))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """A row for each row of docs: doc_id, fp, component_id (the least doc_id reachable at 2 or fewer bits a step).

    Null and empty texts have fingerprint 0 and link like any other.  Repeated rows each get a row.  A null doc_id is never the least; a
    component of such rows alone has a null id.
    """
    prepare(docs.sparkSession)
    prints = fingerprints(columns(docs, doc_id="long", text="string"), shingle).checkpoint()
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = classes(prints)
    named = least.join(roots, least.fp == roots.node, "left").select(least.fp.alias("fp"), F.coalesce("root", least.fp).alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs without near-duplicates: of each component the row with the least (doc_id, place) stays, all its columns unchanged.

    Null and empty texts are one component.  Repeated rows are copies.  A null doc_id is never the least, if another is there.  A caller's
    column names are free.
    """
    prepare(docs.sparkSession)
    (place,) = fresh(docs, "place")
    keyed = numbered(docs, place)
    prints = fingerprints(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(place).alias("row"), F.col("text").cast("string").alias("text")), shingle, ("doc_id", "row")).checkpoint()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row")).alias("first")
    best, roots = prints.groupBy("fp").agg(first), classes(prints)
    merged = best.join(roots, best.fp == roots.node, "left").groupBy(F.coalesce("root", best.fp).alias("root")).agg(F.min("first").alias("first"))
    return keyed.join(merged.select(F.col("first.row").alias(place)), place, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def op6(docs: DataFrame) -> DataFrame:
    """The contract's digest of near_duplicates."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
