"""Helpers the training-data operators share: checkpoints, Arrow batches, words and connected components."""

from __future__ import annotations

import tempfile
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of an Arrow batch that holds whole texts: bounds what a Python worker holds at once.
TEXT_ROWS = 512
#: Bytes of text whose words are coded at once; a longer text is coded alone.
SLICE_BYTES = 4 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches (rows and bytes, in session settings) and makes sure that checkpoint() has a folder.

    The folder is the cluster's ``spark.checkpoint.dir``.  Only a local session without one, as in tests, gets a temporary folder: on a cluster
    that folder would be on one machine, so a session without the setting is refused.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * SLICE_BYTES))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vestige-checkpoint-"))
    return spark


def saved(df: DataFrame) -> DataFrame:
    """df, written as a compressed table into the shared checkpoint folder and read back: what a checkpoint does, in less space."""
    path = f"{prepare(df.sparkSession).sparkContext.getCheckpointDir()}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most files whose paths are broadcast to number a scan's rows (about 2 MB of paths).
MOST_FILES = 10_000
#: Bits of a row's number that hold its place in its file.
_PLACE_BITS = 38


def _one_parquet_scan(plan) -> bool:
    """Whether the plan is one scan of Parquet files below projections and filters that give the same rows whenever they run."""
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.child()
    if plan.nodeName() != "LogicalRelation":
        return False
    relation = plan.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and "Parquet" in relation.fileFormat().getClass().getSimpleName()


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """df with a number for each row, the same in every branch and every job of a plan, whatever the cores, splits or lost executors.

    A row of Parquet files has its file's rank among all paths and its place in that file, however the file is split.  Anything else (a
    shuffle, Python code, a sample, a table in memory, another format, more files than MOST_FILES) is written once into the shared folder,
    and its numbers with it.
    """
    if _one_parquet_scan(df._jdf.queryExecution().analyzed()):
        path, place, rank = fresh(df, "scan_file", "scan_place", "scan_rank")
        keyed = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
        paths = sorted(r[0] for r in keyed.select(path).distinct().limit(MOST_FILES + 1).collect())
        if 0 < len(paths) <= MOST_FILES:
            ranks = df.sparkSession.createDataFrame(list(zip(paths, range(len(paths)))), f"`{path}` string, `{rank}` long")
            number = F.shiftleft(F.col(rank), _PLACE_BITS).bitwiseOR(F.col(place))
            return keyed.join(F.broadcast(ranks), path).select(*(F.col(f"`{c}`") for c in df.columns), number.alias(name))
    return saved(df.withColumn(name, F.monotonically_increasing_id()))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """The named columns alone, so that a caller's extra columns can't clash with an operator's own."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in wanted.items()))


def lower_words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words between ASCII white space; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def text_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(first, part) over runs of texts of about that many bytes; a longer text may end one."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    run = (np.cumsum(size) - size) // most
    cuts = [*np.flatnonzero(np.diff(run, prepend=-1)).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield a, texts.slice(a, b - a)


def joined(batches, most: int = SLICE_BYTES):
    """(doc_ids, texts) of batches of (doc_id, text), joined or cut to about that many bytes of text."""
    held, size = [], 0
    for b in batches:
        for i, texts in slices(b.column("text"), most):
            if held and size + texts.nbytes > most:
                yield tuple(map(pa.concat_arrays, zip(*held)))
                held, size = [], 0
            held.append((b.column("doc_id").slice(i, len(texts)), texts))
            size += texts.nbytes
    if held:
        yield tuple(map(pa.concat_arrays, zip(*held)))


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes, ends, words): the words between ASCII white space of all texts as places in the list of different words; ends[i] is text i's last place.

    Null texts have no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten().dictionary_encode()
    codes, ends, different = words.indices.to_numpy(), lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py(), words.dictionary.to_pylist()
    if "" in different:  # white space at either end of a text
        real = codes != different.index("")
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        codes = codes[real]
    return codes, ends.astype(np.int64), different


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[starts[i] : starts[i] + sizes[i]] for all i, end to end."""
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(pool)) < 1 << 31 else np.int64
    return pool[np.repeat((starts - ends + sizes).astype(kind), sizes) + np.arange(n, dtype=kind)]


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root): root is the least node of each connected component of the edges (a, b), both of one type that has an order.

    Alternating large-star and small-star rounds; a round is two grouped minima and two equi-joins, and its edges go to the shared
    checkpoint folder, so lineage stays short and lost executors cost one round.  Nodes in no edge don't appear.  Nulls and loops are dropped.
    """
    e = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("lo < hi").distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        e = small.select("e.lo", "e.hi").where("lo < hi").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
