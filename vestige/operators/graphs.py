"""Graphs of rows: components, reachability, and links between cases graded by what they share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What two cases may share, its grade, and how long a key must be to count.
GRADES = {"session": ("strong", 8), "agent": ("strong", 8), "call": ("strong", 12), "commit": ("strong", 12), "file": ("strong", 1), "resource": ("strong", 1), "principal": ("moderate", 1), "environment": ("moderate", 1), "destination": ("weak", 1), "filename": ("weak", 1)}
#: Kinds that tie one agent's activity together, and those of them whose recordings are copies, not a continuation, if they overlap in time.
AGENT_KINDS, COPIED_KINDS = ("session", "agent", "call"), ("session", "agent")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder of spark.checkpoint.dir; a local session without one, as in tests, takes a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vestige-checkpoint-"))
    return df.checkpoint()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge (a, b): root is the least node that edges reach.  Edges with a null end are left out; a loop names its node.

    Each round joins every node's greater neighbours to the least node about it, then every node's lesser neighbours to their least, until
    each component is a star about its least node.  A round is two grouped minima, which are combined before the shuffle, and two equality
    joins in which a hub is one row for each neighbour; it ends in the checkpoint folder.  Rounds grow with the logarithm of a component's length.
    """
    given = cut(edges.select("a", "b").where("a is not null and b is not null").distinct())
    e, before = cut(given.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()), None
    for _ in range(most_rounds):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        either = e.select(F.col("high").alias("at"), F.col("low").alias("other")).unionByName(e.select(F.col("low").alias("at"), F.col("high").alias("other")))
        about = either.groupBy("at").agg(F.least(F.min("other"), F.col("at")).alias("least"))
        far = either.where("other > at").join(about, "at").select(F.col("other").alias("high"), F.col("least").alias("low")).where("low < high").distinct()
        under = far.groupBy("high").agg(F.min("low").alias("least"))
        both = far.join(under, "high").select(F.explode(F.array(F.struct(F.col("least").alias("low"), "high"), F.struct(F.col("least").alias("low"), F.col("low").alias("high")))).alias("e"))
        e = cut(both.select("e.low", "e.high").where("low < high").distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = given.select(F.col("a").alias("node")).unionByName(given.select(F.col("b").alias("node"))).distinct()
    return nodes.join(e.select(F.col("high").alias("node"), "low"), "node", "left").select("node", F.coalesce("low", "node").alias("root"))


def contracted(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, group) for every end of edges (a, b) of longs, loops left out: nodes of one component, and no others, share the long group.

    Each round points every node that has a lesser neighbour to its least one, and puts that in its place in all edges; edges within one
    node go, so a star about its least node is gone after a round.  Then numbers are dealt anew, by a hash that is one to one on longs, so
    that runs of rising numbers shrink too.  A round's edges are written, and the next one reads those alone.
    """
    turn, levels = F.xxhash64, []
    lesser = lambda a, b: [F.least(a, b).alias("low"), F.greatest(a, b).alias("high")]
    e = cut(edges.where("a <> b").select(*lesser("a", "b")).distinct())
    while not e.isEmpty():
        if len(levels) == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        levels.append(e)
        up = e.groupBy("high").agg(F.min("low").alias("to"))
        moved = e.join(up, "high").select("low", F.col("to").alias("other")).distinct()
        both = moved.join(up.withColumnRenamed("high", "low"), "low", "left").select(turn(F.coalesce("to", "low")).alias("a"), turn("other").alias("b")).where("a <> b")
        e = cut(both.select(*lesser("a", "b")).distinct())
    found = e.select(F.col("low").alias("node"), F.col("high").alias("group"))
    for n, e in enumerate(reversed(levels)):
        ends = e.select(F.col("high").alias("own"), "low").unionByName(e.select(F.col("low").alias("own"), "low")).groupBy("own").agg(F.min("low").alias("to"))
        last = F.col("to")
        for _ in range(n + 1):
            last = turn(last)
        found = ends.withColumn("next", turn("to")).join(found.withColumnRenamed("node", "next"), "next", "left").select(F.col("own").alias("node"), F.coalesce("group", last).alias("group"))
        found = cut(found) if n % 8 == 7 else found
    return found


def reachable(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """(source, node, hops) of nodes that edges (a, b) lead to from the sources (a column source) in at most depth hops, with the least hops.

    Breadth first: only what a round finds anew goes on, and a round is written, so cycles end and nothing is found twice.  A source is not
    its own result unless a cycle leads back to it.  Repeated edges and sources count once; nulls lead nowhere.
    """
    e = cut(edges.select("a", "b").where("a is not null and b is not null").distinct())
    front = sources.select("source").where("source is not null").distinct().withColumn("node", F.col("source"))
    found = None
    for hop in range(1, depth + 1):
        new = front.join(e, front.node == e.a).select("source", F.col("b").alias("node")).distinct()
        if found is not None:
            new = new.join(found.select("source", "node"), ["source", "node"], "left_anti")
        front = cut(new)
        if found is not None and front.isEmpty():
            break
        level = front.withColumn("hops", F.lit(hop))
        found = level if found is None else found.unionByName(level)
    return found if found is not None else front.withColumn("hops", F.lit(0)).where("false")


def held(entries: DataFrame, shortest: dict[str, int] | None = None) -> DataFrame:
    """One row for each case, kind and key that count: case, kind, key, node, first, last (of rows of case, kind, key, node, first, last).

    Kinds that are not in GRADES, keys that are null or too short and calls that are figures alone are left out.  A key's node in a case is
    the least one; its span is that of all its rows, unknown if no row has a time.  shortest: lengths that count of some kinds, where they
    are not those of GRADES.
    """
    known = F.create_map(*(x for kind, (_, n) in GRADES.items() for x in (F.lit(kind), F.lit((shortest or {}).get(kind, n)))))
    counts = (F.length("key") >= known[F.col("kind")]) & ~((F.col("kind") == "call") & F.rlike("key", F.lit("^[0-9]*$"))) & F.col("case").isNotNull() & F.col("node").isNotNull()
    return entries.where(counts).groupBy("case", "kind", "key").agg(F.min("node").alias("node"), F.min("first").alias("first"), F.max("last").alias("last"))


def _copied() -> Column:
    return F.col("kind").isin(*COPIED_KINDS)


def grades(entries: DataFrame, shortest: dict[str, int] | None = None) -> DataFrame:
    """Keys of at least two cases: kind, key, n_cases and the pairs of cases by grade (strong, moderate, weak).

    A strong pair of sessions or agents whose spans overlap is moderate; an unknown time overlaps nothing.  Pairs are counted, not made: those
    that don't overlap are, over all starts, the ends before them.
    """
    h = held(entries, shortest)
    sizes = h.groupBy("kind", "key").agg(F.count("*").alias("n_cases"), F.count("first").alias("timed")).where("n_cases > 1")
    spans = h.where(_copied()).where("first is not null").select("kind", "key", F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(0).alias("end")), F.struct(F.col("last").alias("at"), F.lit(1).alias("end")))).alias("p")).select("kind", "key", "p.*")
    before = F.sum("end").over(Window.partitionBy("kind", "key").orderBy("at", "end").rowsBetween(Window.unboundedPreceding, 0))
    apart = spans.withColumn("before", before).where("end = 0").groupBy("kind", "key").agg(F.sum("before").alias("apart"))
    pairs, timed = F.expr("n_cases * (n_cases - 1) div 2"), F.expr("timed * (timed - 1) div 2")
    grade = F.create_map(*(x for kind, (g, _) in GRADES.items() for x in (F.lit(kind), F.lit(g))))[F.col("kind")]
    over = F.when(_copied(), timed - F.coalesce("apart", F.lit(0))).otherwise(0)
    rows = sizes.join(apart, ["kind", "key"], "left").withColumn("pairs", pairs).withColumn("overlapping", over).withColumn("grade", grade)
    of = lambda g, n: F.when(F.col("grade") == g, n).otherwise(0).cast("long")
    return rows.select("kind", "key", "n_cases", of("strong", F.col("pairs") - F.col("overlapping")).alias("strong"), F.when(F.col("grade") == "moderate", F.col("pairs")).otherwise(F.col("overlapping")).cast("long").alias("moderate"), of("weak", F.col("pairs")).alias("weak"))


def strong_links(entries: DataFrame, kinds: tuple[str, ...] = AGENT_KINDS, shortest: dict[str, int] | None = None) -> DataFrame:
    """Edges (a, b) of nodes whose components are those of all strong pairs of cases that share a key of these kinds.

    At most one edge for each case that holds a key, however many hold it.  Sessions and agents: two spans that don't overlap are a strong
    pair.  The span that ends first, E, pairs with every one that starts after its end; any other overlaps E, and pairs with anything only if
    it ends before the last start, and so with that span.  Without times one of the untimed pairs with all.  Other kinds: the least node.
    """
    return _tied(_strong(entries, kinds, shortest))


def _strong(entries: DataFrame, kinds: tuple[str, ...], shortest: dict[str, int] | None) -> DataFrame:
    return held(entries.where(F.col("kind").isin(*kinds)), shortest).where(F.create_map(*(x for kind, (g, _) in GRADES.items() for x in (F.lit(kind), F.lit(g == "strong"))))[F.col("kind")])


def _tied(h: DataFrame) -> DataFrame:
    """The edges of strong_links from the keys held.  Of spans that end first or start last together, any is taken."""
    known = F.when(F.col("first").isNotNull(), F.col("node"))
    marks = h.groupBy("kind", "key").agg(
        F.count("*").alias("n"),
        F.min("node").alias("least"),
        F.min(F.when(F.col("first").isNull(), F.col("node"))).alias("untimed"),
        F.min(F.when(known.isNotNull(), F.col("last"))).alias("end"),
        F.min_by(known, F.when(known.isNotNull(), F.col("last"))).alias("early"),
        F.max("first").alias("start"),
        F.max_by("node", "first").alias("late"),
    ).where("n > 1")
    to = F.when(~_copied(), F.col("least")).when(F.col("untimed").isNotNull(), F.col("untimed")).when(F.col("first") > F.col("end"), F.col("early")).when(F.col("last") < F.col("start"), F.col("late"))
    return h.join(marks, ["kind", "key"]).select(F.col("node").alias("a"), to.alias("b")).where("b is not null and a <> b").distinct()


def _numbers(nodes: DataFrame):
    """A function of a column that gives each different node of nodes (a column node) a long of its own: a hash whose values are checked to be as many as the nodes."""
    for seed in range(9):
        number = lambda c, s=seed: F.xxhash64(c, F.lit(s))
        each = nodes.select(number("node").alias("id"), F.xxhash64(F.lit(seed), "node").alias("other")).groupBy("id").agg(F.min("other").alias("a"), F.max("other").alias("b"))
        if each.where("a <> b").isEmpty():
            return number
    raise RuntimeError("nodes could not be numbered")


def across_places(entries: DataFrame, shortest: dict[str, int] | None = None) -> DataFrame:
    """Groups of nodes tied by strong agent links that span at least two places and two cases: root, n_nodes, n_cases, n_places, first_case, first_at.

    entries also has place; a node without one counts its case as its place.  The first case is that of the earliest time, then the least.
    """
    agents = entries.where(F.col("kind").isin(*AGENT_KINDS) & F.col("node").isNotNull())
    number = _numbers(agents.select("node"))
    h = _strong(agents, AGENT_KINDS, shortest).withColumn("node", number("node"))
    groups = cut(contracted(_tied(h)))
    nodes = agents.withColumn("id", number("node")).groupBy("id", "case").agg(F.min("node").alias("node"), F.min("place").alias("place"), F.min("first").alias("first"))
    rows = groups.withColumnRenamed("node", "id").join(nodes, "id").withColumn("place", F.coalesce("place", F.concat(F.lit("case:"), F.col("case").cast("string"))))
    each = rows.groupBy("group", "case", "place").agg(F.min("node").alias("root"), F.min("first").alias("first"))
    first = F.min(F.when(F.col("first").isNotNull(), F.struct("first", "case")))
    out = each.groupBy("group").agg(F.min("root").alias("root"), F.count_distinct("case").alias("n_cases"), F.count_distinct("place").alias("n_places"), F.coalesce(first["case"], F.min("case")).alias("first_case"), first["first"].alias("first_at"))
    out = out.where("n_places >= 2 and n_cases >= 2").join(groups.groupBy("group").agg(F.count("*").alias("n_nodes")), "group")
    return out.select("root", "n_nodes", "n_cases", "n_places", "first_case", "first_at")
