"""Graded links, components, reachability, look-alike names, matching in rounds and points, against plain loops, with nulls, ties, repeats and none."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from vestige.functions import ladder as L, text as T
from vestige.operators import graphs as G, joins as J, names as N


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def union_find(edges):
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return sorted(((x, top(x)) for x in up), key=repr)


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 500)] + [(7, 900), (900, 901), (1000, 1001), (5, 5), (2000, 2000)], [(random.Random(k).randrange(300), random.Random(k + 1).randrange(300)) for k in range(0, 400, 2)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges + edges[:3], "a long, b long").unionByName(spark.createDataFrame([(None, 1), (3, None)], "a long, b long"))
    assert found(G.components(df)) == union_find(edges)


def test_components_of_nothing(spark):
    assert G.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_reachable_with_cycles_and_a_wide_node(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (None, 9), (4, None), (1, 2), *((4, 100 + i) for i in range(2000)), (150, 7)]
    s = spark.createDataFrame([(1,), (1,), (None,), (77,)], "source long")
    got = found(G.reachable(spark.createDataFrame(edges, "a long, b long"), s, 64))
    assert got == sorted([(1, 2, 1), (1, 3, 2), (1, 1, 3), (1, 4, 3), *((1, 100 + i, 4) for i in range(2000)), (1, 7, 5)], key=repr)
    assert found(G.reachable(spark.createDataFrame(edges, "a long, b long"), s, 2)) == [(1, 2, 1), (1, 3, 2)]
    assert G.reachable(spark.createDataFrame([], "a long, b long"), s, 3).count() == 0


def entries(seed):
    draw, rows = random.Random(seed), []
    for _ in range(160):
        case, kind = f"c{draw.randrange(9)}", draw.choice(["session", "agent", "call", "destination", "principal", "commit"])
        key = f"a-key-that-is-long-{kind}-{draw.randrange(6)}"
        first = draw.choice([None, *range(0, 40)]) if kind != "call" else 1
        rows.append((case, draw.choice([f"p{draw.randrange(3)}", None]), kind, key, f"{case}/{draw.randrange(3)}", first, None if first is None else first + draw.randrange(6)))
    return rows + [("c1", "p", "session", "short", "x", 1, 2), ("c2", "p", "session", "short", "y", 5, 6), ("c1", "p", "call", "123456789012345", "x", 1, 1), ("c2", "p", "call", "123456789012345", "y", 1, 1), ("c1", "p", "session", None, "x", 1, 1), (None, "p", "session", "a-key-that-is-long-session-1", "x", 1, 1), ("c1", "p", "other", "a-key-that-is-long", "x", 1, 1)]


ENTRY = "case string, place string, kind string, key string, node string, first long, last long"


def pairs(rows):
    """All pairs of cases that share a key, with their grade."""
    held = {}
    for case, _, kind, key, node, first, last in rows:
        if case is None or key is None or kind not in G.GRADES or len(key) < G.GRADES[kind][1] or (kind == "call" and key.isdigit()):
            continue
        h = held.setdefault((kind, key), {}).setdefault(case, [node, first, last])
        h[0] = min(h[0], node)
        h[1] = first if h[1] is None else h[1] if first is None else min(h[1], first)
        h[2] = last if h[2] is None else h[2] if last is None else max(h[2], last)
    for (kind, key), cases in held.items():
        for (_, a), (_, b) in itertools.combinations(sorted(cases.items()), 2):
            grade = G.GRADES[kind][0]
            if kind in G.COPIED_KINDS and a[1] is not None and b[1] is not None and a[2] >= b[1] and b[2] >= a[1]:
                grade = "moderate"
            yield kind, key, len(cases), grade, a[0], b[0]


@pytest.mark.parametrize("seed", range(4))
def test_grades_and_places(spark, seed):
    rows = entries(seed)
    df = spark.createDataFrame(rows + rows[:5], ENTRY)
    count = {}
    for kind, key, n, grade, *_ in pairs(rows):
        count.setdefault((kind, key, n), dict(strong=0, moderate=0, weak=0))[grade] += 1
    assert found(G.grades(df)) == sorted(((*k, c["strong"], c["moderate"], c["weak"]) for k, c in count.items()), key=repr)
    strong = [(a, b) for kind, _, _, grade, a, b in pairs(rows) if kind in G.AGENT_KINDS and grade == "strong"]
    assert found(G.components(G.strong_links(df))) == union_find(strong)
    roots, want = dict(union_find(strong)), []
    for root in sorted(set(roots.values())):
        nodes = {n for n, r in roots.items() if r == root}
        own = [r for r in rows if r[4] in nodes and r[2] in G.AGENT_KINDS]
        places = {}
        for case, place, _, _, node, *_ in own:
            places.setdefault((node, case), []).append(place)
        named = {min((p for p in ps if p is not None), default=None) or f"case:{case}" for (_, case), ps in places.items() if case is not None or any(ps)}
        cases = {c for c, *_ in own if c is not None}
        timed = [(r[5], r[0]) for r in own if r[5] is not None and r[0] is not None]
        if len(named) >= 2 and len(cases) >= 2:
            want.append((root, len(nodes), len(cases), len(named), min(timed)[1] if timed else min(cases), min(timed)[0] if timed else None))
    assert found(G.across_places(df.where("case is not null"))) == sorted(want, key=repr)


def test_a_hub_key_makes_a_link_for_each_case(spark):
    df = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("case"), F.lit("p").alias("place"), F.lit("session").alias("kind"), F.lit("one-session-for-all").alias("key"), F.concat(F.lit("n"), "id").alias("node"), F.col("id").alias("first"), F.col("id").alias("last"))
    assert G.strong_links(df).count() <= 3000
    assert found(G.grades(df)) == [("session", "one-session-for-all", 3000, 3000 * 2999 // 2, 0, 0)]


def osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_osa(spark):
    draw = random.Random(1)
    rows = [("", ""), ("", "abc"), ("ab", ""), ("ca", "abc"), ("abcd", "badc"), *(("".join(draw.choice("abcé") for _ in range(draw.randrange(8))), "".join(draw.choice("abcé") for _ in range(draw.randrange(8)))) for _ in range(300))]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.osa(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == osa(r.a, r.b) for r in got) and len(got) == len(rows)


def folded(s):
    for a, b in (("-", ""), ("_", ""), (".", ""), ("0", "o"), ("1", "l"), ("rn", "m"), ("vv", "w")):
        s = s.lower().replace(a, b)
    return s


@pytest.mark.parametrize("most", [1, 2])
def test_look_alikes(spark, most):
    draw = random.Random(most)
    known = ["@owner/server-github", "mcp-remote", "@owner/tool", "fetch-server", "abc", "rnodern-lib"]
    specs = [None, "", "MCP-Remote@1.0", "mcp-rem0te", "mcp-remtoe==2", "mcp-rmote", "mcprremotee", "@evil/mcp-remote", "@owner/anything", "server-github", "@ovvner/server-github", "modern-lib", "abd", "git+https://x", "https://x/mcp-remote", "@evil/tool", "tool", "fetch-server", "fetch_server"]
    specs += ["".join(c for c in w if draw.random() > 0.1) + draw.choice(["", "x", "1"]) for w in known for _ in range(15)]
    names = {(s or "").lower() for s in specs}
    names = {n[: n.index("==")] if "==" in n[1:] else n for n in names}
    names = {n[: n.index("@", 1)] if "@" in n[1:] else n for n in names}
    part = lambda n: tuple(n.split("/", 1)) if n.startswith("@") and "/" in n else ("", n)
    want = []
    for n in names:
        if not n or n in known or n.startswith("git+") or "://" in n or part(n)[0] in {part(k)[0] for k in known} - {""}:
            continue
        best = []
        for k in known:
            d, (s, b), (ks, kb) = osa(n, k), part(n), part(k)
            if s != ks and len(kb) >= 4 and (b == kb or folded(b) == folded(kb)):
                best.append((1, k, d))
            elif folded(n) == folded(k):
                best.append((2, k, d))
            elif len(n) >= 6 and d <= most:
                best.append((3, k, d))
        if best:
            r, k, d = min(best)
            want.append((n, k, ("scope", "fold", "edit")[r - 1], d))
    got = found(N.look_alikes(spark.createDataFrame([(s,) for s in specs], "spec string"), spark.createDataFrame([(k,) for k in known], "name string"), most))
    assert got == sorted(want, key=repr) and {r[2] for r in got} == {"scope", "fold", "edit"}


def greedy(calls, records, window, score):
    pairs = sorted((-score(c, r), abs(c[2] - r[2]), c[1], r[1], c[0]) for c in calls for r in records if None not in (c[0], c[1], c[2], r[1], r[2]) and c[0] == r[0] and abs(c[2] - r[2]) <= window and score(c, r) > 0)
    taken, held, out = set(), set(), []
    for s, _, c, r, k in pairs:
        if (k, c) not in taken and (k, r) not in held:
            taken.add((k, c))
            held.add((k, r))
            out.append((k, c, r, -s))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rounds", [0, 1, 12])
def test_best_matches_in_rounds(spark, rounds, monkeypatch):
    monkeypatch.setattr(J, "ROUNDS", rounds)
    draw = random.Random(rounds)
    calls = [(draw.choice([1, 2]), i, draw.choice([None, *range(120)]), draw.randrange(4)) for i in range(60)] + [(None, 900, 5, 1), (3, 901, 5, 1)]
    calls += [(5, 1000 + i, 1000 + 20 * i, 1) for i in range(30)]
    records = [(draw.choice([1, 2]), i, draw.choice([None, *range(120)]), draw.randrange(4)) for i in range(60)] + [(None, 910, 5, 1), (3, None, 5, 1)]
    records += [(5, 2000 + i, 1010 + 20 * i - i % 7, 1) for i in range(30)]  # a long run in which each match hangs on its neighbour's
    c, r = spark.createDataFrame(calls, "k long, call_id long, at long, v int"), spark.createDataFrame(records, "k long, record_id long, seen long, w int")
    got = found(J.best_matches(c, r, "k", F.when(F.col("v") == F.col("w"), 100).when(F.col("w") == 3, 0).otherwise(60), 15))
    assert got == greedy(calls, records, 15, lambda a, b: 100 if a[3] == b[3] else 0 if b[3] == 3 else 60) and len(got) > 40
    assert J.best_matches(c.limit(0), r, "k", F.lit(1), 15).count() == 0


def test_points(spark):
    rows = [
        ("git  status", " git status ", 100, None), ("ls -la", "/bin/sh -c 'ls -la'", 90, None), ("git commit -m a", "git commi", 70, None), ("git commit -m a", "git com", 0, None), ("/usr/bin/Git.EXE push origin", "git push origin x", 60, None),
        ("cd /x && make all", "/usr/bin/make all", 0, None), ("cd /x && make all -j", "/bin/make -j all", 60, None), ("", "x", 0, None), (None, "x", 0, None), ("a", None, 0, None), ("a b c d e", "a x y z w", 0, None),
    ]
    got = spark.createDataFrame(rows, "a string, b string, p int, x string").select("a", "b", "p", L.process_points(F.col("a"), F.col("b")).alias("g"), L.basis(F.lit("process"), L.process_points(F.col("a"), F.col("b"))).alias("s")).collect()
    assert [(r.a, r.g) for r in got] == [(r.a, r.p) for r in got]
    assert got[0].s.confidence == "HIGH" and got[-1].s is None and got[4].s.basis == "same program with most arguments shared"
    paths = [("C:\\x\\A.txt", "c:/X/a.txt", 80), ("x/a.txt", "/srv/x/a.txt", 80), ("/srv/x/a.txt", "a.txt", 80), ("ba.txt", "a.txt", 0), ("", "a", 0), (None, "a", 0), ("a", None, 0)]
    got = spark.createDataFrame(paths, "a string, b string, p int").select("p", L.file_points(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r.p == r.g for r in got)
    hosts = [("Example.com", "10.0.0.1", "api.example.com", 80), ("10.0.0.1", "10.0.0.1", None, 80), ("example.com", "1.1.1.1", "badexample.com", 0), ("", "1", "", 0), (None, "1", "x", 0), ("x", None, None, 0)]
    got = spark.createDataFrame(hosts, "a string, b string, c string, p int").select("p", L.network_points(F.col("a"), F.col("b"), F.col("c")).alias("g")).collect()
    assert all(r.p == r.g for r in got)
