"""The engine's own operators: their SQL twins, brute-force versions of what has none, readers, sinks and streams."""

import math
import random
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from vestige.functions import text as T
from vestige.operators import joins as J, windows as W
from vestige.plans import command_queries, queries as Q, rules as R, transcript_queries  # noqa: F401
from vestige.sinks import lines
from vestige.sources import telemetry
from vestige.streaming import live

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(spark, sql, name):
    df = Q.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*names).collect())
    rel = sql.execute(Q.SQL[name])
    at = [[d[0] for d in rel.description].index(n) for n in names]
    assert len(at) == len(rel.description)
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def test_chains(spark):
    rows = [("a", i, at, k) for i, (at, k) in enumerate([(0, "x"), (1, "x"), (2, "y"), (3, "z"), (4, "x"), (5, "y"), (40, "z"), (41, "x"), (42, "z"), (43, "y"), (44, "z")])] + [("b", 100, 0, "y"), ("b", 101, 1, "x")]
    df = spark.createDataFrame(rows, "s string, e long, at long, k string")
    chain = R.Chain("c", tuple(R.Step(F.col("k") == k) for k in "xyz"), 10)
    assert {tuple(r) for r in R.chain_matches(df, chain, "s", "at", "e").collect()} == {("a", "c", 0, 3), ("a", "c", 7, 10)}


def plain_chain(rows, steps, window, most):
    """Every start in order, and each step's first row behind the step before that qualifies."""
    rows, out, start = sorted(rows, key=lambda r: (r[1], r[0])), [], 0
    while start < len(rows) and (most is None or len(out) < most):
        path, shared = [start] if rows[start][2] == steps[0] else [], set(rows[start][3])
        for want in steps[1:] if path else ():
            for j in range(path[-1] + 1, len(rows)):
                if window and rows[j][1] - rows[start][1] > window:
                    break
                if rows[j][2] == want and shared & set(rows[j][3]):
                    path.append(j)
                    shared &= set(rows[j][3])
                    break
            else:
                break
            if rows[path[-1]][2] != want or (window and rows[path[-1]][1] - rows[start][1] > window):
                break
        whole = len(path) == len(steps)
        if whole:
            out.append((rows[path[0]][0], rows[path[-1]][0]))
        start = path[-1] + 1 if whole else start + 1
    return out


@pytest.mark.parametrize("window, most", [(9, None), (9, 3), (0, None), (40, 20)])
def test_chains_against_plain_loops(spark, window, most):
    draw = random.Random(window)
    rows = [(s, i, draw.randrange(400), draw.choice("xyyz"), draw.sample("abc", draw.randrange(3))) for i, s in enumerate(["a", "b", None] * 120)]
    df = spark.createDataFrame(rows + [("a", 999, None, "x", ["a"])], "s string, e long, at long, k string, l array<string>")
    chain = R.Chain("c", tuple(R.Step(F.col("k") == k) for k in "xyz"), window, "l")
    got = {}
    for r in R.chain_matches(df, chain, "s", "at", "e", most).collect():
        got.setdefault(r.s, []).append((r.first_event, r.last_event))
    for s in ("a", "b", None):
        assert sorted(got.get(s, [])) == sorted(plain_chain([r[1:] for r in rows if r[0] == s], "xyz", window, most))


def test_chain_steps_that_differ(spark):
    df = spark.createDataFrame([("s", 1, 1, "x", "m"), ("s", 2, 2, "y", "m"), ("s", 3, 3, "y", "n")], "s string, e long, at long, k string, who string")
    chain = R.Chain("c", (R.Step(F.col("k") == "x"), R.Step(F.col("k") == "y", "who")), 10)
    assert [tuple(r) for r in R.chain_matches(df, chain, "s", "at", "e").collect()] == [("s", "c", 1, 3)]


def test_best_matches_are_one_to_one(spark):
    calls = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 100), (1, 13, 300)], "k long, call_id long, at long")
    seen = spark.createDataFrame([(1, 20, 3), (1, 21, 4), (1, 22, 103), (1, 23, 304), (2, 24, 0)], "k long, record_id long, seen long")
    got = {tuple(r) for r in J.best_matches(calls, seen, "k", F.when((F.col("call_id") == 11) & (F.col("record_id") == 20), 100).otherwise(60), 3).collect()}
    assert got == {(1, 11, 20, 100), (1, 12, 22, 60)}


def test_similar(spark):
    import random

    random.seed(4)
    sets = [sorted({random.randrange(14) for _ in range(random.randint(1, 9))}) for _ in range(80)]
    df = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in enumerate(sets)], "id long, w array<string>")
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j])) - 1e-12}
    assert {(r.a, r.b) for r in J.similar(df, "id", "w", 0.8).collect()} == want


def test_ancestors(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(30)], "c long, p long")
    got = {tuple(r) for r in J.ancestors(chain, "c", "p", 16).collect()}
    assert got == {(i, j, i - j) for i in range(30) for j in range(i) if i - j <= 16}


def test_upper_median_and_gap_bounds(spark):
    e = spark.createDataFrame([(1, i, t * 1_000_000) for i, t in enumerate([0, 10, 20, 30, 930, 1829])], "s long, event_id long, u long").withColumn("ts", F.timestamp_micros("u"))
    assert [(r.event_id, r.gap_us, r.median_us) for r in W.silence_gaps(e, "s").collect()] == [(4, 900_000_000, 10_000_000)]
    assert spark.range(1).select(W.upper_median(F.array(*map(F.lit, [4, 1, 3, 2])))).first()[0] == 3


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values)))).select(column).first()[0]


def test_scalars(spark):
    v = F.col("v0")
    assert one(spark, T.url_host(v), "https://u:p@Ex.COM:8080/a") == "ex.com"
    assert one(spark, T.url_host(v), "http://[::1]:80/") == "::1"
    assert one(spark, T.url_host(v), "http://a%2eb/") is None and one(spark, T.url_host(v), "x") is None
    assert one(spark, T.destinations(v), "curl http://b.org/x https://a.org http://b.org") == ["b.org", "a.org"]
    assert one(spark, T.is_allowed(v, ("a.org",)), "x.a.org") and not one(spark, T.is_allowed(v, ("a.org",)), "xa.org")
    assert one(spark, T.host_key(v), "Web.local") == "web" and one(spark, T.host_key(v), "10.0.0.1") == "10.0.0.1"
    assert one(spark, T.executable(v), r"C:\x\Cmd.EXE") == "cmd"
    assert one(spark, T.refang(v), "hxxps://a[.]b") == "https://a.b"
    assert one(spark, T.version(v), "v1.2.3-rc1") == [1, 2, 3, 0]
    assert one(spark, T.redact(v, "[0-9]+", "n"), "a1b22") == "a[REDACTED:n:6b86b273]b[REDACTED:n:785f3ec7]"
    assert one(spark, T.redact(v, "[0-9]+", "n"), "none") == "none"
    assert one(spark, T.phrase(v, R.INJECTION_PHRASES), "Please Ignore previous instructions.") == "ignore previous instructions"
    assert one(spark, T.is_placeholder(v), "AKIAEXAMPLE") and one(spark, T.is_placeholder(v), "aaaaaa1") and not one(spark, T.is_placeholder(v), "abcabc")
    assert one(spark, T.printable(v), "a\x07b​c\n") == "abc\n"
    assert one(spark, F.unix_micros(T.epoch_time(v.cast("long"))), "1700000000123") == 1700000000123000
    assert one(spark, v.rlike(R.java_pattern("abc$")), "abc\n") is False


def test_readers(spark, tmp_path):
    samples = {
        "jsonl": '{"timestamp":"2024-01-01T00:00:00Z","image":"/bin/sh","command":"sh -c x","pid":7}',
        "falco": '{"output_fields":{"proc.name":"sh","proc.cmdline":"sh -c x","proc.pid":7},"rule":"r","time":"2024-01-01T00:00:00Z"}',
        "tetragon": '{"process_exec":{"process":{"pid":7,"binary":"/bin/sh","arguments":"-c x","uid":0}},"time":"2024-01-01T00:00:00Z"}',
        "docker": '{"status":"start","from":"img","Type":"container","time":1704067200,"timeNano":1704067200000000000}',
        "kubernetes": '{"verb":"get","objectRef":{"resource":"pods","name":"p"},"user":{"username":"u"},"requestReceivedTimestamp":"2024-01-01T00:00:00Z"}',
        "squid": "1704067200.000 5 10.0.0.1 TCP_MISS/200 10 GET http://a.org/x user DIRECT/- text/html",
        "auditd": 'type=SYSCALL msg=audit(1704067200.000:5): pid=7 auid=1000 exe="/bin/sh"\ntype=EXECVE msg=audit(1704067200.000:5): argc=2 a0="sh" a1="-c"',
        "csv": "Time,Image,PID\n2024-01-01T00:00:00Z,/bin/sh,7",
    }
    for name, text in samples.items():
        path = tmp_path / name
        path.write_text(text + "\n")
        r = telemetry.load(spark, str(path)).collect()
        assert len(r) == 1 and r[0].source == name and r[0].time.isoformat() == "2024-01-01T00:00:00", (name, r)


def test_sinks(spark):
    f = spark.createDataFrame([("R", "HIGH", "t", "2024-01-01 00:00:00")], "rule_id string, severity string, title string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert '"severity_id":4' in lines.ocsf_findings(f).first().value and '"time":1704067200000' in lines.ocsf_findings(f).first().value
    e = f.selectExpr("ts", "'m' as message", "'k' as kind", "'u' as user")
    assert len(lines.l2t_csv(e).columns) == 17 and "2024-01-01T00:00:00" in lines.timesketch(e).first().value
    assert lines.dot(spark.createDataFrame([("a", 'b"', "r")], "from string, to string, relation string")).first().value == '"a" -> "b\\"" [label="r"];'


def test_streams_agree_with_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.unionByName(rows).coalesce(1).write.json(str(tmp_path / "in"))  # every event arrives twice
    rules = [R.Rule("E", "LOW", contains=("error",))]
    found = {}
    for name, df in (("alerts", live.alerts(live.tail(spark, str(tmp_path / "in")), rules, "event_type", "60 days")), ("rates", live.rates(live.tail(spark, str(tmp_path / "in")), "user_id", "6 hours", "6 hours", 4))):
        table = f"{name}_{uuid.uuid4().hex}"
        q = df.writeStream.format("memory").queryName(table).outputMode("append" if name == "alerts" else "complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        found[name] = spark.table(table)
    assert found["alerts"].count() == rows.where("event_type = 'error'").count()
    want = rows.groupBy(F.window("ts", "6 hours").alias("w"), "user_id").agg((2 * F.count("*")).alias("n")).where("n >= 4")
    assert found["rates"].count() == want.count()


def test_order_statistic_is_no_mean(spark):
    from vestige.operators.aggregates import order_statistic

    df = spark.range(1, 21).withColumn("k", F.lit(1))
    assert order_statistic(df, "k", "id", 0.95).first().q == math.ceil(0.95 * 20)
