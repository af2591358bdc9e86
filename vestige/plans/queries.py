"""One query for each operator, on the tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import aggregates as A, joins as J, sessions as S, windows as W
from . import rules as R

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Windows.


@query("""WITH g AS (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events),
m AS (SELECT user_id, l[len(l) // 2 + 1] AS median_us FROM (SELECT user_id, list_sort(list(gap_us)) AS l FROM g WHERE gap_us > 0 GROUP BY user_id))
SELECT user_id, event_id, gap_us, median_us FROM g JOIN m USING (user_id) WHERE gap_us >= 900000000 AND gap_us >= 5 * median_us""")
def gap_sessions(spark, d):
    return W.silence_gaps(_t(spark, d, "events"), "user_id", times=5)


@query("SELECT user_id, event_id, back FROM (SELECT user_id, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) - value AS back FROM events) WHERE back > 60")
def regression_previous(spark, d):
    return W.regressions(_t(spark, d, "events"), "user_id", F.col("value"), "event_id", 60, False)


@query("SELECT user_id, event_id, back FROM (SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - value AS back FROM events) WHERE back > 100")
def regression_running(spark, d):
    return W.regressions(_t(spark, d, "events"), "user_id", F.col("value"), "event_id", 100, True)


_RATE = """WITH w AS (SELECT {k}, event_id, ts, count(*) OVER (PARTITION BY {k} ORDER BY epoch_us(ts) RANGE BETWEEN {s}000000 PRECEDING AND CURRENT ROW) AS n FROM events)
SELECT {k}, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ts, event_id) AS i FROM w WHERE n >= {n}) WHERE i = 1"""


@query(_RATE.format(k="user_id", s=21600, n=4))
def burst_rate(spark, d):
    return W.rate_hits(_t(spark, d, "events"), ["user_id"], 21600, 4)


@query(_RATE.format(k="user_id, event_type", s=43200, n=3))
def loop_repeat(spark, d):
    return W.rate_hits(_t(spark, d, "events"), ["user_id", "event_type"], 43200, 3)


@query("""WITH r AS (SELECT *, sum(CAST(event_type = 'signup' AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
w AS (SELECT a.user_id, a.run, a.event_id, a.ts, count(*) AS n, count(DISTINCT b.event_type) AS k FROM r a JOIN r b ON a.user_id = b.user_id AND a.run = b.run AND b.ts BETWEEN a.ts - INTERVAL 1 DAY AND a.ts WHERE a.event_type <> 'signup' AND b.event_type <> 'signup' GROUP BY ALL)
SELECT user_id, CAST(run AS BIGINT) AS run, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS i FROM w WHERE n >= 3 AND k >= 2) WHERE i = 1""")
def varied_runs(spark, d):
    return W.varied_runs(_t(spark, d, "events"), "user_id", F.col("event_type") == "signup", "event_type", 86400, 3, 2)


_MODES = ("view", "click", "signup", "purchase")


@query("""WITH m AS (SELECT *, coalesce(nullif(list_position(['view', 'click', 'signup', 'purchase'], event_type), 0) - 1, 4) AS r FROM events),
l AS (SELECT *, lag(r) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM m)
SELECT user_id, event_id, CAST(was AS INTEGER) AS was FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM l WHERE r = 3 AND was < 3) WHERE i = 1""")
def mode_rises(spark, d):
    return W.mode_rises(_t(spark, d, "events"), "user_id", T.rank(F.col("event_type"), _MODES), 3)


@query("""SELECT o_custkey, after, missing FROM (SELECT o_custkey, lag(o_orderkey) OVER w AS after, o_orderkey - lag(o_orderkey) OVER w - 1 AS missing FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE missing > 0""")
def sequence_gaps(spark, d):
    return W.sequence_gaps(_t(spark, d, "orders"), "o_custkey", "o_orderkey")


@query("""WITH l AS (SELECT user_id, epoch_us(ts) AS u, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 7200000000 THEN 1 ELSE 0 END AS x FROM events),
i AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY u) AS island FROM l) SELECT user_id, min(u) AS start_us, max(u) AS stop_us, count(*) AS n FROM i GROUP BY user_id, island""")
def activity_islands(spark, d):
    return W.islands(_t(spark, d, "events"), "user_id", 7200)


@query("""SELECT user_id, CAST(sum(CASE WHEN event_type IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) AS BIGINT) AS n_runs FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id""")
def content_runs(spark, d):
    return W.content_runs(_t(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS "trigger" FROM events""")
def asof_trigger(spark, d):
    return W.last_before(_t(spark, d, "events"), "user_id", F.col("event_type") == "error", "event_id", 200).select("user_id", "event_id", "trigger")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE event_type IN ('error', 'purchase')) WHERE event_type = 'purchase' AND p = 'error'""")
def precursor_then_action(spark, d):
    return R.precursor_then(_t(spark, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase")


# Joins.


@query("""WITH c AS (SELECT conv_id, min(turn) AS call FROM conversations WHERE role = 'user' GROUP BY conv_id), r AS (SELECT conv_id, min(turn) AS result FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT conv_id, call, result FROM c LEFT JOIN r USING (conv_id)""")
def pair_call_result(spark, d):
    c = _t(spark, d, "conversations")
    calls, results = (c.where(F.col("role") == r).select("conv_id", F.col("turn").alias(n)) for r, n in (("user", "call"), ("assistant", "result")))
    return J.pair_first(calls, results, ["conv_id"], ["call"], ["result"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphan_anti(spark, d):
    return J.orphans(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), ["doc_id"])


_SPAN = "SELECT user_id, event_id AS span_id, epoch_us(ts) - 1800000000 AS start, epoch_us(ts) + 1800000000 AS stop FROM events WHERE event_type = 'purchase'"


def _spans(e: DataFrame) -> DataFrame:
    u = W.micros()
    return e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), (u - 1_800_000_000).alias("start"), (u + 1_800_000_000).alias("stop"))


@query(f"SELECT event_id, span_id FROM events e JOIN ({_SPAN}) s ON e.user_id = s.user_id AND epoch_us(e.ts) BETWEEN start AND stop")
def interval_containment(spark, d):
    e = _t(spark, d, "events")
    return J.within_interval(e.select("user_id", "event_id", W.micros().alias("u")), _spans(e), "user_id", "u", "start", "stop", 3_600_000_000).select("event_id", "span_id")


@query(f"""WITH s AS (SELECT *, span_id % 2 = 0 AS healthy FROM ({_SPAN})), e AS (SELECT user_id, event_id, epoch_us(ts) AS u FROM events WHERE event_type <> 'purchase'),
t AS (SELECT event_id, bool_or(u - 600000000 >= start AND u + 600000000 <= stop AND healthy) AS w FROM e JOIN s ON e.user_id = s.user_id AND u BETWEEN start - 600000000 AND stop + 600000000 GROUP BY event_id)
SELECT event_id, CASE WHEN w THEN 'healthy' WHEN w IS NOT NULL THEN 'partial' ELSE 'none' END AS covered FROM e LEFT JOIN t USING (event_id)""")
def coverage_assess(spark, d):
    e = _t(spark, d, "events")
    points = e.where("event_type <> 'purchase'").select("user_id", "event_id", W.micros().alias("u"))
    return J.coverage(points, _spans(e).withColumn("healthy", F.col("span_id") % 2 == 0), "user_id", "u", 600_000_000, 4_800_000_000).select("event_id", "covered")


@query("""WITH RECURSIVE c AS (SELECT user_id AS u, event_id AS call, epoch_us(ts) AS called, value AS v FROM events WHERE event_type = 'click'), s AS (SELECT user_id AS u, event_id AS rec, epoch_us(ts) AS seen, value AS w FROM events WHERE event_type = 'view'),
p AS (SELECT u, call, rec, CASE WHEN abs(v - w) < 10 THEN 100 ELSE 60 END AS score, abs(seen - called) AS apart FROM c JOIN s USING (u) WHERE abs(seen - called) <= 7200000000),
r(u, call, rec, score, apart, taken) AS (SELECT *, false FROM p UNION ALL SELECT u, call, rec, score, apart, row_number() OVER (PARTITION BY u, call ORDER BY score DESC, apart, rec) = 1 AND row_number() OVER (PARTITION BY u, rec ORDER BY score DESC, apart, call) = 1
FROM r AS x WHERE NOT taken AND NOT EXISTS (SELECT 1 FROM r AS y WHERE y.taken AND y.u = x.u AND (y.call = x.call OR y.rec = x.rec)))
SELECT u AS user_id, call AS call_id, rec AS record_id, CAST(score AS BIGINT) AS score FROM r WHERE taken""")
def interval_best_match(spark, d):
    e = _t(spark, d, "events")
    calls = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("call_id"), W.micros().alias("at"), F.col("value").alias("v"))
    seen = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("record_id"), W.micros().alias("seen"), F.col("value").alias("w"))
    return J.best_matches(calls, seen, "user_id", F.when(F.abs(F.col("v") - F.col("w")) < 10, 100).otherwise(60), 7_200_000_000)


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_cases, count(*) AS n_rows FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2")
def crosscase_shared(spark, d):
    return J.shared_keys(_t(spark, d, "lineitem"), "l_partkey", "l_suppkey")


_IDS = "SELECT sha256(CAST(c_custkey AS VARCHAR)) AS full_id, substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 9) AS short_id FROM customer"


@query(f"WITH i AS ({_IDS}), p AS (SELECT s.short_id, f.full_id FROM i s JOIN i f ON starts_with(f.full_id, s.short_id)) SELECT * FROM p WHERE short_id IN (SELECT short_id FROM p GROUP BY 1 HAVING count(*) <= 16)")
def prefix_join(spark, d):
    full = _t(spark, d, "customer").select(F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256).alias("full_id"))
    return J.prefix_join(full.select(F.substring("full_id", 1, 9).alias("short_id")), full, "short_id", "full_id", 7, 16)


@query("""WITH p AS (SELECT doc_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS s FROM documents)
SELECT a, b, j AS jaccard FROM (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS j FROM p a JOIN p b ON a.id < b.id WHERE len(a.s) > 0 AND len(b.s) > 0 AND len(a.s) >= 0.8 * len(b.s) AND len(b.s) >= 0.8 * len(a.s)) WHERE j >= 0.8""")
def jaccard_similarity(spark, d):
    return J.similar(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), T.words(F.col("text")).alias("w")), "id", "w", 0.8)


@query("""WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), b AS (SELECT o_custkey + 7 AS k, min(o_orderkey) % 25 AS v FROM orders GROUP BY 1)
SELECT k, CASE WHEN a.k IS NULL THEN 'ADDED' WHEN b.k IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change FROM a FULL JOIN b USING (k) WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""")
def baseline_diff(spark, d):
    """Customers with their nations against customers of orders, counted on by 7, with a figure of their orders."""
    before = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    after = _t(spark, d, "orders").groupBy((F.col("o_custkey") + 7).alias("k")).agg((F.min("o_orderkey") % 25).alias("v"))
    return J.difference(before, after, "k", "v")


@query("""SELECT a.event_id, min(epoch_us(b.ts)) AS next_us FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND epoch_us(b.ts) > epoch_us(a.ts) AND epoch_us(b.ts) <= epoch_us(a.ts) + 86400000000 GROUP BY a.event_id""")
def launch_then_session(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "event_type", W.micros().alias("at"))
    left, right = e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").select("user_id", F.col("at").alias("next_us"))
    return J.followed_by(left, right, "user_id", "at", "next_us", 86_400_000_000).select("event_id", "next_us")


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS child, CASE WHEN s_suppkey > 1 THEN s_suppkey // 2 END AS parent FROM supplier), r AS (SELECT child, parent AS ancestor, 1 AS hops FROM p WHERE parent IS NOT NULL UNION ALL SELECT r.child, p.parent, hops + 1 FROM r JOIN p ON p.child = r.ancestor WHERE p.parent IS NOT NULL AND hops < 16)
SELECT child, ancestor, hops FROM r""")
def process_ancestry(spark, d):
    p = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("child"), F.expr("if(s_suppkey > 1, s_suppkey div 2, null)").alias("parent"))
    return J.ancestors(p, "child", "parent", 16)


# Aggregates.

_FINDINGS = "SELECT event_type AS rule_id, user_id AS session_id, CASE WHEN value > 80 THEN 'CRITICAL' WHEN value > 40 THEN 'HIGH' ELSE 'LOW' END AS severity, epoch_us(ts) AS ts, CAST(event_id AS VARCHAR) AS ref, event_id AS seq FROM events"


def _findings(e: DataFrame) -> DataFrame:
    severity = F.when(F.col("value") > 80, "CRITICAL").when(F.col("value") > 40, "HIGH").otherwise("LOW")
    return e.select(F.col("event_type").alias("rule_id"), F.col("user_id").alias("session_id"), severity.alias("severity"), W.micros().alias("ts"), F.col("event_id").cast("string").alias("ref"), F.col("event_id").alias("seq"))


@query(f"""WITH f AS ({_FINDINGS}) SELECT rule_id, session_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, min(seq) AS first_seq, array_to_string(list(ref ORDER BY seq)[1:5], ',') AS refs, CASE min(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 3 END) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS severity FROM f GROUP BY rule_id, session_id""")
def finding_groups(spark, d):
    return A.finding_groups(_findings(_t(spark, d, "events")))


@query("SELECT strftime(ts, '%Y-%m-%dT%H:%M') AS minute, count(*) AS n FROM events GROUP BY 1")
def minute_buckets(spark, d):
    return A.minute_buckets(_t(spark, d, "events"))


@query("SELECT l_suppkey, count(*) AS n, list_sort(list(l_extendedprice))[CAST(ceil(count(*) * 0.95) AS BIGINT)] AS q FROM lineitem GROUP BY l_suppkey")
def latency_p95(spark, d):
    return A.order_statistic(_t(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", 0.95)


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_members, array_to_string(list_sort(list_distinct(list(CAST(l_suppkey AS VARCHAR)))), ',') AS members FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2")
def distinct_per_artifact(spark, d):
    return A.spread_keys(_t(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS stop_us FROM events GROUP BY user_id")
def session_cards(spark, d):
    return A.session_cards(_t(spark, d, "events"), "user_id", "event_type")


@query("SELECT count(*) FILTER (WHERE e.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE e.doc_id IS NULL) AS fp, count(*) FILTER (WHERE p.doc_id IS NULL) AS fn FROM (SELECT doc_id FROM labels WHERE toxic = 1) e FULL JOIN (SELECT doc_id FROM labels WHERE quality = 0) p ON e.doc_id = p.doc_id")
def corpus_scores(spark, d):
    x = _t(spark, d, "labels")
    return A.corpus_scores(x.where("toxic = 1"), x.where("quality = 0"), ["doc_id"])


@query("""WITH s AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'CONTRADICTED' WHEN 'purchase' THEN 'CORROBORATED' WHEN 'click' THEN 'OBSERVED' ELSE 'REPORTED' END AS state FROM events)
SELECT user_id, arg_min(state, CASE state WHEN 'CONTRADICTED' THEN 0 WHEN 'CORROBORATED' THEN 1 WHEN 'OBSERVED' THEN 3 ELSE 4 END) AS state FROM s GROUP BY user_id""")
def evidence_state(spark, d):
    e = _t(spark, d, "events")
    k = F.col("event_type")
    return A.strongest_state(e.withColumn("state", F.when(k == "error", "CONTRADICTED").when(k == "purchase", "CORROBORATED").when(k == "click", "OBSERVED").otherwise("REPORTED")), "user_id")


@query("""SELECT event_id, greatest(0, least(2, greatest(0, least(2, 1 + CASE WHEN value > 10 THEN 1 ELSE 0 END)) - CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)) AS confidence FROM events""")
def confidence_steps(spark, d):
    steps = [F.when(F.col("value") > 10, 1).otherwise(0), -F.when(F.col("event_type") == "error", 1).otherwise(0)]
    return _t(spark, d, "events").select("event_id", A.adjusted_confidence(F.lit(1), steps).alias("confidence"))


@query("SELECT event_type, event_id, greatest(n - 25, 0) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE k <= 25")
def capped_lists(spark, d):
    return A.capped_lists(_t(spark, d, "events"), "event_type", [F.desc("value"), "event_id"], 25).select("event_type", "event_id", "omitted")


# Scalars and predicates.


@query("""SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1), '') AS host FROM pages""")
def url_hosts(spark, d):
    return _t(spark, d, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))


@query("""WITH h AS (SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1) AS host FROM pages) SELECT page_id, host FROM h WHERE host <> '' AND NOT (host = 'example.net' OR ends_with(host, '.example.net'))""")
def host_extract_allowlist(spark, d):
    host = T.url_host(F.col("url"))
    return _t(spark, d, "pages").select("page_id", host.alias("host")).where(~T.is_allowed(F.col("host"), ("example.net",)))


_EMAIL = r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"


@query(f"""WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_EMAIL}') AS f, regexp_split_to_array(coalesce(text, ''), '{_EMAIL}') AS r FROM documents)
SELECT doc_id, r[1] || coalesce(array_to_string(list_transform(range(1, len(f) + 1), lambda i: '[REDACTED:email:' || substr(sha256(f[i]), 1, 8) || ']' || r[i + 1]), ''), '') AS text FROM p""")
def redact_markers(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.redact(F.coalesce("text", F.lit("")), _EMAIL, "email").alias("text"))


_SECRETS = " UNION ALL ".join(f"""SELECT doc_id, source, '{k}' AS kind, unnest(regexp_extract_all(text, '{p.replace("'", "''")}', 1)) AS v FROM documents""" for k, p in T.CREDENTIALS.items())
_REAL = "NOT regexp_matches(v, '(?i)example|placeholder|changeme|redacted|dummy|your[_-]') AND NOT regexp_matches(v, '" + "|".join(f"[{c}]{{6}}" for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-") + "')"


@query(f"SELECT DISTINCT doc_id, kind, sha256(v) AS fingerprint FROM ({_SECRETS}) WHERE {_REAL}")
def secret_scan(spark, d):
    found = _t(spark, d, "documents").select("doc_id", F.explode(T.credentials(F.col("text"))).alias("c"))
    return found.select("doc_id", "c.kind", F.sha2(F.col("c.value").cast("binary"), 256).alias("fingerprint")).distinct()


@query(f"SELECT sha256(v) AS fingerprint, count(DISTINCT source) AS n_sources FROM ({_SECRETS}) WHERE {_REAL} GROUP BY v HAVING count(DISTINCT source) >= 2")
def secret_reuse(spark, d):
    found = _t(spark, d, "documents").select("source", F.explode(T.credentials(F.col("text"))).alias("c"))
    return J.reused(found.select(F.sha2(F.col("c.value").cast("binary"), 256).alias("fingerprint"), "source"), "fingerprint", "source")


@query(r"SELECT event_id, trim(regexp_replace(event_type || '   ' || props, '\s+', ' ', 'g')) AS row_text FROM events WHERE event_type IN ('click', 'error') AND contains(lower(event_type || ' ' || props), '9}')")
def explorer_filter(spark, d):
    e = _t(spark, d, "events").where(F.col("event_type").isin("click", "error") & F.lower(F.concat_ws(" ", "event_type", "props")).contains("9}"))
    return e.select("event_id", T.squeeze(F.concat("event_type", F.lit("   "), "props")).alias("row_text"))


@query("SELECT p_partkey, replace(replace(replace(replace(replace(replace(replace(lower(p_name), '-', ''), '_', ''), '.', ''), '0', 'o'), '1', 'l'), 'rn', 'm'), 'vv', 'w') AS folded FROM part")
def confusable_names(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.confusables(F.col("p_name")).alias("folded"))


# Rules and patterns.

RULES = [
    R.Rule("INSTRUCTION_OVERRIDE", "HIGH", contains=R.INJECTION_PHRASES),
    R.Rule("LICENCE_LINE", "INFO", pattern=r"^Licensed under .*$", exclude="CC BY-NC"),
    R.Rule("TOKEN_LITERAL", "CRITICAL", pattern=r"(?i)token\s*=\s*[\"'][0-9a-f]{16,}"),
    R.Rule("ADDRESS", "LOW", pattern=r"\b\d{1,3}(\.\d{1,3}){3}\b"),
]


@query("""WITH p AS (SELECT unnest([""" + ", ".join(f"'{x}'" for x in R.INJECTION_PHRASES) + r"""]) AS p)
SELECT doc_id, rule_id, severity FROM (SELECT doc_id, 'INSTRUCTION_OVERRIDE' AS rule_id, 'HIGH' AS severity FROM documents WHERE EXISTS (SELECT 1 FROM p WHERE contains(lower(text), p))
UNION ALL SELECT doc_id, 'LICENCE_LINE', 'INFO' FROM documents WHERE regexp_matches(text, '^Licensed under .*$') AND NOT regexp_matches(text, 'CC BY-NC')
UNION ALL SELECT doc_id, 'TOKEN_LITERAL', 'CRITICAL' FROM documents WHERE regexp_matches(text, '(?i)token\s*=\s*["''][0-9a-f]{16,}')
UNION ALL SELECT doc_id, 'ADDRESS', 'LOW' FROM documents WHERE regexp_matches(text, '\b\d{1,3}(\.\d{1,3}){3}\b'))""")
def rule_findings(spark, d):
    return R.findings(_t(spark, d, "documents").select("doc_id", "text"), RULES, "text").select("doc_id", "rule_id", "severity")


@query()
def chain3_greedy(spark, d):
    k = F.col("event_type")
    chain = R.Chain("view-click-purchase", (R.Step(k == "view"), R.Step(k == "click"), R.Step(k == "purchase")), 2 * 86_400_000_000)
    return R.chain_matches(_t(spark, d, "events").withColumn("at", W.micros()), chain, "user_id", "at", "event_id")


# Detections within sessions.


def _u(spark, d) -> DataFrame:
    return _t(spark, d, "events").withColumn("u", W.micros())


@query("SELECT count(*) AS n, arg_min(event_id, (epoch_us(ts), event_id)) AS first_event FROM events WHERE event_type = 'error'")
def global_first(spark, d):
    return S.count_with_first(_u(spark, d), F.col("event_type") == "error", "u", "event_id")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(*) > 10")
def spawn_explosion(spark, d):
    return S.sessions_over(_u(spark, d), "user_id", F.col("event_type") == "click", 10)


@query("""WITH o AS (SELECT o_custkey, o_orderstatus = 'P' AS broken, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS u, lag(epoch_us(CAST(o_orderdate AS TIMESTAMP)) IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders),
g AS (SELECT o_custkey, count(*) FILTER (WHERE broken) AS breaks, count(*) FILTER (WHERE u < p - 60000000) AS steps_back FROM o GROUP BY o_custkey)
SELECT *, CASE WHEN breaks > 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM g WHERE breaks > 0 OR steps_back > 0""")
def session_tampering(spark, d):
    return S.integrity(_t(spark, d, "orders").withColumn("u", W.micros("o_orderdate")), "o_custkey", F.col("o_orderstatus") == "P", "u", "o_orderkey")


@query("""WITH t AS (SELECT user_id, max(epoch_us(ts)) AS done_us FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id, done_us, arg_min(event_id, (epoch_us(ts), event_id)) AS event_id FROM events JOIN t USING (user_id) WHERE event_type <> 'purchase' AND epoch_us(ts) > done_us + 60000000 GROUP BY user_id, done_us""")
def resume_after_done(spark, d):
    return S.resumed_after_done(_u(spark, d), "user_id", "user_id", F.col("event_type") == "purchase", "u", "event_id")


@query("SELECT conv_id, count(DISTINCT role) AS n_identities FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) >= 2")
def identity_switch(spark, d):
    return S.several_identities(_t(spark, d, "conversations"), "conv_id", "role")


_MODE = "CASE WHEN event_type = 'view' THEN 'plan' WHEN event_type = 'signup' THEN 'open' END"


@query(f"""SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, last_value({_MODE} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events)
WHERE event_type = 'purchase' AND m = 'plan'""")
def plan_mode_change(spark, d):
    return S.changes_in_mode(_u(spark, d), "user_id", F.expr(_MODE), "plan", F.col("event_type") == "purchase", "u", "event_id")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS u, CASE WHEN event_type IN ('view', 'click') THEN CAST(value > 20 AS INTEGER) + CAST(value > 60 AS INTEGER) END AS r, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS UNBOUNDED PRECEDING) AS a FROM events),
p AS (SELECT *, lag(r) OVER w AS was, lag(a) OVER w AS b FROM e WHERE r IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY u, event_id))
SELECT user_id, event_id, was, r AS now FROM p WHERE r > was AND a = b""")
def permission_drift(spark, d):
    rank = F.when(F.col("event_type").isin("view", "click"), (F.col("value") > 20).cast("int") + (F.col("value") > 60).cast("int"))
    return S.widened_unapproved(_u(spark, d), "user_id", rank, F.col("event_type") == "signup", "u", "event_id")


@query("""WITH e AS (SELECT *, last_value(CASE WHEN event_type IN ('view', 'signup') THEN event_id END IGNORE NULLS) OVER w AS m, last_value(CASE WHEN event_type IN ('view', 'signup') THEN event_type END IGNORE NULLS) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, m AS source_event FROM e WHERE event_type = 'purchase' AND k = 'view'""")
def multimodal_trigger(spark, d):
    k = F.col("event_type")
    return S.unprompted(_u(spark, d), "user_id", k == "view", k == "signup", k == "purchase", "u", "event_id")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS p FROM events WHERE event_type IN ('error', 'purchase', 'click')) WHERE event_type = 'purchase' AND p = 'error'""")
def unverified_success(spark, d):
    k = F.col("event_type")
    return S.unverified_success(_u(spark, d), "user_id", k == "error", k == "purchase", k == "click", "u", "event_id")


@query("""WITH s AS (SELECT l_partkey, CAST(l_suppkey AS VARCHAR) AS v, min(l_orderkey) AS a FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1, 2)
SELECT l_partkey, count(*) AS n_versions, array_to_string(list(v ORDER BY a, v)[1:20], ',') AS versions FROM s GROUP BY l_partkey HAVING count(*) >= 2""")
def identity_drift(spark, d):
    return S.drifting(_t(spark, d, "lineitem"), ["l_partkey"], "l_suppkey", "l_orderkey")


_ERA = (820_454_400_000_000, 883_612_800_000_000)  # 1996 and 1998 begin


@query(f"""WITH r AS (SELECT l_orderkey AS o_orderkey, min(epoch_us(CAST(l_shipdate AS TIMESTAMP))) AS done FROM lineitem GROUP BY 1), c AS (SELECT o_orderkey, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS u, done FROM orders LEFT JOIN r USING (o_orderkey))
SELECT o_orderkey, 'before_era' AS fault FROM c WHERE u < {_ERA[0]} UNION ALL SELECT o_orderkey, 'future' FROM c WHERE u > {_ERA[1]} UNION ALL SELECT o_orderkey, 'result_first' FROM c WHERE done < u""")
def clock_anomaly(spark, d):
    calls = _t(spark, d, "orders").select("o_orderkey", W.micros("o_orderdate").alias("u"))
    results = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), W.micros("l_shipdate").alias("done"))
    return S.clock_faults(calls, results, "o_orderkey", "u", "done", *_ERA)


@query("SELECT props, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY props HAVING count(*) FILTER (WHERE event_type = 'error') >= 5")
def backend_errors(spark, d):
    return S.error_rates(_u(spark, d), "props", F.col("event_type") == "error", 5)


@query(f"WITH f AS ({_FINDINGS}) SELECT 'severity' AS facet, severity AS value, count(*) AS n FROM f GROUP BY severity UNION ALL SELECT 'rule_id', rule_id, count(*) FROM f GROUP BY rule_id")
def case_summary(spark, d):
    return S.summary(_findings(_t(spark, d, "events")), "severity", "rule_id")


@query("""SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT role) AS roles, arg_min(substr(text, 1, 80), turn) FILTER (WHERE role = 'user') AS opening FROM conversations GROUP BY conv_id""")
def conversation_list(spark, d):
    return S.conversation_list(_t(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query("""SELECT r.user_id, r.props, r.event_id, max(epoch_us(f.ts)) AS fetched_us FROM events r JOIN events f ON f.user_id = r.user_id AND f.props = r.props AND f.event_type = 'view' AND r.event_type = 'click' AND epoch_us(f.ts) <= epoch_us(r.ts) AND epoch_us(r.ts) - epoch_us(f.ts) <= 864000000000 GROUP BY ALL""")
def artifact_execution(spark, d):
    e = _u(spark, d)
    return S.fetched_then_run(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id", "props"], "u", "u", "event_id", 864_000_000_000)
