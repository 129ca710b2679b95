"""Bound join and aggregation queries (ops 34-66) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.functions.text import sql_tokens, tokens
from quarry.operators import aggs as A
from quarry.operators import joins as J
from quarry.plans import bindings as B
from quarry.plans.q_scalars import EXT_CASE, FILE_PATH_SQL, PLANTED_SQL, file_path, planted
from quarry.plans.registry import register
from quarry.sources.tables import Tables


def r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------------ 34
ERROR_RULES = [("failure", "^error"), ("purchase", "^purchase"), ("signup", "^signup"),
               ("browse", "^(view|click)")]
_RULE_CASE = "CASE " + " ".join(f"WHEN regexp_matches(msg, '{p}') THEN '{n}'"
                                for n, p in ERROR_RULES) + " ELSE 'other' END"


@register("error_class", f"""
WITH c AS (SELECT event_id, {_RULE_CASE} AS cls
           FROM (SELECT event_id, event_type || ' ' || props AS msg FROM events)),
f AS (SELECT cls, count(*) AS n FROM c WHERE cls <> 'other' GROUP BY cls),
top AS (SELECT cls FROM (SELECT cls, row_number() OVER (ORDER BY n DESC, cls) AS r FROM f)
        WHERE r <= 3)
SELECT event_id, CASE WHEN cls IN (SELECT cls FROM top) THEN cls ELSE 'other' END AS error_class
FROM c""")
def q_error_class(spark, root):
    e = Tables(spark, root).events.select(
        "event_id", F.concat_ws(" ", "event_type", "props").alias("msg"))
    return A.error_class(e, "msg", ERROR_RULES, 3).select("event_id", "error_class")


# ------------------------------------------------------------------ 35-44
@register("join_hierarchy", """
SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def q_hierarchy(spark, root):
    t = Tables(spark, root)
    return J.join_hierarchy(t.supplier, t.nation, t.region, "s_nationkey", "n_nationkey",
                            "n_regionkey", "r_regionkey").select("s_suppkey", "s_name", "n_name",
                                                                 "r_name")


def label_centroids(p):
    """Mean vector per label (dimension-wise average, then ordered by dim)."""
    d = p.select("label", F.posexplode("vector").alias("pos", "x"))
    m = d.groupBy("label", "pos").agg(F.avg("x").alias("a"))
    return m.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "a"))).alias("_c")) \
        .select("label", F.transform("_c", lambda s: s["a"]).alias("centroid"))


CENTROIDS_SQL = """cent AS (
  SELECT label, list(a ORDER BY pos) AS centroid
  FROM (SELECT label, pos, avg(x) AS a
        FROM (SELECT label, unnest(vector) AS x, unnest(generate_series(1, len(vector))) AS pos
              FROM planted) GROUP BY label, pos)
  GROUP BY label)"""

NEAREST_SQL = B.with_sql(PLANTED_SQL, CENTROIDS_SQL) + """,
sims AS (
  SELECT p.vec_id, c.label,
         list_sum(list_transform(list_zip(p.vector, c.centroid), lambda z: z[1] * z[2]))
         / (sqrt(list_sum(list_transform(p.vector, lambda x: x * x)))
            * sqrt(list_sum(list_transform(c.centroid, lambda x: x * x)))) AS sim
  FROM planted p CROSS JOIN cent c),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS r FROM sims)
SELECT vec_id, CASE WHEN sim >= 0.4 THEN label END AS cluster, round(sim, 6) AS similarity
FROM best WHERE r = 1"""


@register("assign_nearest", NEAREST_SQL)
def q_nearest(spark, root):
    p = planted(Tables(spark, root))
    c = label_centroids(p).withColumn("cluster", F.col("label"))
    out = J.assign_nearest(p, c, "vec_id", "vector", "cluster", "centroid", "label", min_sim=0.4)
    return out.select("vec_id", "cluster", r6(F.col("similarity")).alias("similarity"))


@register("link_parents", B.with_sql(PLANTED_SQL) + """,
votes AS (SELECT label AS child, CAST(floor(vector[1] * 10) AS BIGINT) AS parent, count(*) AS votes,
                 min(vec_id) AS first_pos
          FROM planted GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY votes DESC, first_pos) AS r
         FROM votes)
SELECT child, parent, votes FROM best WHERE r = 1""")
def q_link_parents(spark, root):
    p = planted(Tables(spark, root))
    kids = p.select(F.col("label").alias("child"), F.col("vec_id").alias("member"),
                    F.col("vec_id").alias("pos"))
    pars = p.select(F.floor(F.col("vector")[0] * 10).cast("long").alias("parent"),
                    F.col("vec_id").alias("member"))
    return J.link_parents(kids, pars, "child", "parent", "member", "pos")


@register("missing_in", """
SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""")
def q_missing(spark, root):
    t = Tables(spark, root)
    return J.missing_in(t.customer.select("c_custkey"),
                        t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


FRESH_AGE_S = 6 * 3600


@register("fresh_at", f"""
WITH bounds AS (SELECT date_trunc('hour', min(ts)) AS lo, max(ts) AS hi FROM events),
probes AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS probe_ts FROM bounds),
queues AS (SELECT DISTINCT event_type AS queue FROM events)
SELECT p.probe_ts, q.queue, count(DISTINCT e.user_id) AS fresh_workers
FROM probes p CROSS JOIN queues q
LEFT JOIN events e ON e.event_type = q.queue AND e.ts <= p.probe_ts
                   AND e.ts >= p.probe_ts - INTERVAL {FRESH_AGE_S} SECOND
GROUP BY ALL""")
def q_fresh(spark, root):
    e = Tables(spark, root).events
    b = e.agg(F.date_trunc("hour", F.min("ts")).cast("timestamp_ntz").alias("lo"),
              F.max("ts").alias("hi"), F.collect_set("event_type").alias("queues"))
    probes = (b.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("probe_ts"),
                       "queues")
              .select("probe_ts", F.explode("queues").alias("queue")))
    beats = e.select(F.col("event_type").alias("queue"), "user_id", "ts")
    return J.fresh_at(probes, beats, "queue", "probe_ts", "ts", "user_id", FRESH_AGE_S)


@register("asof_state", """
SELECT l.event_id, r.value AS value_asof
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') l
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') r
ON l.user_id = r.user_id AND l.ts >= r.ts""")
def q_asof(spark, root):
    e = Tables(spark, root).events
    left = e.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    right = e.filter(F.col("event_type") == "view").select("user_id", "ts", "value")
    return J.asof_state(left, right, "user_id", "ts", "value", "event_id",
                        segment_seconds=7 * 86400).select("event_id", "value_asof")


@register("finalizable", B.with_sql(B.JOBS_SQL) + """
SELECT job_id FROM jobs
WHERE offered_at + INTERVAL 24 HOUR <= (SELECT max(o_orderdate) FROM orders)
  AND job_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
  AND job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'F')""")
def q_finalizable(spark, root):
    t = Tables(spark, root)
    j = B.jobs(t)
    ch = t.lineitem.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("job_id"))
    fin = j.filter(F.col("status") == "F").select("job_id")
    now = t.orders.select(F.max("o_orderdate")).scalar()
    return J.finalizable(j, ch, fin, "job_id", "offered_at", now).select("job_id")


TOK = sql_tokens("text")


@register("satisfy_all", f"""
WITH cons AS (SELECT DISTINCT item_id, unnest({TOK}) AS term FROM benchmark),
post AS (SELECT doc_id, unnest({TOK}) AS term FROM documents),
hits AS (SELECT term, doc_id, count(*) AS tf FROM post
         WHERE term IN (SELECT term FROM cons) GROUP BY ALL),
need AS (SELECT item_id, count(DISTINCT term) AS need FROM cons GROUP BY 1),
got AS (SELECT c.item_id, h.doc_id, count(DISTINCT c.term) AS got, CAST(sum(h.tf) AS BIGINT) AS score
        FROM cons c JOIN hits h USING (term) GROUP BY ALL)
SELECT item_id, doc_id, score FROM got JOIN need USING (item_id) WHERE got = need""")
def q_satisfy(spark, root):
    t = Tables(spark, root)
    cons = t.benchmark.select("item_id", F.explode(tokens("text")).alias("term")).distinct()
    post = t.documents.select("doc_id", F.explode(tokens("text")).alias("term"))
    hits = (post.join(cons.select("term").distinct(), "term", "left_semi")
            .groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf")))
    return J.satisfy_all(hits, cons, "item_id", "term", "doc_id", "tf")


@register("baseline_delta", """
WITH runs AS (SELECT l_returnflag AS grp, l_linestatus AS variant,
                     avg(l_extendedprice) AS metric, sum(l_quantity) AS wall
              FROM lineitem GROUP BY ALL),
base AS (SELECT grp, metric AS bm, wall AS bw FROM runs WHERE variant = 'F')
SELECT grp, variant, round(metric, 6) AS metric, round(wall, 6) AS wall,
       round((metric - bm) * 100.0 / bm, 6) AS delta_metric_pct,
       round((wall - bw) * 100.0 / bw, 6) AS delta_wall_pct
FROM runs LEFT JOIN base USING (grp)""")
def q_baseline(spark, root):
    li = Tables(spark, root).lineitem
    runs = li.groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("variant")).agg(
        F.avg("l_extendedprice").alias("metric"), F.sum("l_quantity").alias("wall"))
    out = J.baseline_delta(runs, "grp", "variant", "F", ["metric", "wall"])
    return out.select("grp", "variant", *[r6(F.col(c)).alias(c) for c in
                                          ("metric", "wall", "delta_metric_pct", "delta_wall_pct")])


# ------------------------------------------------------------------ review 45-48
_SEV_CASE = "CASE upper(severity) " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in A.SEVERITY_RANK.items()) + " ELSE 0 END"

SCORES_SQL = f"""scores AS (
  SELECT change_id,
         sum(weight * CASE WHEN verdict = 'PASS' THEN 1.0 ELSE 0.0 END) / sum(weight) AS score,
         count(*) AS n_checks, max({_SEV_CASE}) AS max_severity,
         coalesce(bool_and(CASE WHEN required THEN verdict = 'PASS' END), TRUE) AS required_pass
  FROM checks JOIN agents USING (agent_no) WHERE enabled GROUP BY change_id)"""


def _scores(spark, root):
    t = Tables(spark, root)
    return A.review_score(B.checks(t), B.agents_df(spark))


@register("review_score", B.with_sql(B.CHECKS_SQL, B.AGENTS_SQL, SCORES_SQL) + """
SELECT change_id, round(score, 6) AS score, n_checks, max_severity, required_pass FROM scores""")
def q_review_score(spark, root):
    s = _scores(spark, root)
    return s.select("change_id", r6(F.col("score")).alias("score"), "n_checks", "max_severity",
                    "required_pass")


@register("review_decision", B.with_sql(B.CHECKS_SQL, B.AGENTS_SQL, SCORES_SQL) + """
SELECT change_id,
       CASE WHEN score < 0.5 OR max_severity >= 4 OR NOT required_pass THEN 'BLOCK'
            WHEN score >= 0.75 AND max_severity < 3 AND required_pass THEN 'MERGE'
            ELSE 'REVIEW' END AS decision
FROM scores""")
def q_review_decision(spark, root):
    return A.review_decision(_scores(spark, root)).select("change_id", "decision")


RISK_FACTS_SQL = """facts AS (
  SELECT c.change_id,
         bool_or(c.agent_no = 1 AND c.verdict = 'FAIL') AS security_failed,
         any_value(o.o_orderpriority = '1-URGENT') AS critical_files,
         CAST(count_if(c.verdict = 'FAIL') AS BIGINT) AS n_fail,
         count_if(c.verdict = 'PASS') / count(*) AS pass_share,
         CASE WHEN sum(c.lines) + 5 * count(*) + 10 * count_if(c.verdict = 'FAIL') < 50 THEN 1
              WHEN sum(c.lines) + 5 * count(*) + 10 * count_if(c.verdict = 'FAIL') < 150 THEN 2
              WHEN sum(c.lines) + 5 * count(*) + 10 * count_if(c.verdict = 'FAIL') < 300 THEN 3
              ELSE 4 END AS complexity,
         bool_or(c.agent_no <> 5) AS prod_change, bool_or(c.agent_no = 5) AS test_change
  FROM checks c JOIN orders o ON o.o_orderkey = c.change_id GROUP BY c.change_id)"""


RISK_CASE = """CASE WHEN security_failed THEN 'CRITICAL'
            WHEN (critical_files AND n_fail > 0) OR (complexity = 4 AND n_fail > 0) THEN 'HIGH'
            WHEN complexity = 3 OR n_fail > 1 THEN 'MEDIUM'
            WHEN pass_share >= 2.0 / 3.0 THEN 'LOW' ELSE 'MEDIUM' END"""
# may the policy of the risk class merge on its own?
ALLOWED_CASE = f"""(CASE ({RISK_CASE}) WHEN 'LOW' THEN pass_share >= 2.0 / 3.0
            WHEN 'MEDIUM' THEN pass_share >= 1 ELSE FALSE END)"""


@register("risk_level", B.with_sql(B.CHECKS_SQL, RISK_FACTS_SQL) + f"""
SELECT change_id,
       CASE WHEN security_failed THEN 'CRITICAL'
            WHEN (critical_files AND n_fail > 0) OR (complexity = 4 AND n_fail > 0) THEN 'HIGH'
            WHEN complexity = 3 OR n_fail > 1 THEN 'MEDIUM'
            WHEN pass_share >= 2.0 / 3.0 THEN 'LOW' ELSE 'MEDIUM' END AS risk,
       prod_change AND NOT test_change AS auto_merge_blocked,
       NOT (prod_change AND NOT test_change) AND {ALLOWED_CASE} AS auto_merge_allowed
FROM facts""")
def q_risk(spark, root):
    return _risk_table(spark, root).select("change_id", "risk", "auto_merge_blocked",
                                           "auto_merge_allowed")


DECISION_CASE = """CASE WHEN score < 0.5 OR max_severity >= 4 OR NOT required_pass THEN 'BLOCK'
            WHEN score >= 0.75 AND max_severity < 3 AND required_pass THEN 'MERGE'
            ELSE 'REVIEW' END"""


@register("review_rollup", B.with_sql(B.CHECKS_SQL, B.AGENTS_SQL, SCORES_SQL, RISK_FACTS_SQL) + f""",
ch AS (SELECT f.change_id, f.complexity, {RISK_CASE} AS risk,
              CASE WHEN NOT (NOT (f.prod_change AND NOT f.test_change) AND {ALLOWED_CASE})
                        AND {DECISION_CASE} = 'MERGE' THEN 'REVIEW'
                   ELSE {DECISION_CASE} END AS decision
       FROM facts f JOIN scores s USING (change_id))
SELECT CASE WHEN grouping(complexity) = 0 THEN 'complexity' WHEN grouping(risk) = 0 THEN 'risk'
            ELSE 'total' END AS dimension,
       CASE WHEN grouping(complexity) = 0 THEN CAST(complexity AS VARCHAR)
            WHEN grouping(risk) = 0 THEN risk END AS key,
       count(*) AS n_changes, CAST(count_if(decision = 'MERGE') AS BIGINT) AS n_merge,
       round(count_if(decision = 'MERGE') / count(*), 6) AS auto_merge_rate, round(avg(level), 6) AS avg_complexity
FROM (SELECT *, complexity AS level FROM ch) GROUP BY GROUPING SETS ((complexity), (risk), ())""")
def q_review_rollup(spark, root):
    """Op 48, change level: complexity-level counts, risk distribution and
    auto-merge rate (a MERGE decision is held back when the policy of the
    risk class or a production change without a test change forbids it)."""
    r = _risk_table(spark, root)
    d = A.review_decision(_scores(spark, root)).select("change_id", "decision")
    ch = r.join(d, "change_id").withColumn(
        "decision", F.when(~F.col("auto_merge_allowed") & (F.col("decision") == "MERGE"),
                           F.lit("REVIEW")).otherwise(F.col("decision")))
    out = A.review_rollup(ch, ["complexity", "risk"])
    return out.select("dimension", "key", "n_changes", "n_merge",
                      F.round("auto_merge_rate", 6).alias("auto_merge_rate"),
                      F.round("avg_complexity", 6).alias("avg_complexity"))


def _risk_table(spark, root):
    t = Tables(spark, root)
    c = B.checks(t)
    o = t.orders.select(F.col("o_orderkey").alias("change_id"),
                        (F.col("o_orderpriority") == "1-URGENT").alias("_crit"))
    f = c.join(o, "change_id").groupBy("change_id").agg(
        F.bool_or((F.col("agent_no") == 1) & (F.col("verdict") == "FAIL")).alias("security_failed"),
        F.any_value("_crit").alias("critical_files"),
        F.count_if(F.col("verdict") == "FAIL").alias("n_fail"),
        (F.count_if(F.col("verdict") == "PASS") / F.count(F.lit(1))).alias("pass_share"),
        S.complexity_level(F.sum("lines"), F.count(F.lit(1)),
                           F.count_if(F.col("verdict") == "FAIL")).alias("complexity"),
        F.bool_or(F.col("agent_no") != 5).alias("prod_change"),
        F.bool_or(F.col("agent_no") == 5).alias("test_change"))
    return A.risk_level(f)


@register("review_metrics", B.with_sql(B.CHECKS_SQL) + """
SELECT CASE WHEN grouping(agent_no) = 0 THEN 'agent_no' WHEN grouping(severity) = 0 THEN 'severity'
            ELSE 'total' END AS dimension,
       CASE WHEN grouping(agent_no) = 0 THEN CAST(agent_no AS VARCHAR)
            WHEN grouping(severity) = 0 THEN severity END AS key,
       count(*) AS n, CAST(count_if(verdict = 'PASS') AS BIGINT) AS n_pass, CAST(count_if(verdict = 'FAIL') AS BIGINT) AS n_fail,
       round(count_if(verdict = 'PASS') / count(*), 6) AS success_rate,
       round(avg(confidence), 6) AS avg_confidence, CAST(min(lines) AS INTEGER) AS min_time,
       round(avg(lines), 6) AS avg_time, CAST(max(lines) AS INTEGER) AS max_time
FROM checks GROUP BY GROUPING SETS ((agent_no), (severity), ())""")
def q_review_metrics(spark, root):
    """A check takes as many seconds as it has lines."""
    m = A.review_metrics(B.checks(Tables(spark, root)), ["agent_no", "severity"], elapsed="lines")
    return m.select("dimension", "key", "n", "n_pass", "n_fail",
                    r6(F.col("success_rate")).alias("success_rate"),
                    r6(F.col("avg_confidence")).alias("avg_confidence"),
                    "min_time", r6(F.col("avg_time")).alias("avg_time"), "max_time")


@register("review_files", B.with_sql(B.CHECKS_SQL) + f""",
files AS (SELECT change_id, {EXT_CASE} AS language,
                 CASE WHEN regexp_matches(path, '{S.TEST_FILE_RE}') THEN 'test'
                      WHEN regexp_matches(path, '{S.CONFIG_FILE_RE}') THEN 'config' ELSE 'production' END AS kind
          FROM (SELECT change_id, {FILE_PATH_SQL} AS path FROM checks JOIN part ON p_partkey = l_partkey))
SELECT CASE WHEN grouping(language) = 0 THEN 'language' WHEN grouping(kind) = 0 THEN 'kind' ELSE 'total' END AS dimension,
       coalesce(language, kind) AS key, count(DISTINCT change_id) AS n_changes, count(*) AS n_files
FROM files GROUP BY GROUPING SETS ((language), (kind), ())""")
def q_review_files(spark, root):
    """Op 48: the file of a check is its part's."""
    t = Tables(spark, root)
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), file_path().alias("path"))
    checks = B.checks(t).select("change_id", "l_partkey")
    files = checks.join(part, "l_partkey").select(
        "change_id", S.language_of("path").alias("language"), S.file_kind("path").alias("kind"))
    return A.review_files(files, n_files=checks.count())   # a check has one part


@register("latency_percentiles", """
WITH r AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n,
                  row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn FROM events)
SELECT event_type, any_value(n) AS n,
       min(value) FILTER (WHERE rn >= ceil(0.5 * n)) AS p50,
       min(value) FILTER (WHERE rn >= ceil(0.95 * n)) AS p95,
       min(value) FILTER (WHERE rn >= ceil(0.99 * n)) AS p99
FROM r GROUP BY event_type""")
def q_latency(spark, root):
    return A.latency_percentiles(Tables(spark, root).events, "event_type", "value")


# ------------------------------------------------------------------ fleet 50-52
# Roles and capabilities come from the tables: a role is an event type, its
# instances are the users that sent such events; half of the mean number of
# instances per role is required, and error reports are optional.  A capability
# is a region; it needs the roles that its customers use at least as often as
# an average role.
ROLES_SQL = """roles AS (
  SELECT role, CAST(ceil(avg(n) OVER () / 2) AS INTEGER) AS min_healthy, role = 'error' AS optional
  FROM (SELECT event_type AS role, count(DISTINCT user_id) AS n FROM events GROUP BY 1))"""
CAPS_SQL = """caps AS (
  SELECT capability, role FROM (
    SELECT r_name AS capability, event_type AS role, count(*) AS n,
           avg(count(*)) OVER (PARTITION BY r_name) AS mean
    FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2)
  WHERE n >= mean)"""
CODE_EXPR = "CASE WHEN value < 150 THEN 200 WHEN value < 300 THEN 429 ELSE 503 END"

PROBES_SQL = f"""probes AS (
  SELECT event_type AS role, user_id AS instance, {CODE_EXPR} AS code, ts FROM events)"""

ROLE_HEALTH_SQL = B.with_sql(ROLES_SQL, PROBES_SQL) + """,
latest AS (SELECT role, instance, arg_max(code, ts) AS c FROM probes GROUP BY ALL),
per AS (SELECT role,
               CAST(count_if(c >= 200 AND c < 300) AS BIGINT) AS n_ok,
               CAST(count_if(c >= 400 AND c < 500) AS BIGINT) AS n_degraded,
               CAST(count_if(NOT (c >= 200 AND c < 300) AND NOT (c >= 400 AND c < 500)) AS BIGINT)
                 AS n_offline
        FROM latest GROUP BY role),
rh AS (SELECT r.role, r.min_healthy, r.optional,
              coalesce(p.n_ok, 0) AS n_ok, coalesce(p.n_degraded, 0) AS n_degraded,
              coalesce(p.n_offline, 0) AS n_offline
       FROM roles r LEFT JOIN per p USING (role)),
rs AS (SELECT *, CASE WHEN n_ok >= min_healthy THEN 'up'
                      WHEN n_ok + n_degraded > 0 THEN 'degraded' ELSE 'down' END AS status FROM rh)
"""


def roles_df(t: Tables):
    n = t.events.groupBy(F.col("event_type").alias("role")).agg(F.count_distinct("user_id").alias("_n"))
    need = n.agg(F.ceil(F.avg("_n") / 2).cast("int")).scalar()
    return n.select("role", need.alias("min_healthy"), (F.col("role") == "error").alias("optional"))


def capabilities_df(t: Tables):
    e = (t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("_n"))
         .join(t.customer.select(F.col("c_custkey").alias("user_id"), "c_nationkey"), "user_id")
         .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    n = e.groupBy(F.col("r_name").alias("capability"), F.col("event_type").alias("role")).agg(
        F.sum("_n").alias("_n"))
    mean = n.groupBy("capability").agg(F.avg("_n").alias("_mean"))
    return (n.join(mean, "capability").filter(F.col("_n") >= F.col("_mean"))
            .groupBy("capability").agg(F.collect_set("role").alias("roles")))


def probes_df(t: Tables):
    return t.events.select(F.col("event_type").alias("role"), F.col("user_id").alias("instance"),
                           F.expr(CODE_EXPR).alias("code"), "ts")


def _role_status(spark, root):
    t = Tables(spark, root)
    return A.role_health(probes_df(t), roles_df(t))


@register("role_health", ROLE_HEALTH_SQL +
          "SELECT role, n_ok, n_degraded, n_offline, status FROM rs")
def q_role_health(spark, root):
    return _role_status(spark, root).select("role", "n_ok", "n_degraded", "n_offline", "status")


@register("capability_rollup", ROLE_HEALTH_SQL + ", " + CAPS_SQL + """
SELECT capability, CASE max(CASE WHEN rs.optional THEN 0 WHEN rs.status = 'up' THEN 0
                                 WHEN rs.status = 'degraded' THEN 1 ELSE 2 END)
                   WHEN 0 THEN 'up' WHEN 1 THEN 'degraded' ELSE 'down' END AS status
FROM caps m LEFT JOIN rs USING (role)
GROUP BY capability""")
def q_capability(spark, root):
    return A.capability_rollup(_role_status(spark, root), capabilities_df(Tables(spark, root)))


STATE_EXPR = "CASE WHEN value < 300 THEN 'running' ELSE 'exited' END"
HEALTH_EXPR = ("CASE WHEN value < 100 THEN 'healthy' WHEN value < 120 THEN 'starting' "
               "WHEN value < 200 THEN '' ELSE 'unhealthy' END")


FLEET_SQL = f"""
WITH {ROLES_SQL}, latest AS (SELECT user_id // 10 AS host, event_type AS service, arg_max(value, ts) AS value
                FROM events GROUP BY ALL),
s AS (SELECT host, service, {STATE_EXPR.replace('value', 'latest.value')} AS state,
             {HEALTH_EXPR.replace('value', 'latest.value')} AS health,
             service IN (SELECT role FROM roles WHERE NOT optional AND min_healthy >= 1) AS exp FROM latest),
m AS (SELECT host, service, state, health, CASE WHEN state = 'running' AND (health = 'healthy' OR health = '') THEN 'ok'
                        WHEN state = 'running' AND health = 'starting' THEN 'warn'
                        WHEN state = 'running' THEN 'FAIL' WHEN exp THEN 'FAIL' ELSE 'cold' END AS mark
      FROM s)
"""


def _services(t):
    latest = t.events.groupBy((F.col("user_id") / 10).cast("long").alias("host"),
                              F.col("event_type").alias("service")).agg(F.max_by("value", "ts").alias("value"))
    exp = roles_df(t).filter("not optional and min_healthy >= 1").select(F.col("role").alias("service"))
    return latest.select("host", "service", F.expr(STATE_EXPR).alias("state"),
                         F.expr(HEALTH_EXPR).alias("health")), exp


@register("fleet_verdict", FLEET_SQL + """
SELECT host, bool_or(mark = 'FAIL') AS red, CAST(count_if(mark IN ('warn', 'cold')) AS BIGINT) AS warns,
       CAST(count_if(mark = 'ok') AS BIGINT) AS oks, count(*) AS services
FROM m GROUP BY host""")
def q_fleet(spark, root):
    return A.fleet_verdict(*_services(Tables(spark, root)))


@register("service_verdicts", FLEET_SQL + "SELECT host, service, state, health, mark FROM m")
def q_services(spark, root):
    return A.service_verdicts(*_services(Tables(spark, root))).select("host", "service", "state", "health", "mark")


# ------------------------------------------------------------------ 53-57
STEP_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'FAIL' ELSE o_orderstatus END"


@register("status_pivot", f"""
SELECT coalesce(target, 'TOTAL') AS target, CAST(count_if(st = 'PASS') AS BIGINT) AS pass,
       CAST(count_if(st = 'FAIL') AS BIGINT) AS fail, CAST(count_if(st = 'SKIP') AS BIGINT) AS skip,
       count_if(st = 'FAIL') = 0 AS green
FROM (SELECT o_orderpriority AS target,
             CASE WHEN ({STEP_STATUS}) IN ('PASS', 'FAIL') THEN ({STEP_STATUS}) ELSE 'SKIP' END AS st
      FROM orders)
GROUP BY ROLLUP (target)""")
def q_status_pivot(spark, root):
    o = Tables(spark, root).orders.select(F.col("o_orderpriority").alias("target"),
                                          F.expr(STEP_STATUS).alias("status"))
    return A.status_pivot(o, "target", "status")


@register("duplicates", """
SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def q_duplicates(spark, root):
    d = Tables(spark, root).documents.select(F.md5("text").alias("text_md5"))
    return A.duplicates(d, "text_md5")


BUDGET_SQL = """usage AS (
  SELECT d.provider_no, p.provider, d.day, d.week, d.tokens_day, w.tokens_week,
         p.daily_limit > 0 AND d.tokens_day > p.daily_limit AS over_daily,
         p.weekly_limit > 0 AND w.tokens_week > p.weekly_limit AS over_weekly,
         d.tokens_day * p.cost_per_m_token AS cost_micro_usd
  FROM (SELECT provider_no, day, CAST(date_trunc('week', day) AS DATE) AS week, tokens_day
        FROM (SELECT provider_no, CAST(ts AS DATE) AS day, CAST(sum(tokens) AS BIGINT) AS tokens_day
              FROM calls GROUP BY ALL)) d
  JOIN (SELECT provider_no, CAST(date_trunc('week', CAST(ts AS DATE)) AS DATE) AS week,
               CAST(sum(tokens) AS BIGINT) AS tokens_week FROM calls GROUP BY ALL) w
    USING (provider_no, week)
  JOIN providers p USING (provider_no))"""


def _usage(spark, root):
    t = Tables(spark, root)
    return A.budget_usage(B.calls(t), B.providers_df(spark))


@register("budget_usage", B.with_sql(B.CALLS_SQL, B.PROVIDERS_SQL, BUDGET_SQL) + """
SELECT provider_no, provider, day, week, tokens_day, tokens_week, over_daily, over_weekly,
       cost_micro_usd FROM usage""")
def q_budget(spark, root):
    return _usage(spark, root)


_LEVEL_CASE = "CASE priority " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in A.PRIORITY_LEVEL.items()) + " ELSE 'low' END"


@register("route_provider", B.with_sql(B.CALLS_SQL, B.PROVIDERS_SQL, BUDGET_SQL) + f""",
cand AS (SELECT d.day, p.provider_no, p.provider, p.strength
         FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM calls) d CROSS JOIN providers p),
ok AS (SELECT c.* FROM cand c LEFT JOIN usage u ON u.provider_no = c.provider_no AND u.day = c.day
       WHERE coalesce(NOT u.over_daily AND NOT u.over_weekly, TRUE)),
pick AS (SELECT day, provider FROM (
           SELECT *, row_number() OVER (PARTITION BY day ORDER BY strength DESC, provider_no) AS r
           FROM ok) WHERE r = 1)
SELECT call_id, coalesce(p.provider, 'local') AS provider,
       coalesce(p.provider, 'local') || ':' || {_LEVEL_CASE} AS model
FROM calls LEFT JOIN pick p ON p.day = CAST(calls.ts AS DATE)""")
def q_route(spark, root):
    t = Tables(spark, root)
    tasks = B.calls(t).withColumn("day", F.to_date("ts"))
    cfg = [(i, p[0], p[1], p[2]) for i, p in enumerate(B.PROVIDERS)]
    return A.route_provider(tasks, _usage(spark, root), cfg).select("call_id", "provider", "model")


GPU_LINE = ("CASE WHEN p_size % 13 = 0 THEN p_name ELSE p_name || ', ' || p_type || "
            "CASE WHEN p_size % 11 = 0 THEN '' ELSE ', ' || "
            "CASE WHEN p_size % 7 = 0 THEN 'n/a' WHEN p_size % 5 = 0 THEN CAST(p_size AS STRING) || '.5' "
            "ELSE CAST(p_size * 512 AS STRING) END END END")


@register("gpu_inventory", f"""
WITH r AS (SELECT p_brand AS host, p_partkey,
                  list_transform(string_split(trim({GPU_LINE}), ','), lambda x: trim(x)) AS p FROM part),
c AS (SELECT *, CASE WHEN len(p) >= 3 AND regexp_full_match(p[3], '[+-]?[0-9]+')
                     THEN TRY_CAST(p[3] AS BIGINT) END AS mb FROM r),
f AS (SELECT host, arg_min(p, p_partkey) AS p1 FROM c GROUP BY host)
SELECT c.host, any_value(CASE WHEN len(p1) >= 3 THEN p1[1] ELSE '' END) AS model,
       any_value(CASE WHEN len(p1) >= 3 THEN p1[2] ELSE '' END) AS driver,
       CAST(count_if(len(p) >= 3) AS BIGINT) AS n_cards,
       coalesce(CAST(round_even(min(mb) FILTER (WHERE mb > 0) / 1024.0, 0) AS BIGINT), 0) AS vram_gb,
       CAST(count_if(len(p) >= 3 AND mb IS NULL) AS BIGINT) AS n_bad
FROM c JOIN f USING (host) GROUP BY c.host""")
def q_gpu(spark, root):
    p = Tables(spark, root).part.select(F.col("p_brand").alias("host"), "p_partkey",
                                        F.expr(GPU_LINE.replace("||", "||")).alias("line"))
    return A.gpu_inventory(p, "host", "line", "p_partkey")


# ------------------------------------------------------------------ pools, reps 61-66
POOLS_SQL = B.with_sql(B.JOBS_SQL, B.JOB_WORKERS_SQL) + """,
pools AS (
  SELECT s.pool, s.members, s.total_stake, coalesce(v.volume, 0) AS volume
  FROM (SELECT s_nationkey AS pool, count(*) AS members,
               sum(greatest(s_acctbal, 0.0)) AS total_stake FROM supplier GROUP BY 1) s
  LEFT JOIN (SELECT w.pool, sum(j.value) / 100.0 AS volume
             FROM jobs j JOIN job_workers w USING (job_id) GROUP BY 1) v USING (pool))"""


def pools_df(t: Tables):
    s = t.supplier.groupBy(F.col("s_nationkey").alias("pool")).agg(
        F.count(F.lit(1)).alias("members"),
        F.sum(F.greatest("s_acctbal", F.lit(0.0))).alias("total_stake"))
    v = (B.jobs(t).join(B.job_workers(t), "job_id").groupBy("pool")
         .agg((F.sum("value") / 100.0).alias("volume")))
    return s.join(v, "pool", "left").fillna(0.0, ["volume"])


@register("pool_tier", POOLS_SQL + """
SELECT pool, members, round(total_stake, 6) AS total_stake, round(volume, 6) AS volume,
       CASE WHEN members <= 1 AND volume = 0 AND total_stake = 0 THEN 1
            ELSE greatest(
              CASE WHEN total_stake <= 10000 THEN 2 WHEN total_stake <= 100000 THEN 3
                   WHEN total_stake <= 1000000 THEN 4 ELSE 5 END,
              CASE WHEN members <= 50 THEN 2 WHEN members <= 500 THEN 3
                   WHEN members <= 5000 THEN 4 ELSE 5 END,
              CASE WHEN volume <= 1000 THEN 2 WHEN volume <= 10000 THEN 3
                   WHEN volume <= 100000 THEN 4 ELSE 5 END) END AS tier
FROM (SELECT pool, members, total_stake / power(10, pool % 8) AS total_stake,
             volume / power(10, pool % 8) AS volume FROM pools)""")
def q_pool_tier(spark, root):
    """Pools of several sizes: amounts scaled down by powers of ten."""
    scale = F.pow(F.lit(10.0), F.col("pool") % 8)
    p = A.pool_tier(pools_df(Tables(spark, root)).withColumn("total_stake", F.col("total_stake") / scale)
                    .withColumn("volume", F.col("volume") / scale))
    return p.select("pool", "members", r6(F.col("total_stake")).alias("total_stake"),
                    r6(F.col("volume")).alias("volume"), "tier")


REPS_EXPR = {
    "earned": "CAST(c_custkey % 400 AS BIGINT)",
    "pooled": "c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "endorsement": "CAST(round(c_acctbal) AS BIGINT)",
    "donated": "CAST(round(greatest(c_acctbal, 0.0) * 100000) AS BIGINT)",
}


@register("effective_rep_cap", f"""
SELECT c_custkey,
       least(CASE WHEN pooled THEN earned + endorsement ELSE least(earned, 100) END,
             donated // 1000000) AS rep_cap
FROM (SELECT c_custkey, {', '.join(f'{v} AS {k}' for k, v in REPS_EXPR.items())} FROM customer)""")
def q_rep_cap(spark, root):
    c = Tables(spark, root).customer.select("c_custkey", *[F.expr(v).alias(k)
                                                          for k, v in REPS_EXPR.items()])
    return A.effective_rep_cap(c).select("c_custkey", "rep_cap")


@register("quorum_outcomes", """
SELECT o_orderkey, signers FROM orders JOIN (
  SELECT l_orderkey AS o_orderkey, count(DISTINCT l_suppkey) AS signers FROM lineitem
  WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1) USING (o_orderkey)
WHERE signers >= 3""")
def q_quorum(spark, root):
    t = Tables(spark, root)
    sigs = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("signer"))
    reg = t.supplier.filter(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("signer"))
    return A.quorum_outcomes(t.orders.select("o_orderkey"), sigs, reg, "o_orderkey", "signer", 3)


@register("credit_policy_check", """
SELECT c_custkey, per_node_max, per_node_max * 2 > 1000000 AS rejected
FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS per_node_max FROM customer)""")
def q_credit_policy(spark, root):
    c = Tables(spark, root).customer.select(
        "c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("per_node_max"))
    return A.credit_policy_check(c, 1_000_000)


@register("prefix_rollup", """
SELECT lang, source, count(*) AS n, count(DISTINCT md5(text)) AS n_distinct
FROM documents GROUP BY ROLLUP (lang, source)""")
def q_prefix_rollup(spark, root):
    d = Tables(spark, root).documents.withColumn("text_md5", F.md5("text"))
    return A.prefix_rollup(d, ["lang", "source"], "text_md5").select("lang", "source", "n",
                                                                     "n_distinct")


@register("elite_archive", """
SELECT size_bucket, p_brand, arg_max(p_retailprice, (p_retailprice, -p_partkey)) AS fitness,
       arg_max(p_partkey, (p_retailprice, -p_partkey)) AS p_partkey, count(*) AS n_programs
FROM (SELECT p_size // 10 AS size_bucket, * FROM part) GROUP BY ALL""")
def q_elite(spark, root):
    p = Tables(spark, root).part.withColumn("size_bucket", (F.col("p_size") / 10).cast("int"))
    return A.elite_archive(p, ["size_bucket", "p_brand"], "p_retailprice", "p_partkey")


@register("elite_progress", """
WITH g AS (SELECT p_partkey // 100 AS generation, p_size // 10 AS size_bucket, * FROM part),
first_seen AS (SELECT size_bucket, p_brand, min(generation) AS generation FROM g GROUP BY ALL),
cov AS (SELECT generation, count(*) AS new_cells FROM first_seen GROUP BY 1),
best AS (SELECT generation, max(p_retailprice) AS best_fitness FROM g GROUP BY 1)
SELECT generation, best_fitness,
       max(best_fitness) OVER (ORDER BY generation) AS running_best,
       CAST(sum(coalesce(new_cells, 0)) OVER (ORDER BY generation) AS BIGINT) AS coverage
FROM best LEFT JOIN cov USING (generation)""")
def q_elite_progress(spark, root):
    p = (Tables(spark, root).part.withColumn("size_bucket", (F.col("p_size") / 10).cast("int"))
         .withColumn("generation", (F.col("p_partkey") / 100).cast("long")))
    return A.elite_progress(p, ["size_bucket", "p_brand"], "p_retailprice", "generation")
