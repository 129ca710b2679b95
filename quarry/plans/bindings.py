"""Bindings of operator roles to the provided tables, Spark side and SQL side.

Each binding is a deterministic expression over the fixture tables; the SQL
string next to it is the DuckDB twin used by the oracles.  Small
configuration tables (agent weights, providers, roles) are the documented
configuration of the reference and are bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.tables import Tables

# ------------------------------------------------------------------ jobs
PRIORITY_CATEGORY = {"1-URGENT": ("embedding", "fp32"), "2-HIGH": ("embedding", "fp16"),
                     "3-MEDIUM": ("embedding", "int8"), "4-NOT SPECIFIED": ("rerank", "fp32"),
                     "5-LOW": ("rerank", "fp16")}


def jobs(t: Tables) -> DataFrame:
    """orders as jobs: id, publisher, value (cents), offered_at, category, precision."""
    o = t.orders
    cat = F.lit(None).cast("string")
    prec = F.lit(None).cast("string")
    for k, (c, p) in PRIORITY_CATEGORY.items():
        cat = F.when(F.col("o_orderpriority") == k, F.lit(c)).otherwise(cat)
        prec = F.when(F.col("o_orderpriority") == k, F.lit(p)).otherwise(prec)
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("publisher"),
                    F.round(F.col("o_totalprice") * 100).cast("long").alias("value"),
                    F.col("o_orderdate").alias("offered_at"), cat.alias("category"),
                    prec.alias("precision"), F.col("o_orderstatus").alias("status"))


def _case(col: str, mapping: dict, idx: int) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v[idx]}'" for k, v in mapping.items())
    return f"CASE {col} {arms} END"


JOBS_SQL = f"""jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS publisher,
         CAST(round(o_totalprice * 100) AS BIGINT) AS value, o_orderdate AS offered_at,
         {_case('o_orderpriority', PRIORITY_CATEGORY, 0)} AS category,
         {_case('o_orderpriority', PRIORITY_CATEGORY, 1)} AS precision,
         o_orderstatus AS status
  FROM orders)"""


def job_workers(t: Tables) -> DataFrame:
    """worker = min(l_suppkey) per order, pool = the worker's nation."""
    w = t.lineitem.groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.min("l_suppkey").alias("worker"))
    s = t.supplier.select(F.col("s_suppkey").alias("worker"), F.col("s_nationkey").alias("pool"))
    return w.join(s, "worker", "left")


JOB_WORKERS_SQL = """job_workers AS (
  SELECT w.job_id, w.worker, s.s_nationkey AS pool
  FROM (SELECT l_orderkey AS job_id, min(l_suppkey) AS worker FROM lineitem GROUP BY 1) w
  LEFT JOIN supplier s ON s.s_suppkey = w.worker)"""


# ------------------------------------------------------------------ audits
def audits(t: Tables) -> DataFrame:
    """lineitem as audit outcomes of node l_suppkey, with a total order."""
    li = t.lineitem
    passed = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_discount") < 0.095).otherwise(
        F.col("l_discount") < 0.085)
    return li.select(
        F.col("l_suppkey").alias("node"), F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber"), F.col("l_partkey"), F.col("l_shipdate").alias("audit_ts"),
        passed.alias("pass"),
        F.when(passed, F.lit(0.0)).otherwise(F.round(F.lit(0.1) + F.col("l_tax") * 11.25, 4))
        .alias("severity"))


AUDIT_ORDER = ["audit_ts", "job_id", "l_linenumber", "l_partkey"]

AUDITS_SQL = """audits AS (
  SELECT l_suppkey AS node, l_orderkey AS job_id, l_linenumber, l_partkey, l_shipdate AS audit_ts,
         CASE WHEN l_suppkey % 2 = 0 THEN l_discount < 0.095 ELSE l_discount < 0.085 END AS pass,
         CASE WHEN (CASE WHEN l_suppkey % 2 = 0 THEN l_discount < 0.095
                         ELSE l_discount < 0.085 END) THEN 0.0
              ELSE round(0.1 + l_tax * 11.25, 4) END AS severity
  FROM lineitem)"""

# ------------------------------------------------------------------ review checks
# Reviewer agents in configuration order with weight and the
# required flag.
AGENTS = [
    ("security", 2.0, True), ("compliance", 2.0, True), ("business_logic", 2.0, True),
    ("performance", 1.5, False), ("testing", 1.5, False), ("architecture", 1.5, False),
    ("dependencies", 1.5, False), ("maintainability", 1.5, False),
    ("documentation", 1.0, False), ("accessibility", 1.0, False), ("const", 1.0, False),
    ("style", 0.5, False),
]


def agents_df(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, n, w, r, True) for i, (n, w, r) in enumerate(AGENTS)]
    return spark.createDataFrame(
        rows, "agent_no int, agent string, weight double, required boolean, enabled boolean")


AGENTS_SQL = "agents AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i + 1}, '{n}', {w}, {str(r).upper()}, TRUE)" for i, (n, w, r) in enumerate(AGENTS)
) + ") v(agent_no, agent, weight, required, enabled))"


# (l_orderkey, l_linenumber, l_partkey, l_suppkey) is not always unique: the
# kept row is the greatest under the whole row, so the pick is deterministic.
CHECK_TIEBREAK = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                  "l_returnflag", "l_linestatus", "l_shipdate"]


def checks(t: Tables) -> DataFrame:
    """lineitem as review checks: change l_orderkey, agent l_linenumber; one row
    per (change, agent): the greatest (l_partkey, l_suppkey)."""
    li = t.lineitem
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
        *[F.col(c).desc() for c in CHECK_TIEBREAK])
    fail = F.col("l_returnflag") == "R"
    sev = (F.when(~fail, F.lit("LOW"))
           .when((F.col("l_linestatus") == "O") & (F.col("l_tax") >= 0.07), F.lit("CRITICAL"))
           .when(F.col("l_linestatus") == "O", F.lit("HIGH")).otherwise(F.lit("MEDIUM")))
    return (li.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select(F.col("l_orderkey").alias("change_id"), F.col("l_linenumber").alias("agent_no"),
                    F.when(fail, F.lit("FAIL")).otherwise(F.lit("PASS")).alias("verdict"),
                    F.round(F.lit(1.0) - F.col("l_discount"), 2).alias("confidence"),
                    sev.alias("severity"), F.col("l_quantity").cast("int").alias("lines"),
                    F.col("l_partkey"), F.col("l_suppkey")))


CHECKS_SQL = """checks AS (
  SELECT l_orderkey AS change_id, l_linenumber AS agent_no,
         CASE WHEN l_returnflag = 'R' THEN 'FAIL' ELSE 'PASS' END AS verdict,
         round(1.0 - l_discount, 2) AS confidence,
         CASE WHEN l_returnflag <> 'R' THEN 'LOW'
              WHEN l_linestatus = 'O' AND l_tax >= 0.07 THEN 'CRITICAL'
              WHEN l_linestatus = 'O' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         CAST(l_quantity AS INTEGER) AS lines, l_partkey, l_suppkey
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                     ORDER BY """ + ", ".join(f"{c} DESC" for c in CHECK_TIEBREAK) + """) AS rn
        FROM lineitem) WHERE rn = 1)"""

# ------------------------------------------------------------------ providers
# Provider budget configuration (limits in tokens, 0 = unlimited).
PROVIDERS = [
    # provider, tier, strength, daily_limit, weekly_limit, cost_per_m_token
    ("claude", "cloud", 0.95, 200000, 1000000, 3.00),
    ("openai", "cloud", 0.85, 300000, 1500000, 2.50),
    ("gemini", "cloud", 0.80, 500000, 2000000, 1.25),
    ("local", "local", 0.45, 0, 0, 0.0),
]


def providers_df(spark: SparkSession) -> DataFrame:
    rows = [(i, *p) for i, p in enumerate(PROVIDERS)]
    return spark.createDataFrame(
        rows, "provider_no int, provider string, tier string, strength double, "
              "daily_limit long, weekly_limit long, cost_per_m_token double")


PROVIDERS_SQL = "providers AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{p[0]}', '{p[1]}', CAST({p[2]} AS DOUBLE), CAST({p[3]} AS BIGINT), "
    f"CAST({p[4]} AS BIGINT), CAST({p[5]} AS DOUBLE))"
    for i, p in enumerate(PROVIDERS)
) + ") v(provider_no, provider, tier, strength, daily_limit, weekly_limit, cost_per_m_token))"


def calls(t: Tables) -> DataFrame:
    """orders as provider calls: provider = o_custkey % 4, tokens = round(o_totalprice)."""
    return t.orders.select(F.col("o_orderkey").alias("call_id"),
                           (F.col("o_custkey") % 4).cast("int").alias("provider_no"),
                           F.round("o_totalprice").cast("long").alias("tokens"),
                           F.col("o_orderdate").alias("ts"),
                           F.col("o_orderpriority").alias("priority"))


CALLS_SQL = """calls AS (
  SELECT o_orderkey AS call_id, CAST(o_custkey % 4 AS INTEGER) AS provider_no,
         CAST(round(o_totalprice) AS BIGINT) AS tokens, o_orderdate AS ts,
         o_orderpriority AS priority FROM orders)"""

# ------------------------------------------------------------------ events
def restart_samples(t: Tables) -> DataFrame:
    """Running count of error events per user as a restart counter."""
    from quarry.operators.windows import epoch_seconds, segmented_running
    e = t.events
    r = segmented_running(e, "user_id", ["ts", "event_id"], F.floor(epoch_seconds("ts") / 86400),
                          {"restart_count": F.when(F.col("event_type") == "error", 1)
                           .otherwise(0).cast("long")})
    return r.select(F.col("user_id").alias("container_id"), "event_id", "ts",
                    epoch_seconds("ts").alias("epoch"), "restart_count")


RESTARTS_SQL = """restarts AS (
  SELECT user_id AS container_id, event_id, ts, epoch_us(ts) // 1000000 AS epoch,
         CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id ORDER BY ts, event_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS restart_count
  FROM events)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

