"""Bound window, top-k, set and sampling queries (ops 67-90) and SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.functions.text import sql_tokens, tokens
from quarry.operators import aggs as A
from quarry.operators import retrieval as R
from quarry.operators import sets as X
from quarry.operators import topk as K
from quarry.operators import windows as W
from quarry.plans import bindings as B
from quarry.plans.q_relational import CENTROIDS_SQL, POOLS_SQL, pools_df
from quarry.plans.q_retrieval import BM25_SQL
from quarry.plans.q_scalars import PLANTED_SQL, planted
from quarry.plans.registry import register
from quarry.sources.tables import Tables


def r6(c):
    return F.round(c, 6)


MONTH_S = 30 * 86400
AUDIT_KEYS = ["node", "job_id", "l_linenumber", "l_partkey"]


def month_segment(ts: str):
    return F.floor(W.epoch_seconds(ts) / MONTH_S)


# ------------------------------------------------------------------ 67
RESTART_WINDOW_S = 3 * 86400
RESTART_THRESHOLD = 2


@register("restart_delta", B.with_sql(B.RESTARTS_SQL) + f"""
SELECT container_id, event_id,
       restart_count - first_value(restart_count) OVER (
         PARTITION BY container_id ORDER BY epoch
         RANGE BETWEEN {RESTART_WINDOW_S} PRECEDING AND CURRENT ROW) AS delta,
       restart_count - first_value(restart_count) OVER (
         PARTITION BY container_id ORDER BY epoch
         RANGE BETWEEN {RESTART_WINDOW_S} PRECEDING AND CURRENT ROW) > {RESTART_THRESHOLD} AS breach
FROM restarts""")
def q_restart_delta(spark, root):
    s = B.restart_samples(Tables(spark, root))
    out = W.restart_delta(s, "container_id", "epoch", "restart_count", RESTART_WINDOW_S,
                          RESTART_THRESHOLD)
    return out.select("container_id", "event_id", "delta", "breach")


# ------------------------------------------------------------------ 68-72
AUDIT_ORDER = B.AUDIT_ORDER
_AUDIT_ORDER_SQL = "audit_ts, job_id, l_linenumber, l_partkey"

ROLLING_SQL = f"""rolling AS (
  SELECT node, job_id, l_linenumber, l_partkey,
         avg(CASE WHEN pass THEN 0.0 ELSE 1.0 END) OVER (
           PARTITION BY node ORDER BY {_AUDIT_ORDER_SQL} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)
           AS fail_rate,
         max(severity) OVER (
           PARTITION BY node ORDER BY {_AUDIT_ORDER_SQL} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
           AS max_sev_recent
  FROM audits)"""


def _rolling(t):
    a = B.audits(t)
    return W.rolling_fail_rate(a, "node", AUDIT_ORDER, month_segment("audit_ts"), 100, 10)


@register("rolling_fail_rate", B.with_sql(B.AUDITS_SQL, ROLLING_SQL) + """
SELECT node, job_id, l_linenumber, l_partkey, round(fail_rate, 6) AS fail_rate, max_sev_recent
FROM rolling""")
def q_rolling(spark, root):
    r = _rolling(Tables(spark, root))
    return r.select(*AUDIT_KEYS, r6(F.col("fail_rate")).alias("fail_rate"), "max_sev_recent")


EMA_N = 1000
EMA_A = 2.0 / (EMA_N + 1)
EMA_LQ = math.log(1.0 - EMA_A)
EMA_ORDER = ["audit_ts", "job_id", "l_linenumber", "l_partkey", "node"]

EMA_SQL = f"""fraud AS (
  SELECT a.*, j.category, CASE WHEN a.pass THEN 0.0 ELSE 1.0 END AS x,
         row_number() OVER (PARTITION BY j.category
                            ORDER BY a.audit_ts, a.job_id, a.l_linenumber, a.l_partkey, a.node) AS i
  FROM audits a JOIN jobs j USING (job_id)),
ema AS (
  SELECT node, job_id, l_linenumber, l_partkey, category,
         exp(({EMA_LQ!r}) * i) * sum(CASE WHEN i = 1 THEN x ELSE {EMA_A!r} * x END * exp(({-EMA_LQ!r}) * i))
           OVER (PARTITION BY category ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
           AS ema
  FROM fraud)"""


def _fraud_ema(t):
    a = B.audits(t).join(B.jobs(t).select("job_id", "category"), "job_id")
    a = a.withColumn("x", F.when(F.col("pass"), 0.0).otherwise(1.0))
    return W.ema(a, "category", EMA_ORDER, "x", EMA_N, segment=month_segment("audit_ts"))


@register("ema", B.with_sql(B.AUDITS_SQL, B.JOBS_SQL, EMA_SQL) + """
SELECT node, job_id, l_linenumber, l_partkey, category, round(ema, 6) AS ema FROM ema""")
def q_ema(spark, root):
    e = _fraud_ema(Tables(spark, root))
    return e.select(*AUDIT_KEYS, "category", r6(F.col("ema")).alias("ema"))


@register("audit_rate", B.with_sql(B.AUDITS_SQL, B.JOBS_SQL, ROLLING_SQL, EMA_SQL) + """
SELECT node, job_id, l_linenumber, l_partkey,
       round(least(greatest(0.05
         + CASE WHEN max_sev_recent > 0.5 THEN 1.0 ELSE fail_rate * 0.95 END
         + CASE WHEN ema <= 0 THEN 0.0 WHEN ema <= 0.1 THEN ema * 5.0
                WHEN ema < 0.5 THEN 0.5 + (ema - 0.1) * 1.25 ELSE 1.0 END, 0.005), 1.0), 6)
         AS audit_rate
FROM rolling JOIN ema USING (node, job_id, l_linenumber, l_partkey)""")
def q_audit_rate(spark, root):
    t = Tables(spark, root)
    j = _rolling(t).select(*AUDIT_KEYS, "fail_rate", "max_sev_recent").join(
        _fraud_ema(t).select(*AUDIT_KEYS, "ema"), AUDIT_KEYS)
    return W.audit_rate(j).select(*AUDIT_KEYS, r6(F.col("audit_rate")).alias("audit_rate"))


@register("reputation", B.with_sql(B.AUDITS_SQL) + f""",
a AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {_AUDIT_ORDER_SQL}) AS i,
             CASE WHEN pass THEN 1 ELSE -10 END AS step FROM audits),
r AS (
  WITH RECURSIVE fold(node, i, rep) AS (
    SELECT node, i, greatest(0, step) FROM a WHERE i = 1
    UNION ALL
    SELECT a.node, a.i, greatest(0, fold.rep + a.step)
    FROM fold JOIN a ON a.node = fold.node AND a.i = fold.i + 1)
  SELECT * FROM fold)
SELECT a.node, a.job_id, a.l_linenumber, a.l_partkey, CAST(r.rep AS BIGINT) AS reputation
FROM a JOIN r USING (node, i)""")
def q_reputation(spark, root):
    a = B.audits(Tables(spark, root))
    return W.reputation(a, "node", AUDIT_ORDER, month_segment("audit_ts")).select(*AUDIT_KEYS,
                                                                             "reputation")


@register("reputation_signed", B.with_sql(B.AUDITS_SQL) + f"""
SELECT node, job_id, l_linenumber, l_partkey, score, default_count,
       default_count >= 10 AS burned, score < 0 AS blocked
FROM (SELECT *, CAST(sum(CASE WHEN pass THEN 1 ELSE -1 END) OVER w AS BIGINT) AS score,
             CAST(sum(CASE WHEN pass THEN 0 ELSE 1 END) OVER w AS BIGINT) AS default_count
      FROM audits
      WINDOW w AS (PARTITION BY node ORDER BY {_AUDIT_ORDER_SQL}
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def q_reputation_signed(spark, root):
    a = B.audits(Tables(spark, root))
    out = W.reputation_signed(a, "node", AUDIT_ORDER, month_segment("audit_ts"))
    return out.select(*AUDIT_KEYS, "score", "default_count", "burned", "blocked")


# ------------------------------------------------------------------ 73-79
JOURNAL_AMOUNT = ("CASE o_orderstatus WHEN 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) "
                  "WHEN 'O' THEN -CAST(round(o_totalprice * 60) AS BIGINT) ELSE CAST(0 AS BIGINT) END")


@register("running_balance", f"""
SELECT o_custkey, o_orderkey, balance, balance < 0 AS overdraft
FROM (SELECT o_custkey, o_orderkey,
             CAST(sum({JOURNAL_AMOUNT}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance
      FROM orders)""")
def q_running_balance(spark, root):
    o = Tables(spark, root).orders.withColumn("signed_amount", F.expr(JOURNAL_AMOUNT))
    seg = F.floor(W.epoch_seconds("o_orderdate") / (365 * 86400))
    out = W.running_balance(o, "o_custkey", ["o_orderdate", "o_orderkey"], seg)
    return out.select("o_custkey", "o_orderkey", "balance", "overdraft")


@register("rolling_volume", B.with_sql(B.JOBS_SQL, B.JOB_WORKERS_SQL) + """
SELECT job_id, pool, CAST(sum(value) OVER (PARTITION BY pool ORDER BY offered_at
                     RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS volume_30d
FROM jobs JOIN job_workers USING (job_id)""")
def q_rolling_volume(spark, root):
    t = Tables(spark, root)
    s = B.jobs(t).join(B.job_workers(t), "job_id").select("job_id", "pool", "offered_at", "value")
    return W.rolling_volume(s, "pool", "offered_at", "value", 30).select("job_id", "pool",
                                                                          "volume_30d")


@register("tier_changes", POOLS_SQL + """,
monthly AS (SELECT w.pool, date_trunc('month', j.offered_at) AS month, sum(j.value) / 100.0 AS volume
            FROM jobs j JOIN job_workers w USING (job_id) GROUP BY ALL),
readings AS (
  SELECT m.pool, m.month,
         greatest(CASE WHEN p.total_stake <= 10000 THEN 2 WHEN p.total_stake <= 100000 THEN 3
                       WHEN p.total_stake <= 1000000 THEN 4 ELSE 5 END,
                  CASE WHEN p.members <= 50 THEN 2 WHEN p.members <= 500 THEN 3
                       WHEN p.members <= 5000 THEN 4 ELSE 5 END,
                  CASE WHEN m.volume <= 1000 THEN 2 WHEN m.volume <= 10000 THEN 3
                       WHEN m.volume <= 100000 THEN 4 ELSE 5 END) AS tier
  FROM monthly m JOIN pools p USING (pool))
SELECT pool, month, tier, prev_tier
FROM (SELECT *, lag(tier) OVER (PARTITION BY pool ORDER BY month) AS prev_tier FROM readings)
WHERE prev_tier IS NOT NULL AND prev_tier <> tier""")
def q_tier_changes(spark, root):
    t = Tables(spark, root)
    monthly = (B.jobs(t).join(B.job_workers(t), "job_id")
               .groupBy("pool", F.date_trunc("month", "offered_at").cast("timestamp_ntz").alias("month"))
               .agg((F.sum("value") / 100.0).alias("volume")))
    p = pools_df(t).select("pool", "members", "total_stake")
    readings = A.pool_tier(monthly.join(p, "pool")).select("pool", "month", "tier")
    return W.tier_changes(readings, "pool", ["month"], "tier").select("pool", "month", "tier",
                                                                     "prev_tier")


CARD_STATE = {"signup": "unclaimed", "view": "claimed", "click": "claimed", "purchase": "done",
              "error": "failed"}
ALLOWED = [("unclaimed", "claimed"), ("claimed", "done"), ("claimed", "failed"),
           ("claimed", "unclaimed"), ("failed", "unclaimed")]
_STATE_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CARD_STATE.items()) \
    + " END"


@register("lifecycle_check", f"""
WITH e AS (SELECT user_id, event_id, ts, {_STATE_CASE} AS to_state FROM events),
t AS (SELECT user_id, event_id, coalesce(lag(to_state) OVER (PARTITION BY user_id ORDER BY ts, event_id),
                                         'unclaimed') AS from_state, to_state FROM e)
SELECT user_id, event_id, from_state, to_state FROM t
WHERE (from_state, to_state) NOT IN (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in ALLOWED)}))""")
def q_lifecycle(spark, root):
    e = Tables(spark, root).events
    state = F.lit(None).cast("string")
    for k, v in CARD_STATE.items():
        state = F.when(F.col("event_type") == k, F.lit(v)).otherwise(state)
    ev = e.select("user_id", "event_id", "ts", state.alias("state"))
    allowed = spark.createDataFrame(ALLOWED, "from_state string, to_state string")
    return W.lifecycle_check(ev, "user_id", ["ts", "event_id"], "state", allowed).select(
        "user_id", "event_id", "from_state", "to_state")


@register("stage_durations", """
WITH d AS (SELECT user_id, event_type,
                  coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000000
                           - epoch_us(ts) // 1000000, 0) AS dur FROM events),
per AS (SELECT user_id, event_type, CAST(sum(dur) AS BIGINT) AS seconds FROM d GROUP BY ALL)
SELECT user_id, event_type, seconds,
       round(CASE WHEN sum(seconds) OVER (PARTITION BY user_id) > 0
                  THEN seconds / sum(seconds) OVER (PARTITION BY user_id) END, 6) AS share
FROM per""")
def q_stage(spark, root):
    e = Tables(spark, root).events
    out = W.stage_durations(e, "user_id", "ts", "event_type", "event_id")
    return out.select("user_id", "event_type", "seconds", r6(F.col("share")).alias("share"))


QUEUE_DELTA = "CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type = 'purchase' THEN -1 ELSE 0 END"


@register("queue_depth", f"""
SELECT user_id // 10 AS queue, event_id,
       CAST(sum({QUEUE_DELTA}) OVER (PARTITION BY user_id // 10 ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS depth
FROM events""")
def q_queue_depth(spark, root):
    e = Tables(spark, root).events.withColumn("queue", (F.col("user_id") / 10).cast("long"))
    seg = F.floor(W.epoch_seconds("ts") / 86400)
    out = W.queue_depth(e, "queue", ["ts", "event_id"], seg, F.expr(QUEUE_DELTA))
    return out.select("queue", "event_id", "depth")


@register("rank_variants", """
WITH runs AS (SELECT l_returnflag AS grp, l_linestatus AS variant, round(avg(l_discount), 9) AS ppl,
                     round(avg(l_quantity), 9) AS wall FROM lineitem GROUP BY ALL)
SELECT grp, variant, dense_rank() OVER (PARTITION BY grp ORDER BY ppl) AS rank_ppl,
       dense_rank() OVER (PARTITION BY grp ORDER BY wall) AS rank_wall FROM runs""")
def q_rank_variants(spark, root):
    li = Tables(spark, root).lineitem
    runs = li.groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("variant")).agg(
        F.round(F.avg("l_discount"), 9).alias("ppl"), F.round(F.avg("l_quantity"), 9).alias("wall"))
    out = W.rank_variants(runs, "grp", ["ppl", "wall"])
    return out.select("grp", "variant", F.col("rank_ppl").cast("long").alias("rank_ppl"),
                      F.col("rank_wall").cast("long").alias("rank_wall"))


# ------------------------------------------------------------------ 80-84
TOK = sql_tokens("text")


@register("rerank", BM25_SQL.replace("WHERE rank <= 10", "WHERE rank <= 20").replace(
    "SELECT item_id, rank, doc_id, round(score, 6) AS score FROM ranked",
    "SELECT item_id, rank AS idx, doc_id FROM ranked").replace("WITH doc_tok", "WITH cands AS (WITH doc_tok", 1)
    + f"""),
qt AS (SELECT item_id, list_distinct({TOK}) AS qt FROM benchmark),
dt AS (SELECT doc_id, list_distinct({TOK}) AS dt FROM documents),
scored AS (SELECT c.item_id, c.idx, c.doc_id,
                  1.0 / (1.0 + exp(-(len(list_intersect(qt.qt, dt.dt)) / sqrt(len(qt.qt)) - 3.0))) AS s
           FROM cands c JOIN qt USING (item_id) JOIN dt USING (doc_id)),
ranked2 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, idx) AS rank FROM scored)
SELECT item_id, rank, doc_id, CAST(idx AS BIGINT) AS idx, round(s, 6) AS score FROM ranked2 WHERE rank <= 5""")
def q_rerank(spark, root):
    t = Tables(spark, root)
    cands = R.bm25(t.benchmark, t.documents, k=20, cluster=["lang"]).select("item_id", F.col("rank").alias("idx"),
                                                          "doc_id")
    qt = t.benchmark.select("item_id", F.array_distinct(tokens("text")).alias("qt"))
    dt = t.documents.select("doc_id", F.array_distinct(tokens("text")).alias("dt"))
    pairs = cands.join(qt, "item_id").join(dt, "doc_id")
    raw = F.size(F.array_intersect("qt", "dt")) / F.sqrt(F.size("qt")) - 3.0
    out = K.rerank(pairs.withColumn("raw", raw), "raw", "item_id", "idx", 5)
    return out.select("item_id", "rank", "doc_id", "idx", r6(F.col("score")).alias("score"))


@register("representatives", B.with_sql(PLANTED_SQL, CENTROIDS_SQL) + """,
d AS (SELECT p.label, p.vec_id,
             sqrt(list_sum(list_transform(list_zip(p.vector, c.centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))
               AS dist
      FROM planted p JOIN cent c USING (label))
SELECT label, rank, vec_id, round(dist, 6) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rank FROM d)
WHERE rank <= 3""")
def q_representatives(spark, root):
    from quarry.operators.clustering import representatives
    p = planted(Tables(spark, root))
    out = representatives(p, "label", "vec_id", "vector", k=3)
    return out.select("label", "rank", "vec_id", r6(F.col("dist")).alias("dist"))


CARD_COLUMNS = [("O", "ready"), ("F", "done"), ("P", "in_progress")]
# cards of low priority are the ones nobody has claimed yet
CLAIM_SQL = ("CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'unclaimed' "
             "ELSE 'claimed' END")


@register("ready_cards", f"""
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position
FROM (SELECT *, {CLAIM_SQL} AS claim_status FROM orders)
WHERE claim_status = 'unclaimed' AND o_orderstatus IN
  (SELECT c FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in CARD_COLUMNS)}) v(c, n) WHERE n = 'ready')""")
def q_ready(spark, root):
    o = Tables(spark, root).orders
    cards = o.select("o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("column_id"),
                     F.expr(CLAIM_SQL).alias("claim_status"))
    cols = spark.createDataFrame(CARD_COLUMNS, "column_id string, column_name string")
    r = K.ready_cards(cards, cols)
    # position = rank in the ready column, computed by a range-partitioned sort
    return K.positions(r.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "position")


@register("filtered_page", """
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def q_page(spark, root):
    o = Tables(spark, root).orders
    return K.filtered_page(o, "o_orderstatus", "O", "o_orderdate", "o_orderkey", 50).select(
        "o_orderkey", "o_orderdate")


@register("keep_last", """
SELECT user_id, event_id, pos FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)
         AS pos FROM events) WHERE pos <= 20""")
def q_keep_last(spark, root):
    e = Tables(spark, root).events
    return K.keep_last(e, "user_id", "ts", "event_id", 20).select(
        "user_id", "event_id", F.col("pos").cast("long").alias("pos"))


# ------------------------------------------------------------------ 85-90
@register("set_compare", """
WITH a AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size <= 25),
b AS (SELECT DISTINCT p_name AS name FROM part WHERE p_retailprice > 1500)
SELECT coalesce(a.name, b.name) AS name, a.name IS NOT NULL AS in_a, b.name IS NOT NULL AS in_b
FROM a FULL OUTER JOIN b ON a.name = b.name""")
def q_set_compare(spark, root):
    p = Tables(spark, root).part
    a = p.filter(F.col("p_size") <= 25).select(F.col("p_name").alias("name"))
    b = p.filter(F.col("p_retailprice") > 1500).select(F.col("p_name").alias("name"))
    return X.set_compare(a, b, "name")


@register("federate_hits", f"""
WITH keyed AS (SELECT doc_id, source,
                      {S.sql_title_key('split_part(text, chr(10), 1)')} AS bib_key, n_chars FROM documents),
hits AS (SELECT bib_key, source,
                row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM keyed)
SELECT bib_key, min(rank) AS best_rank, list_sort(list_distinct(list(source))) AS sources,
       count(*) AS n_hits
FROM hits GROUP BY bib_key""")
def q_federate(spark, root):
    d = Tables(spark, root).documents
    title = F.substring_index("text", "\n", 1)
    keyed = d.select("doc_id", "source", "n_chars",
                     S.bib_key(F.lit(""), F.lit(""), title).alias("bib_key"))
    # one hit list per source, ranked within the source (longest first)
    ranked = K.positions(keyed, [F.col("n_chars").desc(), F.col("doc_id")], "rank", by="source")
    lists = [ranked.filter(F.col("source") == s).select("bib_key", "source", "rank")
             for s in ("src0", "src1")]
    rest = ranked.filter(~F.col("source").isin("src0", "src1")).select("bib_key", "source", "rank")
    return X.federate_hits(lists + [rest], "bib_key", "rank", "source")


@register("dedup_keyed", """
SELECT md5(text) AS key, arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source,
       count(*) AS n_copies
FROM documents GROUP BY 1""")
def q_dedup(spark, root):
    d = Tables(spark, root).documents.select("doc_id", "source", F.md5("text").alias("_k"))
    out = X.dedup_keyed(d, "_k", "doc_id")
    return out.select("key", "doc_id", "source", "n_copies")


HIGH_VALUE_CENTS = 45_000_000
BASE_RATE = 0.05


@register("audit_sample", B.with_sql(B.JOBS_SQL) + f"""
SELECT job_id, u, value >= {HIGH_VALUE_CENTS} OR u < {BASE_RATE} AS audited,
       CASE WHEN value >= {HIGH_VALUE_CENTS} THEN 'forced' WHEN u < {BASE_RATE} THEN 'sampled'
            ELSE 'none' END AS reason
FROM (SELECT job_id, value,
             ('0x' || substr(md5(CAST(job_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS u
      FROM jobs)""")
def q_audit_sample(spark, root):
    j = B.jobs(Tables(spark, root))
    return X.audit_sample(j, "job_id", "value", BASE_RATE, HIGH_VALUE_CENTS).select(
        "job_id", "u", "audited", "reason")


@register("split_by_tokens", """
SELECT doc_id, source,
       CASE WHEN cum - tok < 5000 THEN 'test' WHEN cum - tok < 10000 THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, source, greatest(1, length(text) // 4) AS tok,
             sum(greatest(1, length(text) // 4)) OVER (PARTITION BY source ORDER BY doc_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
      FROM documents)""")
def q_split(spark, root):
    d = Tables(spark, root).documents.withColumn("tok", S.approx_tokens("text"))
    out = X.split_by_tokens(d.select("doc_id", "source", "tok"), "source", ["doc_id"], "tok", 5000, 5000)
    return out.select("doc_id", "source", "split")


@register("preference_pairs", """
WITH d AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic
           FROM documents d JOIN labels l USING (doc_id)),
p AS (SELECT * FROM d WHERE quality = 1 AND toxic = 0),
r AS (SELECT * FROM d WHERE quality = 0),
c AS (SELECT p.lang, p.doc_id AS chosen_id, r.doc_id AS rejected_id, p.n_chars - r.n_chars AS length_gap,
             row_number() OVER (PARTITION BY p.doc_id ORDER BY abs(p.n_chars - r.n_chars), r.n_chars, r.doc_id) AS k
      FROM p JOIN r ON p.lang = r.lang)
SELECT lang, chosen_id, rejected_id, length_gap FROM c WHERE k = 1""")
def q_pref(spark, root):
    t = Tables(spark, root)
    d = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    return X.preference_pairs(d, "lang", "n_chars", "doc_id",
                              (F.col("quality") == 1) & (F.col("toxic") == 0),
                              F.col("quality") == 0)
