"""Bound marketplace and ledger queries (ops 41, 58-60, 110-113) and SQL twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quarry.operators import aggs as A
from quarry.operators import market as M
from quarry.plans import bindings as B
from quarry.plans.registry import register
from quarry.sources.tables import Tables

DEPOSIT_SCALE = 200          # deposit = round(s_acctbal * 100) * 200 cents
HIGH_VALUE = 45_000_000      # cents
AUDIT_RATE = 0.5
DEPOSIT_AT = dt.datetime(1990, 1, 1)


def deposits(t: Tables):
    """Registered deposits per supplier; non-positive balances are rejected."""
    s = t.supplier.select(F.col("s_suppkey").alias("worker"),
                          F.round(F.col("s_acctbal") * 100).cast("long").alias("_c"))
    return s.filter(F.col("_c") > 0).select("worker", (F.col("_c") * DEPOSIT_SCALE).alias("deposit"))


def outcomes(t: Tables):
    """Audit outcome per job: the worst severity of the worker's lines."""
    a = B.audits(t)
    w = B.job_workers(t).select("job_id", F.col("worker").alias("node"))
    return a.join(w, ["job_id", "node"]).groupBy("job_id").agg(F.max("severity").alias("severity"))


def settled(t: Tables):
    j = B.jobs(t).select("job_id", "publisher", "value", "offered_at")
    return M.settle_jobs(j, B.job_workers(t), outcomes(t), deposits(t), AUDIT_RATE, HIGH_VALUE)


SETTLE_SQL = f"""dep AS (
  SELECT s_suppkey AS worker, CAST(round(s_acctbal * 100) AS BIGINT) * {DEPOSIT_SCALE} AS deposit
  FROM supplier WHERE round(s_acctbal * 100) > 0),
outc AS (SELECT a.job_id, max(a.severity) AS severity
         FROM audits a JOIN job_workers w ON w.job_id = a.job_id AND w.worker = a.node GROUP BY 1),
sj AS (
  SELECT j.job_id, j.publisher, j.value, j.offered_at, w.worker, w.pool, o.severity,
         j.value * {M.STAKE_MULTIPLIER} AS stk,
         CASE WHEN w.worker IS NULL THEN 'rejected_no_worker'
              WHEN coalesce(d.deposit, 0) < j.value * {M.STAKE_MULTIPLIER} THEN 'rejected_cap'
              ELSE 'accepted' END AS status
  FROM jobs j LEFT JOIN job_workers w USING (job_id) LEFT JOIN dep d ON d.worker = w.worker
  LEFT JOIN outc o USING (job_id)),
sa AS (SELECT *, status = 'accepted' AND (value >= {HIGH_VALUE}
              OR ('0x' || substr(md5(CAST(job_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 < {AUDIT_RATE})
              AS audited FROM sj),
sf AS (SELECT *, CASE WHEN audited THEN (CASE WHEN severity IS NULL OR severity <= 0 THEN 0.0
                                              WHEN severity < 0.3 THEN severity
                                              WHEN severity < 0.7 THEN 0.5 + severity / 2 ELSE 1.0 END)
                      ELSE 0.0 END AS fraction FROM sa),
-- what a worker has available, job by job
si AS (SELECT job_id, worker, stk, CAST(round(stk * fraction) AS BIGINT) AS sl,
              CASE WHEN fraction < 1.0 THEN value - CAST(round(value * CAST({M.NETWORK_TAX} AS DOUBLE)) AS BIGINT)
                   - CAST(round(value * CAST({M.POOL_TAX} AS DOUBLE)) AS BIGINT) ELSE 0 END AS pd,
              row_number() OVER (PARTITION BY worker ORDER BY offered_at, job_id) AS i
       FROM sf WHERE status = 'accepted'),
bal AS (
  WITH RECURSIVE b(worker, i, job_id, ok, avail) AS (
    SELECT worker, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), deposit FROM dep
    UNION ALL
    SELECT s.worker, s.i, s.job_id, b.avail >= s.stk,
           b.avail + CASE WHEN b.avail >= s.stk THEN s.pd - s.sl ELSE 0 END
    FROM b JOIN si s ON s.worker = b.worker AND s.i = b.i + 1)
  SELECT job_id, ok FROM b WHERE i > 0),
sb AS (SELECT sf.* REPLACE (CASE WHEN NOT ok THEN 'rejected_balance' ELSE status END AS status,
                            audited AND coalesce(ok, TRUE) AS audited,
                            CASE WHEN NOT ok THEN 0.0 ELSE fraction END AS fraction)
       FROM sf LEFT JOIN bal USING (job_id)),
settled AS (
  SELECT job_id, worker, pool, publisher, offered_at, value, status, audited, fraction,
         CASE WHEN status = 'accepted' THEN stk ELSE 0 END AS stake,
         CASE WHEN status = 'accepted' THEN CAST(round(stk * fraction) AS BIGINT) ELSE 0 END AS slashed,
         CASE WHEN status = 'accepted' THEN stk - CAST(round(stk * fraction) AS BIGINT) ELSE 0 END
           AS returned,
         status = 'accepted' AND fraction < 1.0 AS settled,
         CASE WHEN status = 'accepted' AND fraction < 1.0
              THEN CAST(round(value * CAST({M.NETWORK_TAX} AS DOUBLE)) AS BIGINT) ELSE 0 END AS network_tax,
         CASE WHEN status = 'accepted' AND fraction < 1.0
              THEN CAST(round(value * CAST({M.POOL_TAX} AS DOUBLE)) AS BIGINT) ELSE 0 END AS pool_tax,
         CASE WHEN audited THEN coalesce(severity, 0.0) END AS severity
  FROM sb),
settled2 AS (SELECT *, CASE WHEN settled THEN value - network_tax - pool_tax ELSE 0 END AS paid
             FROM settled)"""

BASE = B.with_sql(B.JOBS_SQL, B.JOB_WORKERS_SQL, B.AUDITS_SQL, SETTLE_SQL)


@register("settle_jobs", BASE + """
SELECT job_id, worker, status, audited, round(fraction, 6) AS fraction, stake, slashed, returned,
       settled, network_tax, pool_tax, paid FROM settled2""")
def q_settle(spark, root):
    s = settled(Tables(spark, root))
    return s.select("job_id", "worker", "status", "audited", F.round("fraction", 6).alias("fraction"),
                    "stake", "slashed", "returned", "settled", "network_tax", "pool_tax", "paid")


@register("job_events", BASE + """
SELECT job_id, worker, pool, event, CAST(amount AS BIGINT) AS amount FROM (
  SELECT job_id, worker, pool,
         unnest(['volume', 'audit_pass', 'audit_fail', 'fraud_report', 'slash', 'settle']) AS event,
         unnest([settled AND pool IS NOT NULL, audited AND severity <= 0, audited AND severity > 0,
                 audited AND severity > 0, slashed > 0, settled]) AS happens,
         unnest([value, 0, 0, stake, slashed, paid]) AS amount FROM settled2)
WHERE happens""")
def q_events(spark, root):
    return M.lifecycle_events(settled(Tables(spark, root))).select("job_id", "worker", "pool", "event", "amount")


JOURNAL_SQL = """journal AS (
  SELECT worker AS node, CAST(NULL AS BIGINT) AS job_id, 'deposit' AS op, deposit AS amount FROM dep
  UNION ALL
  SELECT * FROM (
    SELECT worker, job_id, unnest(['lock', 'release_return', 'release_slash', 'settle_paid',
                                   'settle_tax']) AS op,
           unnest([stake, returned, slashed, paid, network_tax + pool_tax]) AS amount
    FROM settled2 WHERE status = 'accepted') WHERE amount <> 0)"""


def journal(t: Tables):
    return M.journal_rows(settled(t), deposits(t), F.lit(DEPOSIT_AT).cast("timestamp_ntz"))


@register("ledger_balances", BASE + ",\n" + JOURNAL_SQL + """
SELECT node,
  CAST(sum(CASE op WHEN 'deposit' THEN amount WHEN 'withdraw' THEN -amount WHEN 'lock' THEN -amount
                   WHEN 'release_return' THEN amount WHEN 'settle_paid' THEN amount ELSE 0 END) AS BIGINT)
    AS available,
  CAST(sum(CASE op WHEN 'lock' THEN amount WHEN 'release_return' THEN -amount
                   WHEN 'release_slash' THEN -amount ELSE 0 END) AS BIGINT) AS locked,
  CAST(sum(CASE op WHEN 'release_slash' THEN amount WHEN 'settle_tax' THEN amount ELSE 0 END) AS BIGINT)
    AS reserve
FROM journal GROUP BY node""")
def q_balances(spark, root):
    b = A.ledger_balances(journal(Tables(spark, root)))
    return b.select("node", *[F.col(c).cast("long").alias(c) for c in ("available", "locked", "reserve")])


@register("ledger_invariant", BASE + ",\n" + JOURNAL_SQL + """
SELECT held, expected, held = expected AS holds FROM (
  SELECT CAST(sum(CASE op WHEN 'deposit' THEN amount WHEN 'withdraw' THEN -amount
                          WHEN 'lock' THEN -amount WHEN 'release_return' THEN amount
                          WHEN 'settle_paid' THEN amount ELSE 0 END
                  + CASE op WHEN 'lock' THEN amount WHEN 'release_return' THEN -amount
                            WHEN 'release_slash' THEN -amount ELSE 0 END
                  + CASE op WHEN 'release_slash' THEN amount WHEN 'settle_tax' THEN amount ELSE 0 END)
              AS BIGINT) AS held,
         CAST(sum(CASE WHEN op = 'deposit' THEN amount WHEN op = 'withdraw' THEN -amount
                       WHEN op IN ('settle_paid', 'settle_tax') THEN amount ELSE 0 END) AS BIGINT)
           AS expected
  FROM journal)""")
def q_invariant(spark, root):
    g = A.ledger_invariant(journal(Tables(spark, root)))
    return g.select(F.col("held").cast("long").alias("held"),
                    F.col("expected").cast("long").alias("expected"), "holds")


@register("settlement_rollup", BASE + """
SELECT pool, worker, CAST(sum(value) AS BIGINT) AS gross, CAST(sum(network_tax) AS BIGINT) AS network_tax,
       CAST(sum(pool_tax) AS BIGINT) AS pool_tax, CAST(sum(paid) AS BIGINT) AS paid,
       count(*) AS n_jobs, CAST(sum(network_tax) + sum(pool_tax) AS BIGINT) AS reserve_growth
FROM settled2 WHERE settled GROUP BY ROLLUP (pool, worker)""")
def q_rollup(spark, root):
    s = settled(Tables(spark, root)).filter("settled")
    return A.settlement_rollup(s)


@register("pick_verifiers", B.with_sql(B.JOBS_SQL, B.JOB_WORKERS_SQL) + """,
v AS (SELECT s_suppkey AS v, s_nationkey AS p, s_acctbal AS w FROM supplier WHERE s_acctbal > 0),
pools AS (SELECT p, sum(w) AS W, count(*) AS m FROM v GROUP BY p),
j AS (SELECT j.job_id, w.pool AS jp,
             CASE j.category WHEN 'embedding' THEN 3 WHEN 'rerank' THEN 5 END AS n
      FROM jobs j JOIN job_workers w USING (job_id)),
cand AS (SELECT j.*, pools.p,
                -ln((('0x' || substr(md5(CAST(j.job_id AS VARCHAR) || '-pool-' || CAST(pools.p AS VARCHAR)),
                                    1, 8))::BIGINT + 0.5) / 4294967296.0) / pools.W AS key
         FROM j CROSS JOIN pools WHERE pools.p <> j.jp),
avail AS (SELECT job_id, count(*) AS avail FROM cand GROUP BY 1),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY key, p) AS pick_rank
                          FROM cand) WHERE pick_rank <= n),
iv AS (SELECT v, p, coalesce(lag(hi) OVER (PARTITION BY p ORDER BY v), 0.0) AS lo, hi
       FROM (SELECT v, p, cum / max(cum) OVER (PARTITION BY p) AS hi
             FROM (SELECT v, p, sum(w) OVER (PARTITION BY p ORDER BY v
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
                   FROM v))),
hit AS (SELECT c.job_id, iv.v AS verifier, c.p AS pool, c.pick_rank, a.avail < c.n AS short
        FROM (SELECT *, (('0x' || substr(md5(CAST(job_id AS VARCHAR) || '-verifier-' || CAST(p AS VARCHAR)),
                                         1, 8))::BIGINT + 0.5) / 4294967296.0 AS u2 FROM chosen) c
        JOIN avail a USING (job_id)
        JOIN iv ON iv.p = c.p AND c.u2 >= iv.lo AND c.u2 < iv.hi)
SELECT job_id, verifier, pool, pick_rank, short FROM hit""")
def q_pick(spark, root):
    t = Tables(spark, root)
    jobs = B.jobs(t).join(B.job_workers(t), "job_id").select("job_id", "pool", "category")
    ver = t.supplier.select(F.col("s_suppkey").alias("verifier"), F.col("s_nationkey").alias("pool"),
                            F.col("s_acctbal").alias("weight"))
    return M.pick_verifiers(jobs, ver)


NOISE = "CASE WHEN label < 7 THEN 0.0005 ELSE 0.05 END"
CATEGORY = "CASE WHEN label >= 8 THEN 'rerank' ELSE 'embedding' END"
PRECISION = "CASE label % 3 WHEN 0 THEN 'fp32' WHEN 1 THEN 'fp16' ELSE 'int8' END"


# outputs that cannot be compared: empty, of another length, zero
BAD = "CASE WHEN vec_id % 41 = 0 THEN 'empty' WHEN vec_id % 43 = 0 THEN 'short' WHEN vec_id % 47 = 0 THEN 'zero' ELSE '' END"


@register("audit_outcomes", f"""
WITH r0 AS (SELECT vec_id, {CATEGORY} AS category, {PRECISION} AS precision, {BAD} AS bad,
                   list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS ref,
                   list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + ({NOISE}) * sin(vec_id + i - 1)) AS o
            FROM embeddings),
r AS (SELECT *, CASE bad WHEN 'empty' THEN [] WHEN 'short' THEN o[1:10]
                         WHEN 'zero' THEN list_transform(o, lambda x: 0.0::DOUBLE) ELSE o END AS output FROM r0),
emb AS (SELECT vec_id, list_sum(list_transform(list_zip(output, ref), lambda z: z[1] * z[2]))
               / (sqrt(list_sum(list_transform(output, lambda x: x * x)))
                  * sqrt(list_sum(list_transform(ref, lambda x: x * x)))) AS sim
        FROM r WHERE category = 'embedding' AND bad = ''),
ri AS (SELECT vec_id, unnest(output) AS o, unnest(ref) AS f, unnest(range(len(ref))) AS i
       FROM r WHERE category = 'rerank' AND bad IN ('', 'zero')),
tau AS (SELECT x.vec_id, sum(sign(x.o - y.o) * sign(x.f - y.f)) / (count(*)::DOUBLE) AS sim
        FROM ri x JOIN ri y ON x.vec_id = y.vec_id AND x.i < y.i GROUP BY 1),
s AS (SELECT r.vec_id, r.category, r.precision, coalesce(e.sim, t.sim) AS sim,
             CASE WHEN r.category = 'rerank' THEN 0.95 WHEN r.precision = 'fp32' THEN 0.9999
                  WHEN r.precision = 'fp16' THEN 0.999 ELSE 0.99 END AS thr
      FROM r LEFT JOIN emb e USING (vec_id) LEFT JOIN tau t USING (vec_id))
SELECT vec_id, category, precision, round(sim, 6) AS similarity, coalesce(sim >= thr, FALSE) AS pass,
       round(CASE WHEN sim IS NULL THEN 1.0 WHEN sim >= thr THEN 0.0
                  ELSE greatest(0.0, (thr - sim) / thr) END, 6) AS severity
FROM s""")
def q_audit_outcomes(spark, root):
    e = Tables(spark, root).embeddings
    noise, bad = F.expr(NOISE), F.expr(BAD)
    out = F.transform("embedding", lambda x, i: x.cast("double") + noise * F.sin(F.col("vec_id") + i))
    out = (F.when(bad == "empty", F.array().cast("array<double>")).when(bad == "short", F.slice(out, 1, 10))
           .when(bad == "zero", F.transform(out, lambda x: F.lit(0.0))).otherwise(out))
    rec = e.select("vec_id", F.expr(CATEGORY).alias("category"), F.expr(PRECISION).alias("precision"),
                   out.alias("output"))
    ref = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("ref"))
    got = M.audit_outcomes(rec, ref, "vec_id", "output", "ref", "category", "precision")
    return got.select("vec_id", "category", "precision", F.round("similarity", 6).alias("similarity"),
                      "pass", F.round("severity", 6).alias("severity"))


_CUR = "coalesce(list_filter(f.debts, lambda x: x.d = s.debtor)[1].v, 0)"
_OK = f"({_CUR} + s.shortfall <= s.per_node_max AND f.outstanding + s.shortfall <= s.total)"
_REP = (f"CASE WHEN {_OK} AND s.fraction < 1.0 "
        "THEN CAST(floor(s.shortfall * (1.0 - s.fraction) + 0.5) AS BIGINT) ELSE CAST(0 AS BIGINT) END")

# The credit fold as a recursive query per creditor: the state is the
# outstanding total and the list of debts per debtor.
CREDIT_SQL = BASE + f""",
req AS (SELECT st.job_id, st.publisher AS creditor, st.worker AS debtor, st.value, st.offered_at AS at,
               st.fraction, CAST(greatest(round(sp.s_acctbal), 0.0) * 1000 AS BIGINT) AS cap
        FROM settled2 st JOIN supplier sp ON sp.s_suppkey = st.worker),
need AS (SELECT *, greatest(value - cap, 0) AS shortfall FROM req),
pol AS (SELECT c_custkey AS creditor, CAST(greatest(round(c_acctbal), 0.0) * 1000 AS BIGINT) AS per_node_max
        FROM customer WHERE c_custkey % 11 <> 0),
fi AS (SELECT n.*, p.per_node_max, p.per_node_max * 3 AS total,
              row_number() OVER (PARTITION BY n.creditor ORDER BY n.at, n.job_id) AS i
       FROM need n JOIN pol p USING (creditor) WHERE n.shortfall > 0),
fold AS (
  WITH RECURSIVE f(creditor, i, job_id, debtor, shortfall, accepted, repaid, defaulted, outstanding, debts) AS (
    SELECT creditor, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
           CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN),
           CAST(0 AS BIGINT), CAST([] AS STRUCT(d BIGINT, v BIGINT)[])
    FROM fi WHERE i = 1
    UNION ALL
    SELECT s.creditor, s.i, s.job_id, s.debtor, s.shortfall, {_OK}, {_REP},
           {_OK} AND s.fraction >= 1.0,
           f.outstanding + CASE WHEN {_OK} THEN s.shortfall - {_REP} ELSE 0 END,
           CASE WHEN {_OK} THEN list_append(list_filter(f.debts, lambda x: x.d <> s.debtor),
                                          {{'d': s.debtor, 'v': {_CUR} + s.shortfall - {_REP}}})
                ELSE f.debts END
    FROM f JOIN fi s ON s.creditor = f.creditor AND s.i = f.i + 1)
  SELECT * FROM f WHERE i > 0)
SELECT job_id, creditor, debtor, shortfall, accepted, repaid, defaulted, outstanding AS outstanding_after
FROM fold
UNION ALL
SELECT job_id, creditor, debtor, shortfall, TRUE, CAST(0 AS BIGINT), FALSE, CAST(NULL AS BIGINT)
FROM need WHERE shortfall <= 0
UNION ALL
SELECT job_id, creditor, debtor, shortfall, FALSE, CAST(0 AS BIGINT), FALSE, CAST(NULL AS BIGINT)
FROM need WHERE shortfall > 0 AND creditor NOT IN (SELECT creditor FROM pol)"""


@register("credit_lines", CREDIT_SQL)
def q_credit(spark, root):
    t = Tables(spark, root)
    s = settled(t).filter(F.col("worker").isNotNull())
    sup = t.supplier.select(F.col("s_suppkey").alias("worker"),
                            (F.greatest(F.round("s_acctbal"), F.lit(0.0)) * 1000).cast("long").alias("cap"))
    req = s.join(sup, "worker").select(
        "job_id", F.col("publisher").alias("creditor"), F.col("worker").alias("debtor"), "value", "cap",
        F.col("offered_at").alias("at"), "fraction")
    # some customers never granted a line
    pol = t.customer.filter("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("creditor"),
                            (F.greatest(F.round("c_acctbal"), F.lit(0.0)) * 1000).cast("long")
                            .alias("per_node_max"))
    pol = pol.withColumn("total_exposure", F.col("per_node_max") * 3)
    return M.credit_lines(req, pol)


GATE_SQL = B.with_sql(B.JOBS_SQL, B.JOB_WORKERS_SQL, B.AUDITS_SQL) + """,
outc AS (SELECT a.job_id, max(a.severity) AS severity
         FROM audits a JOIN job_workers w ON w.job_id = a.job_id AND w.worker = a.node GROUP BY 1),
g AS (SELECT j.job_id, w.worker AS node, j.value AS donation, coalesce(o.severity, 1.0) <= 0.5 AS ok
      FROM jobs j JOIN job_workers w USING (job_id) LEFT JOIN outc o USING (job_id))
"""


def gated(t: Tables):
    regs = (B.jobs(t).join(B.job_workers(t), "job_id").join(outcomes(t), "job_id", "left")
            .select("job_id", F.col("worker").alias("node"), F.col("value").alias("donation"), "severity", "offered_at"))
    return M.registration_gate(regs)


@register("registration_gate", GATE_SQL + """SELECT job_id, node, ok AS passed, CASE WHEN ok THEN donation ELSE 0 END AS donation_credited,
       CASE WHEN ok THEN donation ELSE 0 END AS stake_returned,
       CASE WHEN ok THEN 0 ELSE donation END AS slashed, ok AS identity_minted
FROM g""")
def q_registration(spark, root):
    return gated(Tables(spark, root)).select("job_id", "node", "passed", "donation_credited",
                                            "stake_returned", "slashed", "identity_minted")


@register("registration_journal", GATE_SQL + """,
j AS (SELECT node, job_id, ok, donation,
             unnest(['deposit', 'lock', 'release_return', 'release_slash', 'donation_credit', 'mint_identity']) AS op
      FROM g)
SELECT node, job_id, op, CAST(CASE WHEN op = 'mint_identity' THEN 0 ELSE donation END AS BIGINT) AS amount
FROM j
WHERE CASE WHEN op IN ('deposit', 'lock') THEN donation <> 0
           WHEN op = 'release_slash' THEN NOT ok AND donation <> 0
           WHEN op = 'mint_identity' THEN ok ELSE ok AND donation <> 0 END""")
def q_registration_journal(spark, root):
    j = M.registration_journal(gated(Tables(spark, root)), F.lit(DEPOSIT_AT).cast("timestamp_ntz"))
    return j.select("node", "job_id", "op", "amount")
