"""Marketplace pipeline (ops 41, 110-113): jobs -> audits -> journal rows.

Money is integer (long cents / decimal wei) end to end; rounding follows
the written rules (half away from zero for splits, floor for bps).  All
randomness is an md5-derived uniform of the ids, so a run is reproducible
and the SQL oracle draws the same numbers.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S

# Verifier counts per category, stake multiplier, tax rates,
# registration severity threshold.
VERIFIERS_PER_CATEGORY = {"embedding": 3, "rerank": 5}
STAKE_MULTIPLIER = 10
NETWORK_TAX = 0.01
POOL_TAX = 0.02
REGISTRATION_MAX_SEVERITY = 0.5


def uniform(*parts) -> Column:
    """Uniform in (0, 1) from md5 of the '-'-joined parts: (x + 0.5) / 2^32."""
    s = F.concat_ws("-", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p))
                          for p in parts])
    x = F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")
    return (x + F.lit(0.5)) / F.lit(4294967296.0)


# ---------------------------------------------------------------- op 41
def pick_verifiers(jobs: DataFrame, verifiers: DataFrame, job_id: str = "job_id",
                   job_pool: str = "pool", category: str = "category", vid: str = "verifier",
                   vpool: str = "pool", weight: str = "weight") -> DataFrame:
    """Op 41: n verifiers per job (3 embedding, 5 rerank), each from a
    different pool that is not the worker's pool, weight-biased.

    Two exact stages, neither a theta join over verifiers:
    1. Pools: weighted sampling without replacement of n pools per job
       (Efraimidis-Spirakis key -ln(u)/W over the pool table, which is a
       small dimension: one row per pool with its total weight W).
    2. Verifier inside each chosen pool: inverse CDF.  Each verifier owns
       the interval [lo, hi) of its pool's cumulative weight share; the
       target u2 is looked up by an equi-join on (pool, bucket) with the
       interval exploded over the buckets it overlaps (about two rows per
       verifier), then the exact interval test.
    Jobs with fewer available pools than n get all of them, flagged short.
    """
    v = verifiers.filter(F.col(weight) > 0).select(
        F.col(vid).alias("_v"), F.col(vpool).alias("_p"), F.col(weight).alias("_w"))
    pools = v.groupBy("_p").agg(F.sum("_w").alias("_wsum"), F.count(F.lit(1)).alias("_m"))
    lit_pools = pools.select(F.collect_list(F.struct("_p", "_wsum")).alias("_ps"))
    need = F.lit(None).cast("int")
    for c, n in VERIFIERS_PER_CATEGORY.items():
        need = F.when(F.col(category) == c, F.lit(n)).otherwise(need)
    j = jobs.select(F.col(job_id).alias("_j"), F.col(job_pool).alias("_jp"), need.alias("_n"))
    # the pool list is bounded (a dimension); it reaches each job as a scalar
    j = j.withColumn("_ps", lit_pools.scalar())
    cand = j.select("_j", "_jp", "_n", F.explode("_ps").alias("_c")).select(
        "_j", "_jp", "_n", F.col("_c._p").alias("_p"), F.col("_c._wsum").alias("_wsum"))
    cand = cand.filter(F.col("_p") != F.col("_jp"))
    # pools each job may draw from (a partial count, one row per job)
    cand = cand.join(cand.groupBy("_j").agg(F.count(F.lit(1)).alias("_avail")), "_j")
    cand = cand.withColumn("_key", -F.log(uniform(F.col("_j"), F.lit("pool"), F.col("_p")))
                           / F.col("_wsum"))
    w = Window.partitionBy("_j").orderBy("_key", "_p")
    chosen = cand.withColumn("pick_rank", F.row_number().over(w)).filter(
        F.col("pick_rank") <= F.col("_n"))
    chosen = chosen.withColumn("short", F.col("_avail") < F.col("_n"))
    # inverse CDF inside the pool
    wv = Window.partitionBy("_p").orderBy("_v")
    iv = v.join(pools, "_p").withColumn(
        "_cum", F.sum("_w").over(wv.rowsBetween(Window.unboundedPreceding, 0)))
    # adjacent intervals share their boundary exactly; the last one ends at 1
    iv = iv.withColumn("_hi", F.col("_cum") / F.max("_cum").over(
        wv.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    iv = iv.withColumn("_lo", F.coalesce(F.lag("_hi").over(wv), F.lit(0.0)))
    iv = iv.withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("_lo") * F.col("_m")).cast("long"),
        F.least(F.floor(F.col("_hi") * F.col("_m")), F.col("_m") - 1).cast("long"))))
    chosen = chosen.withColumn("_u2", uniform(F.col("_j"), F.lit("verifier"), F.col("_p")))
    chosen = chosen.join(pools.select("_p", "_m"), "_p").withColumn(
        "_b", F.floor(F.col("_u2") * F.col("_m")).cast("long"))
    hit = chosen.join(iv.select("_p", "_b", "_v", "_lo", "_hi"), ["_p", "_b"]).filter(
        (F.col("_u2") >= F.col("_lo")) & (F.col("_u2") < F.col("_hi")))
    return hit.select(F.col("_j").alias(job_id), F.col("_v").alias(vid), F.col("_p").alias(vpool),
                      F.col("pick_rank").cast("long").alias("pick_rank"), "short")


# ---------------------------------------------------------------- op 110
def audit_outcomes(receipts: DataFrame, reference: DataFrame, key: str, output: str, ref: str,
                   category: str, precision: str) -> DataFrame:
    """Op 110: compare each output with the reference result: cosine for
    embeddings, Kendall tau of the two rankings for rerank jobs; threshold
    by category and declared precision; pass and severity.  An output that
    cannot be compared (missing, empty, of another length, zero norm) has a
    NULL similarity, fails and has severity 1."""
    j = receipts.join(reference.select(key, ref), key)
    sim = F.when(F.col(category) == "rerank", S.kendall_tau(output, ref)).otherwise(
        S.cosine(output, ref))
    thr = S.audit_threshold(category, precision)
    j = j.withColumn("similarity", F.when(~F.isnan(sim), sim)).withColumn("threshold", thr)
    ok = F.coalesce(F.col("similarity") >= F.col("threshold"), F.lit(False))
    return (j.withColumn("pass", ok)
            .withColumn("severity", F.when(F.col("pass"), F.lit(0.0))
                        .when(F.col("similarity").isNull(), F.lit(1.0))
                        .otherwise(S.severity("similarity", "threshold"))))


# ---------------------------------------------------------------- ops 111, 112
def fold_in_order(rows: DataFrame, key: str, order: list[Column], fold, schema: str) -> DataFrame:
    """``fold`` over the rows of every key in order: one shuffle by the key, a
    sort within partitions, and one pass that takes Arrow batches as they come.
    ``fold(batches)`` gets frames whose keys lie side by side and carries its
    state from row to row and batch to batch, so a key's history is never held
    whole, however long, and many short histories cost no call each."""
    return rows.repartition(F.col(key)).sortWithinPartitions(F.col(key), *order).mapInPandas(fold, schema)


def _in_time(at: str) -> list[Column]:
    """Rows without a time come first; ties by job."""
    return [F.col(at).asc_nulls_first(), F.col("job_id").asc_nulls_first()]


def _lockable(asked: DataFrame) -> DataFrame:
    """Which jobs find their stake available: per worker in job order, every
    job released before the next; ``asked`` has ``job_id, worker, at, deposit,
    stake, change`` (payment less slash, if the job is accepted)."""
    def fold(batches):
        worker, have = None, 0
        for b in batches:
            ok = []
            for who, deposit, stake, change in zip(*(b[c].tolist() for c in ("worker", "deposit", "stake", "change"))):
                if who != worker:
                    worker, have = who, deposit
                ok.append(have >= stake)
                have += change if ok[-1] else 0
            yield pd.DataFrame({"job_id": b["job_id"], "ok": ok})
    return fold_in_order(asked, "worker", _in_time("at"), fold, "job_id long, ok boolean")


def settle_jobs(jobs: DataFrame, workers: DataFrame, outcomes: DataFrame, deposits: DataFrame,
                audit_rate: float = 0.05, high_value: int = 45_000_000,
                net_rate: float = NETWORK_TAX, pool_rate: float = POOL_TAX) -> DataFrame:
    """Op 111: the paid-job lifecycle as one batch, one row per job.

    Rejected without a worker, when the stake (value x 10) exceeds the
    worker's registered deposit (cap), or when the worker's available balance
    - deposit less slashes plus payments of the jobs before, in order of offer
    and id - does not cover the stake to lock.  Audit when value >= high_value
    (forced) or the md5 uniform of the job is below the rate; slash fraction
    from the outcome severity; release: slashed = round(stake f), returned =
    stake - slashed; settle unless f = 1: taxes rounded, paid = value - taxes.
    """
    j = jobs.join(workers, "job_id", "left").join(deposits, "worker", "left")
    stake = F.col("value") * STAKE_MULTIPLIER
    status0 = (F.when(F.col("worker").isNull(), F.lit("rejected_no_worker"))
               .when(F.coalesce(F.col("deposit"), F.lit(0)) < stake, F.lit("rejected_cap"))
               .otherwise(F.lit("accepted")))
    j = j.withColumn("stake", stake).withColumn("status", status0)
    j = j.join(outcomes.select("job_id", "severity"), "job_id", "left")
    forced = F.col("value") >= high_value
    sampled = S.md5_uniform(F.col("job_id")) < audit_rate
    j = j.withColumn("audited", (F.col("status") == "accepted") & (forced | sampled))
    j = j.withColumn("fraction", F.when(F.col("audited"), S.slash_fraction("severity"))
                     .otherwise(F.lit(0.0)))
    slashed, returned = S.split_slash("stake", "fraction")
    tax = S.split_tax("value", F.lit(net_rate), F.lit(pool_rate))
    pays = F.when(F.col("fraction") < 1.0, tax["paid"]).otherwise(F.lit(0))
    asked = j.filter(F.col("status") == "accepted").select(
        "job_id", "worker", F.col("offered_at").alias("at"), "deposit", "stake",
        (pays - slashed).cast("long").alias("change"))
    j = j.join(_lockable(asked), "job_id", "left")
    # a job without an answer is not accepted
    j = j.withColumn("_short", (F.col("status") == "accepted") & ~F.coalesce("ok", F.lit(False)))
    short = F.col("_short")
    j = (j.withColumn("status", F.when(short, F.lit("rejected_balance")).otherwise(F.col("status")))
         .withColumn("audited", F.col("audited") & ~short)
         .withColumn("fraction", F.when(short, F.lit(0.0)).otherwise(F.col("fraction"))))
    acc = F.col("status") == "accepted"
    settled = acc & (F.col("fraction") < 1.0)
    return j.select(
        "job_id", "worker", "pool", "publisher", "offered_at", "value", "status", "audited",
        "fraction", F.when(F.col("audited"), F.coalesce("severity", F.lit(0.0))).alias("severity"),
        F.when(acc, F.col("stake")).otherwise(F.lit(0)).alias("stake"),
        F.when(acc, slashed).otherwise(F.lit(0)).alias("slashed"),
        F.when(acc, returned).otherwise(F.lit(0)).alias("returned"),
        settled.alias("settled"),
        F.when(settled, tax["network_tax"]).otherwise(F.lit(0)).alias("network_tax"),
        F.when(settled, tax["pool_tax"]).otherwise(F.lit(0)).alias("pool_tax"),
        F.when(settled, tax["paid"]).otherwise(F.lit(0)).alias("paid"))


def lifecycle_events(settled: DataFrame) -> DataFrame:
    """Op 111, last steps: what a settled job reports - the pool's settlement
    volume, the audit result, a fraud report for a failed audit, the slash and
    the payment.  Output ``job_id, worker, pool, event, amount, at``."""
    ok = F.col("severity") <= 0
    events = [("volume", F.col("settled") & F.col("pool").isNotNull(), F.col("value")),
              ("audit_pass", F.col("audited") & ok, F.lit(0)), ("audit_fail", F.col("audited") & ~ok, F.lit(0)),
              ("fraud_report", F.col("audited") & ~ok, F.col("stake")),
              ("slash", F.col("slashed") > 0, F.col("slashed")), ("settle", F.col("settled"), F.col("paid"))]
    rows = F.array(*[F.struct(F.lit(n).alias("event"), when.alias("happens"), amount.cast("long").alias("amount"))
                     for n, when, amount in events])
    return (settled.select("job_id", "worker", "pool", F.col("offered_at").alias("at"), F.explode(rows).alias("_e"))
            .filter("_e.happens").select("job_id", "worker", "pool", "_e.event", "_e.amount", "at"))


JOURNAL_OPS = ["deposit", "lock", "release_return", "release_slash", "settle_paid", "settle_tax"]


def journal_rows(settled: DataFrame, deposits: DataFrame, deposit_at) -> DataFrame:
    """Journal ``node, job_id, op, op_ord, amount, at`` from op 111's rows:
    one deposit per registered node, then lock / release / settle per
    accepted job (zero amounts are not written)."""
    d = deposits.select(F.col("worker").alias("node"), F.lit(None).cast("long").alias("job_id"),
                        F.lit("deposit").alias("op"), F.lit(0).alias("op_ord"),
                        F.col("deposit").alias("amount"), F.lit(deposit_at).alias("at"))
    acc = settled.filter(F.col("status") == "accepted")
    arr = F.array(*[F.struct(F.lit(op).alias("op"), F.lit(i).alias("op_ord"), amt.alias("amount"))
                    for i, (op, amt) in enumerate([
                        ("lock", F.col("stake")), ("release_return", F.col("returned")),
                        ("release_slash", F.col("slashed")), ("settle_paid", F.col("paid")),
                        ("settle_tax", F.col("network_tax") + F.col("pool_tax"))], start=1)])
    e = acc.select(F.col("worker").alias("node"), "job_id", F.col("offered_at").alias("at"),
                   F.explode(arr).alias("_e")).select(
        "node", "job_id", "_e.op", "_e.op_ord", "_e.amount", "at")
    return d.unionByName(e.filter(F.col("amount") != 0))


def credit_lines(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Op 112: per creditor, in job order, a request whose shortfall
    (value - cap) is positive draws credit when the creditor's debt to that
    debtor stays within ``per_node_max`` and the creditor's outstanding
    exposure within ``total_exposure``; otherwise the job is rejected, as it
    is when the creditor has no policy.  At settle the debt is repaid by
    (1 - f): fully on a clean settle, nothing on a full slash (defaulted); the
    unrepaid part stays outstanding.

    Rejections feed back into later decisions, so a creditor's requests are
    folded one after another (:func:`fold_in_order`): its open debts are the
    only state, rows stream through.  Requests without a time come first; a
    missing slash fraction is a clean settle.
    """
    need = requests.withColumn("shortfall", F.greatest(F.col("value") - F.col("cap"), F.lit(0)))
    asked = need.filter(F.col("shortfall") > 0)
    without = asked.join(policies, "creditor", "left_anti")
    drawn = asked.join(policies, "creditor").select(
        "job_id", "creditor", "debtor", "shortfall", "at", F.coalesce("fraction", F.lit(0.0)).alias("fraction"),
        "per_node_max", "total_exposure")
    schema = ("job_id long, creditor long, debtor long, shortfall long, accepted boolean, repaid long, "
              "defaulted boolean, outstanding_after long")

    def fold(batches):
        creditor, debt, outstanding = None, {}, 0
        for b in batches:
            out = []
            for who, debtor, s, f, per_max, total in zip(*(b[c].tolist() for c in (
                    "creditor", "debtor", "shortfall", "fraction", "per_node_max", "total_exposure"))):
                if who != creditor:
                    creditor, debt, outstanding = who, {}, 0
                owed = debt.get(debtor, 0)
                ok = owed + s <= per_max and outstanding + s <= total
                repaid = math.floor(s * (1.0 - f) + 0.5) if ok and f < 1.0 else 0
                if ok and s > repaid:
                    debt[debtor] = owed + s - repaid
                    outstanding += s - repaid
                out.append((ok, repaid, ok and f >= 1.0, outstanding))
            new = pd.DataFrame(out, columns=["accepted", "repaid", "defaulted", "outstanding_after"])
            yield pd.concat([b[["job_id", "creditor", "debtor", "shortfall"]].reset_index(drop=True), new], axis=1)

    folded = fold_in_order(drawn, "creditor", _in_time("at"), fold, schema)
    free = need.filter(F.col("shortfall") <= 0).select(
        "job_id", "creditor", "debtor", "shortfall", F.lit(True).alias("accepted"),
        F.lit(0).cast("long").alias("repaid"), F.lit(False).alias("defaulted"),
        F.lit(None).cast("long").alias("outstanding_after"))
    rejected = without.select(
        "job_id", "creditor", "debtor", "shortfall", F.lit(False).alias("accepted"),
        F.lit(0).cast("long").alias("repaid"), F.lit(False).alias("defaulted"),
        F.lit(None).cast("long").alias("outstanding_after"))
    return folded.unionByName(free).unionByName(rejected)


# ---------------------------------------------------------------- op 113
def registration_gate(regs: DataFrame, max_severity: float = REGISTRATION_MAX_SEVERITY) -> DataFrame:
    """Op 113: a registration passes when its audit severity <= 0.5: the
    donation is credited and the stake returned; otherwise the whole stake
    is slashed to the reserve and no identity is minted."""
    ok = F.coalesce(F.col("severity"), F.lit(1.0)) <= max_severity
    return regs.select(
        "*", ok.alias("passed"),
        F.when(ok, F.col("donation")).otherwise(F.lit(0)).alias("donation_credited"),
        F.when(ok, F.col("donation")).otherwise(F.lit(0)).alias("stake_returned"),
        F.when(ok, F.lit(0)).otherwise(F.col("donation")).alias("slashed"),
        ok.alias("identity_minted"))


def registration_journal(gated: DataFrame, deposit_at, at: str = "offered_at") -> DataFrame:
    """Op 113: the ledger rows of :func:`registration_gate` in the form of
    :func:`journal_rows`: the node's deposit of its donation, the lock, and
    either the stake's return with a ``donation_credit`` (a credit of its own,
    without effect on the balances) and ``mint_identity``, or the slash to the
    reserve.  Rows without an amount are not written, but for the mint."""
    steps = F.array(*[F.struct(F.lit(op).alias("op"), F.lit(i).alias("op_ord"), amount.alias("amount"), keep.alias("keep"))
                      for i, (op, amount, keep) in enumerate([
                          ("deposit", F.col("donation"), F.col("donation") != 0),
                          ("lock", F.col("donation"), F.col("donation") != 0),
                          ("release_return", F.col("stake_returned"), F.col("stake_returned") != 0),
                          ("release_slash", F.col("slashed"), F.col("slashed") != 0),
                          ("donation_credit", F.col("donation_credited"), F.col("donation_credited") != 0),
                          ("mint_identity", F.lit(0).cast("long"), F.col("identity_minted"))])])
    rows = gated.select("node", "job_id", F.col(at).alias("at"), F.explode(steps).alias("_e")).filter("_e.keep")
    when = F.when(F.col("_e.op") == "deposit", F.lit(deposit_at)).otherwise(F.col("at"))
    return rows.select("node", "job_id", "_e.op", "_e.op_ord", "_e.amount", when.alias("at"))
