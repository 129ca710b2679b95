"""Written rules at their borders: cases that the tables at hand reach rarely."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import udf as U
from quarry.operators import aggs as A
from quarry.operators import clustering as C
from quarry.operators import market as M
from quarry.sources import ops as O
from quarry.streaming.ops import restart_deltas


def test_heartbeats_never_touch_status(spark):
    state = spark.createDataFrame([(1, 0, 9.0, "active"), (2, 0, 9.0, "active"), (3, 0, 9.0, "banned")],
                                  "k int, last_seen int, cpu double, status string")
    beats = spark.createDataFrame([(1, 1, "beat", 5.0), (1, 2, "offline", None), (2, 1, "offline", None),
                                   (2, 2, "beat", float("nan")), (4, 1, "beat", 1.0)],
                                  "k int, ts int, kind string, cpu double")
    got = {r.k: (r.last_seen, r.cpu, r.status) for r in O.apply_heartbeats(state, beats, "k", "ts", ["cpu"]).collect()}
    assert got == {1: (2, 5.0, "offline"), 2: (2, None, "offline"), 3: (0, 9.0, "banned")}


def test_upsert_blanks_named_columns_only(spark):
    cols = "k int, ts int, status string, ip string, host string"
    state = spark.createDataFrame([(1, 0, "draining", "a", "h")], cols)
    upd = spark.createDataFrame([(1, 1, "active", "", ""), (2, 1, "active", " ", "x")], cols)
    got = {r.k: (r.status, r.ip, r.host) for r in O.upsert_latest(
        state, upd, "k", "ts", ["status", "ip", "host"], blank_null=["ip"]).collect()}
    assert got == {1: ("draining", None, ""), 2: ("active", " ", "x")}


def test_gpu_inventory_rules(spark):
    lines = {"first bad": ["broken", "B, d2, 2048"], "half to even": ["A, d, 2560"], "half down": ["A, d, 512"],
             "no number": ["A, d, n/a", "B, d, 8.5"], "least": ["A, d, 0", "B, e, 8192", "C, f, 4096"],
             "none": ["x"], "blank first": ["", "A, d, 1024"]}
    rows = spark.createDataFrame([(h, i, x) for h, xs in lines.items() for i, x in enumerate(xs)],
                                 "host string, i int, line string")
    got = {r.host: (r.model, r.driver, r.n_cards, r.vram_gb, r.n_bad)
           for r in A.gpu_inventory(rows, "host", "line", "i").collect()}
    assert got == {"first bad": ("", "", 1, 2, 0), "half to even": ("A", "d", 1, 2, 0),
                   "half down": ("A", "d", 1, 0, 0), "no number": ("A", "d", 2, 0, 2),
                   "least": ("A", "d", 3, 4, 0), "none": ("", "", 0, 0, 0), "blank first": ("A", "d", 1, 1, 0)}


def test_audit_rejects_what_cannot_be_compared(spark):
    ref = [1.0, 0.0, 2.0]
    outs = [ref, [0.0, 0.0, 0.0], [1.0], [], None]
    rec = spark.createDataFrame([(i, "embedding", "fp32", o) for i, o in enumerate(outs)],
                                "k int, cat string, prec string, out array<double>")
    base = spark.createDataFrame([(i, ref) for i in range(len(outs))], "k int, ref array<double>")
    got = {r.k: (r["pass"], r.severity, r.similarity) for r in M.audit_outcomes(
        rec, base, "k", "out", "ref", "cat", "prec").collect()}
    assert got[0][0] and got[0][1] == 0.0
    assert all(got[i] == (False, 1.0, None) for i in (1, 2, 3, 4))


def test_merge_policy_per_risk(spark):
    base = dict(security_failed=False, critical_files=False, n_fail=0, pass_share=1.0, complexity=1,
                prod_change=True, test_change=True)
    cases = [({}, "LOW", True), ({"pass_share": 0.7}, "LOW", True), ({"complexity": 3}, "MEDIUM", True),
             ({"complexity": 3, "pass_share": 0.9}, "MEDIUM", False), ({"pass_share": 0.5}, "MEDIUM", False),
             ({"complexity": 4, "n_fail": 1}, "HIGH", False), ({"security_failed": True}, "CRITICAL", False),
             ({"test_change": False}, "LOW", False)]
    rows = spark.createDataFrame([{**base, **c, "i": i} for i, (c, _, _) in enumerate(cases)])
    got = {r.i: (r.risk, r.auto_merge_allowed) for r in A.risk_level(rows).collect()}
    assert got == {i: (risk, ok) for i, (_, risk, ok) in enumerate(cases)}


def test_ema_aggregate_has_no_row_limit(spark):
    n, rows = 3, 200_000            # with one global exponent q^-j overflows after ~1000 rows
    df = spark.range(1, rows + 1).select(F.lit("g").alias("g"), F.col("id").alias("pos"),
                                         (F.col("id") % 7).cast("double").alias("x"), F.lit(rows).alias("last"))
    got = df.groupBy("g").agg(U.ema_agg("pos", "x", "last", n).alias("e")).first().e
    e = None
    for i in range(1, rows + 1):
        e = float(i % 7) if e is None else 0.5 * e + 0.5 * (i % 7)
    assert got == pytest.approx(e, rel=1e-9)


def test_exact_percentiles(spark):
    rng = random.Random(3)
    rows = [("hot", round(rng.random(), 2)) for _ in range(3000)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: (r.n, r.p50, r.p95, r.p99) for r in A.latency_percentiles(df, "g", "v").collect()}
    s = sorted(v for g, v in rows if g == "hot")
    want = tuple(s[int(np.ceil(p * len(s) - 1e-9)) - 1] for p in (0.5, 0.95, 0.99))
    assert got == {"hot": (3000, *want), "one": (1, 5.0, 5.0, 5.0)}
    near = {r.g: r.p50 for r in A.latency_percentiles_approx(df, "g", "v").collect()}
    assert near["hot"] == pytest.approx(want[0], abs=0.02)


def test_components_never_stop_early(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {r.label for r in C.connected_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        C.connected_components(chain, max_rounds=1)


def test_restart_deltas_equal_sequential_fold():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 400)
        t = np.cumsum([rng.randint(0, 30) for _ in range(n)])
        c = np.cumsum([rng.choice([0, 0, 0, 1, 1, 2, -3]) for _ in range(n)])
        got, last = restart_deltas(t, c, 100, 3)
        lo, want, breach = 0, [], 0
        for i in range(n):
            while t[lo] < t[i] - 100:
                lo += 1
            want.append(c[i] - c[lo])
            if want[-1] > 3:
                lo = breach = i
        assert list(got) == want and last == breach


def test_credit_without_policy_is_rejected(spark):
    req = spark.createDataFrame([(1, 7, 1, 100, 50, 1, 0.0), (2, 8, 1, 100, 50, 1, 0.0), (3, 8, 1, 10, 50, 2, 0.0)],
                                "job_id long, creditor long, debtor long, value long, cap long, at long, "
                                "fraction double")
    pol = spark.createDataFrame([(7, 1000, 1000)], "creditor long, per_node_max long, total_exposure long")
    got = {r.job_id: r.accepted for r in M.credit_lines(req, pol).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_locks_never_exceed_the_balance(spark):
    """Slashes eat the deposit, payments add to it."""
    rng = random.Random(5)
    jobs = [(i, 9, rng.randint(100, 900), 1000 + i) for i in range(60)]
    jdf = spark.createDataFrame(jobs, "job_id long, publisher long, value long, offered_at long")
    who = spark.createDataFrame([(i, i % 3, 1) for i in range(60)], "job_id long, worker long, pool int")
    sev = {i: rng.choice([0.0, 0.2, 0.5]) for i in range(60)}
    out = spark.createDataFrame(list(sev.items()), "job_id long, severity double")
    dep = spark.createDataFrame([(w, 10_000) for w in range(3)], "worker long, deposit long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")     # carried from batch to batch
    rows = M.settle_jobs(jdf, who, out, dep, audit_rate=1.0).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    have = {w: 10_000 for w in range(3)}
    for r in sorted(rows, key=lambda r: r.offered_at):
        stake = r.value * 10
        ok = have[r.worker] >= stake
        assert r.status == ("accepted" if ok else "rejected_balance")
        have[r.worker] += r.paid - r.slashed
    assert {r.status for r in rows} == {"accepted", "rejected_balance"}


def test_requests_without_a_time_come_first(spark):
    req = spark.createDataFrame(
        [(1, 7, 1, 100, 50, 5, 0.0), (2, 7, 1, 130, 50, None, 1.0), (3, 7, 1, 120, 50, 6, 0.0), (4, None, 1, 90, 50, 1, 0.0)],
        "job_id long, creditor long, debtor long, value long, cap long, at long, fraction double")
    pol = spark.createDataFrame([(7, 140, 140)], "creditor long, per_node_max long, total_exposure long")
    got = {r.job_id: (r.accepted, r.repaid) for r in M.credit_lines(req, pol).collect()}
    # 80 of job 2 are never repaid, so job 3's 70 no longer fit
    assert got == {1: (True, 50), 2: (True, 0), 3: (False, 0), 4: (False, 0)}


def test_jobs_without_a_time_are_checked(spark):
    jdf = spark.createDataFrame([(1, 9, 100, None), (2, 9, 100, 5), (3, 9, 100, None)],
                                "job_id long, publisher long, value long, offered_at long")
    who = spark.createDataFrame([(i, 1, 1) for i in (1, 2, 3)], "job_id long, worker long, pool int")
    out = spark.createDataFrame([(1, 1.0)], "job_id long, severity double")
    dep = spark.createDataFrame([(1, 1000)], "worker long, deposit long")
    got = {r.job_id: r.status for r in M.settle_jobs(jdf, who, out, dep, audit_rate=1.0).collect()}
    assert got == {1: "accepted", 2: "rejected_balance", 3: "rejected_balance"}


def test_local_checkpoint_folder_needs_a_local_master():
    from quarry.session import ensure_checkpoint_dir

    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Fake)


def test_bindings_reach_their_branches(spark):
    import __spark_entry__ as E
    from conftest import SF_CHECK
    q = E.queries()

    def kinds(name, col):
        return {r[0] for r in q[name](spark, SF_CHECK).select(col).distinct().collect()}
    assert kinds("import_idempotent", "src") == {"target", "incoming"}
    skip = q["import_idempotent"](spark, SF_CHECK).filter("src = 'target'").count()
    force = q["import_force"](spark, SF_CHECK).filter("src = 'target'").count()
    assert 0 < force < skip
    assert kinds("settle_jobs", "status") == {"accepted", "rejected_cap", "rejected_no_worker", "rejected_balance"}
    assert kinds("pick_verifiers", "short") == {True, False}
    assert kinds("pool_tier", "tier") >= {3, 4, 5}
    assert q["missing_in"](spark, SF_CHECK).count() > 0 and q["community_noise"](spark, SF_CHECK).count() > 0
    assert kinds("service_verdicts", "mark") >= {"ok", "FAIL"}
    assert None in kinds("audit_outcomes", "similarity")


def test_pick_verifiers_draws_from_all_pools(spark):
    """Every pool with a positive weight is drawn from; fewer pools than a job needs are flagged."""
    import __spark_entry__ as E
    from conftest import SF_CHECK
    from pyspark.sql import functions as F
    from quarry.operators.market import pick_verifiers
    from quarry.sources.tables import Tables
    pools = {r[0] for r in Tables(spark, SF_CHECK).supplier.filter("s_acctbal > 0").select("s_nationkey").distinct().collect()}
    got = {r[0] for r in E.queries()["pick_verifiers"](spark, SF_CHECK).select("pool").distinct().collect()}
    assert got == pools and len(pools) == 25
    jobs = spark.createDataFrame([(1, 0, "embedding"), (2, 0, "rerank"), (3, 9, "rerank")], "job_id long, pool int, category string")
    ver = spark.createDataFrame([(10 * p, p, 1.0) for p in range(5)], "verifier long, pool int, weight double")
    out = pick_verifiers(jobs, ver).groupBy("job_id").agg(F.count("verifier").alias("n"), F.max("short").alias("short"))
    assert sorted(map(tuple, out.collect())) == [(1, 3, False), (2, 4, True), (3, 5, False)]


def test_missing_in_reads_all_orders(spark, tmp_path):
    """A customer whose only order is of any priority is not missing; one without an order is."""
    import os
    import __spark_entry__ as E
    from conftest import SF_SMALL
    from pyspark.sql import functions as F
    for name in ("customer", "orders"):
        df = spark.read.parquet(os.path.join(SF_SMALL, f"{name}.parquet"))
        if name == "orders":
            df = df.filter("o_custkey <> 7 and (o_custkey <> 8 or o_orderpriority <> '1-URGENT')")
            assert df.filter("o_custkey = 8").count() > 0
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = E.queries()["missing_in"](spark, str(tmp_path)).filter(F.col("c_custkey").isin(7, 8)).collect()
    assert [r[0] for r in got] == [7]


def test_review_files_deals_changes_over_bounded_parts(spark, monkeypatch):
    """The tables grouped by change are no larger with more files; null languages count as before."""
    from pyspark.sql import functions as F
    from quarry.operators import aggs as A
    f = spark.range(6000).select((F.col("id") % 1500).alias("change_id"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("l"), F.col("id") % 4)).alias("language"),
                                 F.when(F.col("id") % 7 > 0, "production").otherwise("test").alias("kind"))
    monkeypatch.setattr(A, "FILES_PER_TASK", 100)
    out = A.review_files(f)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(change_id" in plan and ", 60), REPARTITION_BY_NUM" in plan
    rows = [(i % 1500, f"l{i % 4}" if i % 4 else None, "production" if i % 7 else "test") for i in range(6000)]
    want = {}
    for c, lang, kind in rows:
        for key in (("language", lang), ("kind", kind), ("total", None)):
            want.setdefault(key, []).append(c)
    assert {(r[0], r[1]): (r[2], r[3]) for r in out.collect()} == {k: (len(set(v)), len(v)) for k, v in want.items()}


def test_token_cache_is_bounded():
    from quarry.functions import udf
    udf._BUCKETS.clear()
    tokens = [f"t{i}" for i in range(udf.BUCKETS_KEPT + 50_000)]
    first = [udf._bucket(t, 64) for t in tokens]
    assert len(udf._BUCKETS) <= 100_000 and [udf._bucket(t, 64) for t in tokens[-100:]] == first[-100:]


def test_only_hits_are_embedded_for_bridges(spark):
    """The documents are cut to the hits before names are joined and vectors made."""
    from conftest import SF_SMALL
    from pyspark.sql import functions as F
    from quarry.plans import q_retrieval as Q
    from quarry.sources.tables import Tables
    t = Tables(spark, SF_SMALL)
    of = t.documents.select("doc_id").orderBy("doc_id").limit(20)
    every = Q.name_edges(t).join(of.select(F.col("doc_id").cast("string").alias("src")), "src", "left_semi").select("src", "dst")
    got = sorted(map(tuple, Q.name_edges(t, of).select("src", "dst").collect()))
    assert got == sorted(map(tuple, every.collect()))
    seen, embed = [], Q.embed_texts
    Q.embed_texts = lambda df, *a, **k: seen.append(df) or embed(df, *a, **k)
    try:
        Q.q_bridge(spark, SF_SMALL)
    finally:
        Q.embed_texts = embed
    assert len(seen) == 1 and "LeftSemi" in seen[0]._jdf.queryExecution().optimizedPlan().toString()
