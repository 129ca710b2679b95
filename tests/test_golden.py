"""Golden cases with literal inputs (the documented examples)."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import aggs as A
from quarry.operators import market as M
from quarry.operators import topk as K


def one(spark, cols, rows):
    return spark.createDataFrame(rows, cols)


def test_ledger_examples(spark):
    # deposit 100, lock 10, release with f = 0, settle value 10 at 1 % + 2 %
    j = one(spark, "node string, op string, amount long", [
        ("n", "deposit", 10000), ("n", "lock", 1000), ("n", "release_return", 1000),
        ("n", "settle_paid", 970), ("n", "settle_tax", 30)])
    b = A.ledger_balances(j).first()
    assert (b.available, b.locked, b.reserve) == (10970, 0, 30)
    assert A.ledger_invariant(j).first().holds
    # full slash of 10, half slash of 10
    for f, avail, reserve in ((1.0, 9000, 1000), (0.5, 9500, 500)):
        sl, ret = spark.range(1).select(*S.split_slash(F.lit(1000), F.lit(f))).first()
        jj = one(spark, "node string, op string, amount long", [
            ("n", "deposit", 10000), ("n", "lock", 1000), ("n", "release_return", ret),
            ("n", "release_slash", sl)])
        b = A.ledger_balances(jj).first()
        assert (b.available, b.reserve) == (avail, reserve)


def test_no_dust(spark):
    sl, ret = spark.range(1).select(*S.split_slash(F.lit(7), F.lit(0.3))).first()
    assert (sl, ret) == (2, 5) and sl + ret == 7


def test_tax_errors(spark):
    r = spark.range(1).select(*[v.alias(k) for k, v in S.split_tax(F.lit(1000), F.lit(0.3),
                                                                    F.lit(0.3)).items()]).first()
    assert r.status == "tax_cap_exceeded"
    r = spark.range(1).select(*[v.alias(k) for k, v in S.split_tax(F.lit(1000), F.lit(0.01),
                                                                    F.lit(0.02)).items()]).first()
    assert (r.network_tax, r.pool_tax, r.paid, r.status) == (10, 20, 970, "ok")


def test_cosine_cases(spark):
    df = one(spark, "a array<double>, b array<double>", [
        ([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [-1.0, -2.0]),
        ([0.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0])])
    got = [r[0] for r in df.select(S.cosine("a", "b")).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(0.0)
    assert got[2] == pytest.approx(-1.0)
    assert all(math.isnan(x) for x in got[3:])


def test_kendall_tau_cases(spark):
    df = one(spark, "a array<int>, b array<int>", [
        ([1, 2, 3, 4], [1, 2, 3, 4]), ([1, 2, 3, 4], [4, 3, 2, 1]), ([1, 2, 3, 4], [1, 3, 2, 4]),
        ([1], [1])])
    got = [r[0] for r in df.select(S.kendall_tau("a", "b")).collect()]
    assert got[0] == 1.0 and got[1] == -1.0 and got[2] == pytest.approx(4 / 6) and math.isnan(got[3])


def test_precision_threshold(spark):
    r = spark.range(1).select(S.audit_threshold(F.lit("embedding"), F.lit("fp16")).alias("t")).first()
    assert r.t == 0.999 and 0.995 < r.t


def test_slash_fraction_table(spark):
    df = one(spark, "s double", [(0.0,), (0.2,), (0.299,), (0.3,), (0.5,), (0.7,), (0.95,)])
    got = [round(r[0], 6) for r in df.select(S.slash_fraction("s")).collect()]
    assert got == [0.0, 0.2, 0.299, 0.65, 0.75, 1.0, 1.0]


def test_audit_rate_ten_failures(spark):
    from quarry.operators.windows import audit_rate
    df = one(spark, "fail_rate double, max_sev_recent double, ema double", [(1.0, 0.4, 0.0)])
    assert audit_rate(df).first().audit_rate == pytest.approx(1.0)


def test_rep_cap(spark):
    df = one(spark, "pooled boolean, earned long, endorsement long, donated long", [
        (False, 200, 0, 10 ** 12), (True, 500, 200, 100 * 10 ** 6)])
    assert [r.rep_cap for r in A.effective_rep_cap(df).collect()] == [100, 100]


def test_pool_tier(spark):
    df = one(spark, "total_stake double, members long, volume double", [
        (50000.0, 5, 0.0), (0.0, 1, 0.0), (2_000_000.0, 10, 10.0)])
    assert [r.tier for r in A.pool_tier(df).collect()] == [3, 1, 5]


def test_verdict_block(spark):
    df = one(spark, "t string", [("VERDICT: PASS\nCONFIDENCE: 0.9\nSEVERITY: LOW\nRATIONALE: No issues found",),
                                 ("garbage",)])
    cols = S.parse_verdict("t")
    rows = df.select(*[v.alias(k) for k, v in cols.items()]).collect()
    assert tuple(rows[0]) == ("PASS", 0.9, "LOW", "No issues found")
    assert tuple(rows[1]) == (None, None, None, None)


def test_image_tag(spark):
    df = one(spark, "r string", [("repo/img:1.2",), ("img",), ("",), ("host:5000/img",)])
    assert [r[0] for r in df.select(S.image_tag("r")).collect()] == ["1.2", "<no-tag>", "", "5000/img"]


def test_complexity_boundaries(spark):
    df = one(spark, "l int", [(49,), (50,), (149,), (150,), (299,), (300,)])
    got = [r[0] for r in df.select(S.complexity_level("l", F.lit(0), F.lit(0))).collect()]
    assert got == [1, 2, 2, 3, 3, 4]


def test_rerank_stable_and_cut(spark):
    df = one(spark, "q long, idx long, raw double", [(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.5), (1, 3, 0.1)])
    out = K.rerank(df, "raw", "q", "idx", 3).orderBy("rank").collect()
    assert [r.idx for r in out] == [1, 0, 2]
    assert len(K.rerank(df, "raw", "q", "idx", 0).collect()) == 4


def test_mixed_scenario(spark):
    """100 jobs, 90 honest and 10 malicious: 90 settled, 10 fully slashed."""
    jobs = one(spark, "job_id long, publisher long, value long, offered_at timestamp_ntz",
               [(i, 1, 1000, None) for i in range(100)])
    workers = one(spark, "job_id long, worker long, pool int", [(i, 7, 1) for i in range(100)])
    outc = one(spark, "job_id long, severity double", [(i, 0.0 if i < 90 else 0.8) for i in range(100)])
    dep = one(spark, "worker long, deposit long", [(7, 10 ** 9)])
    s = M.settle_jobs(jobs, workers, outc, dep, audit_rate=0.0, high_value=0)
    got = s.agg(F.sum(F.col("settled").cast("int")).alias("settled"),
                F.sum((F.col("fraction") == 1.0).cast("int")).alias("slashed"),
                F.sum(F.col("slashed") + F.col("network_tax") + F.col("pool_tax")).alias("reserve")).first()
    assert (got.settled, got.slashed) == (90, 10)
    assert got.reserve == 90 * (10 + 20) + 10 * 10000


def test_restart_delta_defaults(spark):
    """120 s window, threshold 5 (strictly above): samples every 30 s."""
    from quarry.operators.windows import restart_delta
    counts = [0, 1, 3, 6, 7, 7, 7]
    df = one(spark, "container_id string, epoch long, restart_count long",
             [("c1", 30 * i, c) for i, c in enumerate(counts)])
    got = {r.epoch: (r.delta, r.breach) for r in restart_delta(df).collect()}
    # at t=90: oldest sample in [t-120, t] is t=0 (count 0) -> delta 6 > 5
    assert got[90] == (6, True)
    assert got[120] == (7, True)      # oldest in [0, 120] is count 0
    assert got[150] == (6, True)      # oldest in [30, 150] is count 1
    assert got[180] == (4, False)     # oldest in [60, 180] is count 3


def test_fresh_at_90s(spark):
    import datetime as dt
    from quarry.operators.joins import fresh_at
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    beats = one(spark, "queue string, worker long, ts timestamp_ntz", [
        ("q", 1, t0 - dt.timedelta(seconds=30)), ("q", 2, t0 - dt.timedelta(seconds=90)),
        ("q", 3, t0 - dt.timedelta(seconds=91)), ("q", 1, t0 - dt.timedelta(seconds=10)),
        ("other", 4, t0)])
    probes = one(spark, "queue string, probe_ts timestamp_ntz", [("q", t0)])
    assert fresh_at(probes, beats, "queue", "probe_ts", "ts", "worker", 90).first().fresh_workers == 2


def test_liveness_gap_90s(spark):
    """Beats 30 s apart stay one session; a 91 s silence starts a new one."""
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    secs = [0, 30, 60, 151, 181]
    df = one(spark, "w long, ts timestamp", [(1, t0 + dt.timedelta(seconds=s)) for s in secs])
    g = df.groupBy(F.session_window("ts", "90 seconds").alias("s"), "w").count().collect()
    assert sorted(r["count"] for r in g) == [2, 3]


def test_manifest_written_next_to_data(spark):
    from quarry.sources.ops import scratch_path, write_manifest
    df = one(spark, "split string, toks array<string>", [
        ("train", ["a", "b", "a"]), ("train", ["c"]), ("test", ["a"])])
    path = scratch_path(spark, "manifest")
    m = {r.split: (r.n_docs, r.tokens, r.vocab_size) for r in write_manifest(df, "split", "toks", path).collect()}
    assert m == {"train": (2, 4, 3), "test": (1, 1, 1)}
    back = {r.split: r.vocab_size for r in spark.read.json(path).collect()}
    assert back == {"train": 3, "test": 1}


def test_stream_source_start_point(spark):
    import datetime as dt
    from quarry.schemas import TABLES
    from quarry.sources.ops import scratch_path
    from quarry.sources.tables import Tables
    from quarry.streaming import ops as SO
    from conftest import SF_SMALL
    e = Tables(spark, SF_SMALL).events
    path = SO.stage_files(e, scratch_path(spark, "start"), "ts", 4)
    start = dt.datetime(2024, 1, 20)
    s = SO.stream_source(spark, path, TABLES["events"], "ts", start_at=start)
    got = SO.run_to_table(s, "start", "append").count()
    assert got == e.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz")).count()


def test_var_refs(spark):
    df = one(spark, "t string", [("url=${DB_URL} port=${PORT:-5432} host=${HOST-localhost}",)])
    got = [tuple(r) for r in df.select(F.explode(S.var_refs("t"))).select("col.*").collect()]
    assert got == [("DB_URL", True), ("PORT", False), ("HOST", False)]


def test_rank_variants_forgetting(spark):
    from quarry.operators.windows import rank_variants
    df = one(spark, "g string, v string, ppl double, before double, after double", [
        ("p50k", "baseline", 168.46, 100.0, 106.9), ("p50k", "tst", 198.40, 100.0, 101.0)])
    out = {r.v: (r.rank_ppl, round(r.forget_pct, 6)) for r in
           rank_variants(df, "g", ["ppl"], "before", "after").collect()}
    assert out == {"baseline": (1, 6.9), "tst": (2, 1.0)}


def test_rollup_tree_levels_and_mean(spark):
    from quarry.operators.retrieval import rollup_tree
    rows = [(1, i, 10, [float(i), 1.0]) for i in range(9)] + [(2, 0, 5, [2.0, 2.0])]
    df = one(spark, "doc long, idx long, n_tokens int, v array<double>", rows)
    out = {(r.doc, r.level, r.node): (r.tokens, r.n_children, r.mean_vector) for r in
           rollup_tree(df, "doc", "idx", "n_tokens", 3, vec="v", dims=2).collect()}
    assert out[(1, 2, 0)] == (90, 3, [4.0, 1.0])      # root of 9 chunks, fanout 3
    assert out[(1, 1, 2)] == (30, 3, [7.0, 1.0])
    assert out[(2, 0, 0)] == (5, 0, [2.0, 2.0])       # one chunk: the chunk is the root
    assert max(lv for d, lv, n in out if d == 1) == 2
