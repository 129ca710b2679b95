"""Property tests: skew-safe helpers, blocked operators and folds against
brute force / sequential Python on seeded random inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import clustering as C
from quarry.operators import joins as J
from quarry.operators import retrieval as R
from quarry.operators import windows as W


def test_segmented_running_equals_plain_window(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([0, 0, 0, 1, 2]), i, rnd.randint(-5, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, t long, v long")
    got = W.segmented_running(df, "k", ["t"], F.floor(F.col("t") / 37), {"s": F.col("v")},
                              min_of=["s"])
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("s", F.sum("v").over(w)).withColumn("s_min", F.min("s").over(w))
    a = sorted(got.select("k", "t", "s", "s_min").collect())
    b = sorted(exp.select("k", "t", "s", "s_min").collect())
    assert a == b


def test_split_range_window_equals_plain(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([0, 0, 1]), i * 3 + rnd.randint(0, 2), rnd.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, p long, v double")
    got = W.split_range_window(df, "k", "p", 20,
                               lambda d, w: d.withColumn("s", F.sum("v").over(w)))
    w = Window.partitionBy("k").orderBy("p").rangeBetween(-20, 0)
    exp = df.withColumn("s", F.sum("v").over(w))
    a = {(r.k, r.p): r.s for r in got.collect()}
    b = {(r.k, r.p): r.s for r in exp.collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[x] - b[x]) < 1e-9 for x in a)


def test_reputation_equals_sequential_fold(spark):
    rnd = random.Random(3)
    rows = [(n, i, rnd.random() < 0.8) for n in range(4) for i in range(250)]
    df = spark.createDataFrame(rows, "node int, i long, pass boolean")
    got = {(r.node, r.i): r.reputation for r in
           W.reputation(df, "node", ["i"], F.floor(F.col("i") / 17)).collect()}
    for n in range(4):
        rep = 0
        for i in range(250):
            rep = max(0, rep + (1 if rows[n * 250 + i][2] else -10))
            assert got[(n, i)] == rep


def test_ledger_invariant_random_journals(spark):
    from quarry.operators.aggs import ledger_invariant
    rnd = random.Random(4)
    for _ in range(5):
        rows = []
        for n in range(5):
            rows.append((n, "deposit", rnd.randint(1000, 5000)))
            for _ in range(rnd.randint(1, 20)):
                stake = rnd.randint(1, 500)
                sl = rnd.randint(0, stake)
                rows += [(n, "lock", stake), (n, "release_return", stake - sl),
                         (n, "release_slash", sl), (n, "settle_paid", rnd.randint(0, 100)),
                         (n, "settle_tax", rnd.randint(0, 5))]
        j = spark.createDataFrame(rows, "node int, op string, amount long")
        assert ledger_invariant(j).first().holds


def _brute_topk(Q, D, k):
    S = Q @ D.T
    out = {}
    for i in range(S.shape[0]):
        order = sorted(range(S.shape[1]), key=lambda j: (-round(S[i, j], 9), j))
        out[i] = [j for j in order if S[i, j] > 0][:k] if k else order
    return S, out


def test_dense_topk_multiblock(spark):
    rng = np.random.default_rng(5)
    Q = rng.normal(size=(7, 5))
    D = rng.normal(size=(53, 5))
    qdf = spark.createDataFrame([(i, Q[i].tolist()) for i in range(7)], "qid long, v array<double>")
    ddf = spark.createDataFrame([(j, D[j].tolist()) for j in range(53)], "did long, v array<double>")
    got = R.dense_topk(qdf, ddf, "qid", "v", "did", "v", 4, block_rows=5)
    Qn = Q / np.linalg.norm(Q, axis=1, keepdims=True)
    Dn = D / np.linalg.norm(D, axis=1, keepdims=True)
    S = Qn @ Dn.T
    for i in range(7):
        exp = sorted(range(53), key=lambda j: (-round(S[i, j], 9), j))[:4]
        assert [r.did for r in got.filter(F.col("qid") == i).orderBy("rank").collect()] == exp


def test_sparse_topk_multiblock(spark):
    rnd = random.Random(6)
    terms = [f"t{i}" for i in range(12)]
    q = [(qi, t, rnd.random() + 0.1) for qi in range(9) for t in rnd.sample(terms, 3)]
    d = [(di, t, rnd.random() + 0.1) for di in range(70) for t in rnd.sample(terms, 4)]
    qdf = spark.createDataFrame(q, "qid long, term string, w double")
    ddf = spark.createDataFrame(d, "did long, term string, w double")
    cand = R.sparse_topk(qdf, ddf, "qid", "did", 3, n_queries=9, n_docs=70, query_block=2,
                         doc_block=8)
    got = R.rank_scores(cand, "qid", 3, item="did")
    ti = {t: i for i, t in enumerate(terms)}
    Q = np.zeros((9, 12))
    D = np.zeros((70, 12))
    for qi, t, w in q:
        Q[qi, ti[t]] += w
    for di, t, w in d:
        D[di, ti[t]] += w
    _, exp = _brute_topk(Q, D, 3)
    for i in range(9):
        assert [r.did for r in got.filter(F.col("qid") == i).orderBy("rank").collect()] == exp[i]


def test_pack_context_goes_on_to_the_budget(spark, tmp_path):
    """Short documents: far more than ten of a ranking fit the budget (three
    document blocks; some items end by the budget, some by the ranking)."""
    from quarry.plans.q_retrieval import PACK_BUDGET, q_pack
    from quarry.sources.tables import Tables
    rnd = random.Random(99)
    terms = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choices(terms, k=rnd.choice([2, 5, 12, 40, 150]))), "en", "s", 0) for i in range(1200)]
    rows += [(1200 + i, f"rare {'w' * 10 * i}", "en", "s", 0) for i in range(25)]
    rows += [(1300 + i, "tied words", "en", "s", 0) for i in range(30)]
    items = [(i, " ".join(rnd.sample(terms, 3))) for i in range(8)] + [(8, "rare"), (9, "tied t0"), (10, "none")]
    root = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    got = sorted(tuple(r) for r in q_pack(spark, root).collect())

    size = {d: max(1, len(x) // 4) for d, x, *_ in rows}
    ranked = R.bm25(Tables(spark, root).benchmark, Tables(spark, root).documents, k=len(rows))
    exp, total = [], {}
    for r in sorted(ranked.collect(), key=lambda r: (r.item_id, r.rank)):
        total[r.item_id] = total.get(r.item_id, 0) + size[r.doc_id]
        if total[r.item_id] <= PACK_BUDGET:
            exp.append((r.item_id, r.rank, r.doc_id, total[r.item_id]))
    assert got == exp
    n = {i: sum(g[0] == i for g in got) for i, _ in items}
    assert n[8] == 25 and n[10] == 0 and min(n[i] for i in range(8)) > 10
    assert any(t > PACK_BUDGET for t in total.values())


def test_knn_multiblock_equals_brute(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(40)], "id long, v array<double>")
    got = C.knn_graph(df, "id", "v", 3, block_rows=6)
    Dm = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    for i in range(40):
        exp = sorted((j for j in range(40) if j != i), key=lambda j: (round(Dm[i, j], 9), j))[:3]
        assert [r.nbr for r in got.filter(F.col("id") == i).orderBy("rank").collect()] == exp


@pytest.mark.parametrize("clustered", [False, True])
def test_knn_pruned_equals_brute(spark, clustered):
    rng = np.random.default_rng(14)
    if clustered:
        centers = rng.normal(size=(6, 4)) * 8
        X = np.concatenate([c + rng.normal(size=(30, 4)) for c in centers])
    else:
        X = rng.normal(size=(150, 4))
    n = len(X)
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(n)], "id long, v array<double>")
    got = C.knn_graph_pruned(df, "id", "v", 4, block_rows=16)
    Dm = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    res = {}
    for r in got.collect():
        res.setdefault(r.id, []).append((r.rank, r.nbr))
    for i in range(n):
        exp = sorted((j for j in range(n) if j != i), key=lambda j: (round(Dm[i, j], 9), j))[:4]
        assert [b for _, b in sorted(res[i])] == exp


def test_linkage_pruned_equals_unpruned(spark):
    """Pivot-cell pruning keeps every component at every cut."""
    from quarry.plans.q_scalars import planted
    from quarry.sources.tables import Tables
    from conftest import SF_SMALL
    p = planted(Tables(spark, SF_SMALL)).select(F.col("vec_id").alias("id"), F.col("vector").alias("v"))
    n = p.count()
    knn = C.knn_graph(p, "id", "v", 5)
    scale = C.density_scale(knn, n, 5)
    core = knn.filter(F.col("rank") == 5).select("id", F.col("dist").alias("core"))
    cuts = [3.0 * scale, 1.5 * scale, 1.1 * scale]
    a = C.linkage_stars(p, core, "id", "v", cuts, block_rows=64)
    b = C.linkage_stars_pruned(p, core, "id", "v", cuts, block_rows=32)
    for lvl in range(3):
        la = C.clusters_from_edges(p.select("id"), a.filter(F.col("level") == lvl).select("u", "v"), 5)
        lb = C.clusters_from_edges(p.select("id"), b.filter(F.col("level") == lvl).select("u", "v"), 5)
        assert sorted(la.collect()) == sorted(lb.collect())


def test_block_cuts_keep_ties(spark):
    """Duplicates straddling every block cut: rankings still break ties by id."""
    rng = np.random.default_rng(15)
    base = rng.normal(size=4)
    D = np.concatenate([np.tile(base, (25, 1)), rng.normal(size=(25, 4))])
    order = rng.permutation(50)
    D = D[order]
    Q = base[None, :] + 0.01 * rng.normal(size=(3, 4))
    qdf = spark.createDataFrame([(i, Q[i].tolist()) for i in range(3)], "qid long, v array<double>")
    ddf = spark.createDataFrame([(j, D[j].tolist()) for j in range(50)], "did long, v array<double>")
    got = R.dense_topk(qdf, ddf, "qid", "v", "did", "v", 6, block_rows=7)
    S = (Q / np.linalg.norm(Q, axis=1, keepdims=True)) @ (D / np.linalg.norm(D, axis=1, keepdims=True)).T
    for i in range(3):
        exp = sorted(range(50), key=lambda j: (-round(S[i, j], 9), j))[:6]
        assert [r.did for r in got.filter(F.col("qid") == i).orderBy("rank").collect()] == exp
    xdf = spark.createDataFrame([(j, D[j].tolist()) for j in range(50)], "id long, v array<double>")
    Dm = np.sqrt(((D[:, None, :] - D[None, :, :]) ** 2).sum(-1))
    for fn in (lambda: C.knn_graph(xdf, "id", "v", 3, block_rows=6),
               lambda: C.knn_graph_pruned(xdf, "id", "v", 3, block_rows=6)):
        res = {}
        for r in fn().collect():
            res.setdefault(r.id, []).append((r.rank, r.nbr))
        for i in range(50):
            exp = sorted((j for j in range(50) if j != i), key=lambda j: (round(Dm[i, j], 9), j))[:3]
            assert [b for _, b in sorted(res[i])] == exp


def test_exact_median(spark):
    rnd = random.Random(8)
    xs = [rnd.random() for _ in range(101)] + [rnd.random() for _ in range(100)]
    for vals in (xs[:101], xs):
        df = spark.createDataFrame([(x,) for x in vals], "x double")
        assert C.exact_median(df, "x", partitions=7) == pytest.approx(float(np.median(vals)))


def test_assign_nearest_multipass_equals_single(spark):
    rng = np.random.default_rng(9)
    P = rng.normal(size=(30, 4))
    Cc = rng.normal(size=(10, 4))
    pts = spark.createDataFrame([(i, P[i].tolist()) for i in range(30)], "pid long, v array<double>")
    cen = spark.createDataFrame([(j, j, Cc[j].tolist()) for j in range(10)],
                                "cid long, ord long, c array<double>")
    one = J.assign_nearest(pts, cen, "pid", "v", "cid", "c", "ord", 0.0)
    many = J.assign_nearest(pts, cen, "pid", "v", "cid", "c", "ord", 0.0, max_centroids_per_pass=3)
    vec = J.assign_nearest(pts, cen, "pid", "v", "cid", "c", "ord", 0.0)
    vec_many = J.assign_nearest(pts, cen, "pid", "v", "cid", "c", "ord", 0.0,
                                max_centroids_per_pass=4)
    a = sorted((r.pid, r.cid, round(r.similarity, 9)) for r in one.collect())
    b = sorted((r.pid, r.cid, round(r.similarity, 9)) for r in many.collect())
    c = sorted((r.pid, r.cid, round(r.similarity, 9)) for r in vec.collect())
    d = sorted((r.pid, r.cid, round(r.similarity, 9)) for r in vec_many.collect())
    assert a == b == c == d


def test_trigram_join_equals_brute(spark):
    from quarry.operators.retrieval import trigram_join
    names = ["red widget", "red widgets", "blue bolt", "blue bolts", "small ring", "smal ring",
             "green gadget", "widget red"]

    def tg(s):
        out = set()
        for w in s.lower().split():
            p = "  " + w + " "
            out |= {p[i:i + 3] for i in range(len(p) - 2)}
        return out

    exp = {(a, b) for a in names for b in names if a < b
           and len(tg(a) & tg(b)) / len(tg(a) | tg(b)) >= 0.3}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.a, r.b) for r in trigram_join(df, "name", "name", 0.3).collect()}
    assert got == exp


def test_credit_lines_independent_fold(spark):
    from quarry.operators.market import credit_lines
    rnd = random.Random(10)
    req = [(i, rnd.randint(1, 3), rnd.randint(1, 4), rnd.randint(50, 150), 60, i,
            rnd.choice([0.0, 0.0, 0.5, 1.0])) for i in range(60)]
    rdf = spark.createDataFrame(req, "job_id long, creditor long, debtor long, value long, cap long, "
                                     "at long, fraction double")
    pol = spark.createDataFrame([(c, 120, 300) for c in (1, 2, 3)],
                                "creditor long, per_node_max long, total_exposure long")
    # tiny Arrow batches: the state is carried from one to the next
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    got = {r.job_id: (r.accepted, r.repaid) for r in credit_lines(rdf, pol).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 60
    for c in (1, 2, 3):
        debt, out = {}, 0
        for (j, cr, d, v, cap, at, f) in sorted((x for x in req if x[1] == c), key=lambda x: x[5]):
            s = max(v - cap, 0)
            if s == 0:
                assert got[j] == (True, 0)
                continue
            ok = debt.get(d, 0) + s <= 120 and out + s <= 300
            rep = int(np.floor(s * (1 - f) + 0.5)) if (ok and f < 1) else 0
            if ok:
                debt[d] = debt.get(d, 0) + s - rep
                out += s - rep
            assert got[j] == (ok, rep)


def test_community_tree_matches_brute_force(spark):
    """Levels from Spark equal union-find on the full mutual-reachability
    matrix of the sf0.001 planted vectors."""
    from quarry.plans.q_scalars import planted
    from quarry.sources.tables import Tables
    from conftest import SF_SMALL
    p = planted(Tables(spark, SF_SMALL)).select(F.col("vec_id").alias("id"), F.col("vector").alias("v"))
    rows = sorted((r.id, r.v) for r in p.collect())
    ids = np.array([r[0] for r in rows])
    X = np.array([r[1] for r in rows])
    Dm = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(Dm, np.inf)
    srt = np.sort(Dm, axis=1)
    core = srt[:, 4]
    scale = float(np.median(srt[:, 4]))
    mr = np.maximum(np.maximum(Dm, core[:, None]), core[None, :])
    comms, member, noise, diag = C.community_tree(p.withColumn("v", F.transform("v", lambda x: x * (F.col("id") % 3 + 1))),
                                                  "id", "v", block_rows=100)
    d = diag.first()
    leaves = {r.member for r in member.filter(F.col("level") == 2).collect()}
    assert {r.id for r in noise.collect()} == set(ids.tolist()) - leaves and d.noise_count == len(ids) - len(leaves)
    assert d.scale == pytest.approx(scale)
    for lvl, mult in enumerate((C.BROAD_MULT, C.MID_MULT, C.LEAF_MULT)):
        parent = list(range(len(ids)))

        def find(a):
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a
        ii, jj = np.where(mr <= mult * scale)
        for a, b in zip(ii, jj):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[ra] = rb
        groups = {}
        for i in range(len(ids)):
            groups.setdefault(find(i), set()).add(int(ids[i]))
        exp = sorted(sorted(g) for g in groups.values() if len(g) >= C.MIN_CLUSTER_SIZE)
        got = {}
        for r in member.filter(F.col("level") == lvl).collect():
            got.setdefault(r.temp_id, set()).add(r.member)
        assert sorted(sorted(g) for g in got.values()) == exp


def test_stream_crashloop_equals_sequential_fold(spark):
    import __spark_entry__ as E
    from quarry.plans import bindings as B
    from quarry.sources.tables import Tables
    from conftest import SF_SMALL
    got = {r.event_id: (r.delta, r.breach) for r in E.queries()["stream_crashloop"](spark, SF_SMALL).collect()}
    s = B.restart_samples(Tables(spark, SF_SMALL)).collect()
    by = {}
    for r in sorted(s, key=lambda r: (r.container_id, r.epoch, r.event_id)):
        by.setdefault(r.container_id, []).append(r)
    n = 0
    for rows in by.values():
        samples = []
        for r in rows:
            samples.append((r.epoch, r.restart_count))
            samples = [x for x in samples if x[0] >= r.epoch - 3 * 86400] or [samples[-1]]
            delta = r.restart_count - samples[0][1]
            breach = delta > 2
            if breach:
                samples = [(r.epoch, r.restart_count)]
            assert got[r.event_id] == (delta, breach)
            n += 1
    assert n == len(got)


def test_ema_long_series_equals_sequential(spark):
    """Blocks of a few rows (small n) force many carries; compare with the
    sequential definition."""
    rnd = random.Random(11)
    n = 3  # alpha = 0.5: blocks of ~865 rows
    rows = [(k, i, rnd.random()) for k in (0, 1) for i in range(2500)]
    df = spark.createDataFrame(rows, "k int, i long, x double")
    got = {(r.k, r.i): r.ema for r in W.ema(df, "k", ["i"], "x", n, F.floor(F.col("i") / 300)).collect()}
    a = 2.0 / (n + 1)
    for k in (0, 1):
        e = None
        for i in range(2500):
            x = rows[k * 2500 + i][2]
            e = x if e is None else (1 - a) * e + a * x
            assert got[(k, i)] == pytest.approx(e, rel=1e-9, abs=1e-12)


def test_sequential_staging_replays_in_order(spark):
    """The portable staging path (slices written one after another) gives a
    stream whose windowed counts equal the batch counts."""
    from quarry.schemas import TABLES
    from quarry.sources.ops import scratch_path
    from quarry.sources.tables import Tables
    from quarry.streaming import ops as S
    from conftest import SF_SMALL
    e = Tables(spark, SF_SMALL).events
    path = S.stage_files(e, scratch_path(spark, "seq-stage"), "ts", 3)
    s = S.stream_source(spark, path, TABLES["events"], "ts")
    out = S.run_to_table(S.telemetry_counts(s, "event_type", "ts", "1 day", "1 day", "1 minute"),
                         "seq-stage", "update", ["window_start", "event_type"])
    got = {(str(r.window_start), r.event_type): r.n for r in out.collect()}
    exp = {(str(r.w.start), r.event_type): r.n for r in e.withColumn("ts", F.col("ts").cast("timestamp"))
           .groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == exp


def test_staging_keeps_nulls_and_bounds_files(spark):
    """No row is lost, files ascend by modification time, null values come
    first, and a value that half of the rows hold fills no file."""
    import glob
    import os
    from quarry.sources.ops import scratch_path
    from quarry.streaming import ops as S
    rnd = random.Random(54)
    rows = [(i, rnd.choice([None, 500, 500, 500, rnd.randrange(1000)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(4)
    for files, cap in ((4, {}), (4, {"file_rows": 200})):
        path = S.stage_files(df, scratch_path(spark, "stage-null"), "v", files, **cap)
        names = sorted(glob.glob(path.removeprefix("file://").removeprefix("file:") + "/*.parquet"),
                       key=lambda f: os.stat(f).st_mtime_ns)
        got = [[tuple(r) for r in spark.read.parquet("file://" + f).collect()] for f in names]
        assert sorted((r for g in got for r in g), key=lambda r: r[0]) == rows
        v = [-1 if r[1] is None else r[1] for g in got for r in sorted(g, key=lambda r: -1 if r[1] is None else r[1])]
        assert v == sorted(v)
        assert max(len(g) for g in got) <= (2 * 200 if cap else 2000)
    assert len(got) >= 8
    empty = S.stage_files(df.limit(0), scratch_path(spark, "stage-none"), "v", 4)
    assert spark.read.schema(df.schema).parquet(empty).count() == 0


def test_segmented_shift_equals_lag_lead(spark):
    rnd = random.Random(12)
    rows = [(rnd.choice([0, 0, 0, 1]), i, rnd.randint(0, 99)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t long, v long")
    seg = F.floor(F.col("t") / 29)
    lag = W.segmented_shift(df, "k", ["t"], seg, ["v"], suffix="_prev")
    lead = W.segmented_shift(df, "k", ["t"], seg, ["v"], lead=True, suffix="_next")
    w = Window.partitionBy("k").orderBy("t")
    exp = df.withColumn("p", F.lag("v").over(w)).withColumn("n", F.lead("v").over(w))
    e = {(r.k, r.t): (r.p, r.n) for r in exp.collect()}
    assert {(r.k, r.t): r.v_prev for r in lag.collect()} == {x: y[0] for x, y in e.items()}
    assert {(r.k, r.t): r.v_next for r in lead.collect()} == {x: y[1] for x, y in e.items()}


def test_preference_pairs_buckets_equal_brute(spark):
    from quarry.operators.sets import preference_pairs
    rnd = random.Random(13)
    rows = [(i, rnd.choice(["en", "en", "de"]), rnd.randint(1, 400), rnd.random() < 0.4)
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, n long, good boolean")
    got = {r.chosen_id: r.rejected_id for r in
           preference_pairs(df, "g", "n", "id", F.col("good"), ~F.col("good"), bucket_width=7).collect()}
    exp = {}
    for i, g, n, good in rows:
        if not good:
            continue
        cands = [(abs(n - m), m, j) for j, h, m, gd in rows if h == g and not gd]
        if cands:
            exp[i] = min(cands)[2]
    assert got == exp


def test_bundle_pairs_equal_brute_force(spark):
    """Neighbours and components over many bundles of few rows, with copies:
    no vector is shuffled once per pair."""
    rng = np.random.default_rng(41)
    X = np.concatenate([rng.normal(size=(140, 5)), np.tile(rng.normal(size=5), (60, 1)), rng.normal(size=(40, 5)) * 0.05])
    n = len(X)
    df = spark.createDataFrame([(i, X[i].tolist()) for i in rng.permutation(n).tolist()], "id long, v array<double>")
    knn = C.knn_graph(df, "id", "v", 5, block_rows=2)
    Dm = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    res = {}
    for r in knn.collect():
        res.setdefault(r.id, []).append((r.rank, r.nbr))
    for i in range(n):
        exp = sorted((j for j in range(n) if j != i), key=lambda j: (round(Dm[i, j], 9), j))[:5]
        assert [b for _, b in sorted(res[i])] == exp
    np.fill_diagonal(Dm, np.inf)
    near = np.sort(Dm, axis=1)[:, 4]
    mr = np.maximum(np.maximum(Dm, near[:, None]), near[None, :])
    core = knn.filter(F.col("rank") == 5).select("id", F.col("dist").alias("core"))
    cuts = [2.0, 1.2, 0.3]
    stars = C.linkage_stars(df, core, "id", "v", cuts, block_rows=2)
    got = {(r.level, r.id): r.label for r in C.clusters_by_level(df, stars, 3, 1).collect()}
    for lvl, cut in enumerate(cuts):
        label = np.arange(n)
        while True:
            new = np.minimum(label, np.where(mr <= cut, label[None, :], n).min(axis=1))
            if (new == label).all():
                break
            label = new
        assert [got[lvl, i] for i in range(n)] == label.tolist()


def test_pairs_are_not_shuffled(spark):
    """Only results are dealt out after the pairs were compared, never a vector per pair."""
    df = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(60)], "id long, v array<double>")
    knn = C.knn_graph(df, "id", "v", 2, block_rows=2)
    core = knn.filter(F.col("rank") == 2).select("id", F.col("dist").alias("core"))
    for out in (knn, C.linkage_stars(df, core, "id", "v", [3.0], block_rows=2)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        keys = [x.split("(")[1].split(",")[0] for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert keys and all(k.startswith(("id#", "level#")) for k in keys), plan
