"""Vector operators (top-k search, whitening, clustering) against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import voronoi_knn as vk
from quarry.llm import whitening as wh
from quarry.llm.centroid_clustering import cluster_centroids
from quarry.llm.voronoi_knn import local_top, products, voronoi_topk
from quarry.llm.whitening import bidiagonalise, deviations, whiten_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def fifty(c):
    return F.pmod(c, F.lit(50)) == 0


def ints(v):
    return [math.floor(256 * float(np.float32(c))) for c in v]


def sound(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


@pytest.fixture(scope="module")
def rows():
    """Clusters, a vector that a third of the rows hold, nulls, non-finite and
    missing components, other lengths, repeated ids and a null id."""
    rng = random.Random(3)
    heart = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(4)]
    out = [(i, [c + 0.02 * rng.gauss(0, 1) for c in heart[i % 4]], None) for i in range(400)]
    out += [(1000 + i, heart[0], 1) for i in range(200)]
    out += [(5000, None, 1), (5050, [0.1] * 63 + [None], 1), (5100, [float("nan")] + [0.0] * 63, 1),
            (5150, [float("inf")] + [0.0] * 63, 1), (None, heart[1], 2), (None, None, None)]
    out += [(100, heart[2], 3), (100, heart[2], 3)]
    return out


LENGTHS = [(6000, [0.5, -0.5], 1), (6001, [], 1), (6002, [1.0] * 70, 1), (6050, [], 1)]


def top_brute(rows, k=5):
    kept = [(i, ints(v)) for i, v, _ in rows if sound(v)]
    out = []
    for a, (q, x) in enumerate(kept):
        if q is None or q % 50:
            continue
        scored = sorted(((-sum(p * r for p, r in zip(x, y)), c is None, c or 0, c)
                         for b, (c, y) in enumerate(kept) if a != b), key=lambda t: t[:3])[:k]
        out += [(q, r + 1, c, -s) for r, (s, _, _, c) in enumerate(scored)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(128, 1024, 8192), (16, 3, 60)])
def test_topk_equals_brute_force(spark, rows, sizes):
    data = rows + LENGTHS
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = voronoi_topk(df, "vec_id", "embedding", 5, fifty, *sizes)
    assert sorted(map(tuple, got.collect()), key=str) == top_brute(data)


def test_topk_prunes_clustered_data(spark):
    """Only data in a group's rings is replicated to it."""
    rng = np.random.default_rng(5)
    heart = 40 * np.eye(12)
    x = (np.repeat(heart, 200, axis=0) + rng.normal(0, 1, (2400, 12))).round().astype(np.int64)
    piv = vk.Pivots(heart.astype(int).tolist(), float((x ** 2).sum(axis=1).max()))
    cell, dist = piv.data(x)
    q_cell, q_dist = piv.queries(x)
    queries = {int(c): (int((q_cell == c).sum()), float(q_dist[q_cell == c].max())) for c in np.unique(q_cell)}
    nearest = {int(c): sorted(dist[cell == c].tolist())[:6] for c in np.unique(cell)}
    groups = vk.Groups(piv, queries, nearest, 5, 200)
    needed = sum(int(((dist >= low[cell]) & (dist <= high[cell])).sum()) for low, high, _ in groups.rings)
    # distances between queries and data are at least the lift, so rings are wide; still some data goes
    assert 0 < needed <= len(groups.rings) * len(x)
    score = x @ x.T
    for low, high, members in groups.rings:
        for c in queries:
            if groups.base[c] in members:
                for q in np.flatnonzero(q_cell == c)[:5]:
                    best = np.argsort(-score[q], kind="stable")[:6]
                    assert ((dist[best] >= low[cell[best]] - piv.slack) & (dist[best] <= high[cell[best]] + piv.slack)).all()


def test_products_stay_exact():
    rng = np.random.default_rng(1)
    big = rng.integers(-2 ** 28, 2 ** 28, (5, 7))
    assert products(big, big).tolist() == (big.astype(object) @ big.astype(object).T).tolist()
    assert products(big, big[:, :0]).tolist() == [[0] * 5] * 5
    with pytest.raises(OverflowError):
        products(np.array([[2 ** 31]]), np.array([[2 ** 31]]))


def test_local_top_of_ties():
    x = np.ones((9, 2), dtype=np.int64)
    r, c, s = local_top(np.array([3]), x[:1], np.arange(9), x, 4)
    assert (r.tolist(), c.tolist(), s.tolist()) == ([0] * 4, [0, 1, 2, 4], [2] * 4)


# -- whitening --------------------------------------------------------------

def whiten_brute(rows, k=4):
    kept = [(i, ints(v)) for i, v, _ in rows if sound(v)]
    dims = max(len(x) for _, x in kept)
    x = np.array([v + [0] * (dims - len(v)) for _, v in kept], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    z = (x - sums / n) @ q[:, :k] / np.sqrt(e[:k])
    return [i for i, _ in kept], n, ((n * x.astype(object) - sums) ** 2).sum(axis=1), z, e[:k] / e.sum()


def test_whitening_equals_dense_eigenvectors(spark, rows):
    data = rows + [(6000, [0.5, -0.5], 1), (6001, [], 1)]
    got = whiten_vectors(spark.createDataFrame(data, SCHEMA).repartition(4), "vec_id", "embedding").collect()
    ids, n, dev, z, explained = whiten_brute(data)
    assert len(got) == 4 * len(ids) and {r["n"] for r in got} == {n}
    want = sorted((str(i), d) for i, d in zip(ids, dev))
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == want
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    for c in range(4):
        mine = [r for r in got if r["component"] == c + 1]
        assert all(abs(r["explained"] / explained[c] - 1) < 1e-10 for r in mine)
        a = np.array(sorted((str(r["vec_id"]), abs(round(r["whitened"], 7))) for r in mine), dtype=object)
        b = np.array(sorted((str(i), abs(round(v, 7))) for i, v in zip(ids, z[:, c])), dtype=object)
        assert np.abs(a[:, 1].astype(float) - b[:, 1].astype(float)).max() < 1e-6
        first = {str(r["vec_id"]): r["whitened"] for r in mine if r["vec_id"] is not None and r["vec_id"] < 100}
        sign = [np.sign(first[str(i)] * z[j, c]) for j, i in enumerate(ids) if str(i) in first and abs(z[j, c]) > 1e-6]
        assert len(set(sign)) == 1


@pytest.mark.parametrize("shape", [(30, 6), (4, 9), (50, 1)])
@pytest.mark.parametrize("kind", ["random", "repeated", "low"])
def test_bidiagonalisation_equals_svd(shape, kind):
    rng = np.random.default_rng(4)
    u, _ = np.linalg.qr(rng.normal(size=(shape[0], min(shape))))
    v, _ = np.linalg.qr(rng.normal(size=(shape[1], min(shape))))
    s = {"random": np.linspace(9, 1, min(shape)), "repeated": np.full(min(shape), 3.0),
         "low": np.r_[[5.0], np.zeros(min(shape) - 1)]}[kind]
    x = u * s @ v.T
    sigma, right, _ = bidiagonalise(lambda c: (float((x @ c) @ (x @ c)), x.T @ (x @ c)), shape[1],
                                    min(4, shape[1]), np.linalg.norm(x))
    k = min(4, *shape)
    assert np.allclose(sigma[:k], np.sort(s)[::-1][:k], atol=1e-12 * 9)
    keep = sigma[:k] > 1e-9
    w = right[:, :k][:, keep]
    assert np.allclose(w.T @ w, np.eye(keep.sum()), atol=1e-12)
    assert np.allclose(x.T @ (x @ w), w * sigma[:k][keep] ** 2, atol=1e-10)


def test_deviations_are_exact():
    x = np.array([[2 ** 20, -3], [5, 7]])
    n, sums = 10 ** 6, np.array([2 ** 20 + 5, 4])
    want = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, sums)) for r in x]
    assert deviations(x, n, sums) == [d if d < 2 ** 63 else None for d in want]


def test_constant_vectors_have_no_component(spark):
    df = spark.createDataFrame([(i, [0.5, 0.25], 0) for i in range(5)], SCHEMA)
    assert whiten_vectors(df, "vec_id", "embedding").collect() == []
    line = spark.createDataFrame([(i, [0.5, 0.25 * i], 0) for i in range(5)], SCHEMA)
    got = whiten_vectors(line, "vec_id", "embedding").collect()
    assert len(got) == 5 and {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12


# -- clustering -------------------------------------------------------------

def cluster_brute(rows, k, rounds):
    kept = [(i, ints(v)) for i, v, _ in rows if sound(v) and len(v) == 64]
    def drawn(r):
        return hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]
    x = np.array([v for _, v in kept], dtype=np.int64)
    c = np.array([v for _, v in sorted(kept, key=drawn)[:k]], dtype=np.int64)
    for turn in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        at = d.argmin(axis=1)
        if turn < rounds:
            for j in set(at.tolist()):
                c[j] = x[at == j].sum(axis=0) // (at == j).sum()
    near = d.min(axis=1)
    return sorted([(i, int(a), int(m), int(near[at == a].sum()), int(near.sum()),
                    hashlib.sha256(",".join(map(str, c[a].tolist())).encode()).hexdigest())
                   for (i, _), a, m in zip(kept, at, near)], key=str)


@pytest.mark.parametrize("k,rounds", [(40, 5), (3, 2), (5000, 1)])
def test_clusters_equal_brute_force(spark, rows, k, rounds):
    data = rows + LENGTHS
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = cluster_centroids(df, "vec_id", "embedding", k=k, rounds=rounds)
    assert sorted(map(tuple, got.collect()), key=str) == cluster_brute(data, k, rounds)


# -- all three --------------------------------------------------------------

def test_empty_tables(spark):
    for data in ([], [(1, None, None), (50, [None], 1), (None, None, None)]):
        df = spark.createDataFrame(data, SCHEMA)
        assert voronoi_topk(df, "vec_id", "embedding", 5, fifty).collect() == []
        assert whiten_vectors(df, "vec_id", "embedding").collect() == []
        assert cluster_centroids(df, "vec_id", "embedding").collect() == []


def test_clashing_columns(spark, rows):
    """Every name that the operators use inside as an input column."""
    names = ("uid id x query norm2 cell dist query_cell query_dist group part n kind uids ids known q_n q_x rank score "
             "query_id at d component deviation whitened explained identity_error codes sizes occurring drawn cluster "
             "distance inertia cluster_inertia centroid_sha256 vec numbers").split()
    df = spark.createDataFrame(rows[:130], SCHEMA)
    wide = df.select("*", *[F.lit("clash").alias(c) for c in names])
    for fn in (lambda d: voronoi_topk(d, "vec_id", "embedding", 5, fifty),
               lambda d: whiten_vectors(d, "vec_id", "embedding"),
               lambda d: cluster_centroids(d, "vec_id", "embedding")):
        assert sorted(map(str, fn(wide).collect())) == sorted(map(str, fn(df).collect()))


def test_components_beyond_range_raise(spark):
    df = spark.createDataFrame([(50, [1e30], 0)], SCHEMA)
    with pytest.raises(Exception, match="not below"):
        voronoi_topk(df, "vec_id", "embedding", 5, fifty).collect()
