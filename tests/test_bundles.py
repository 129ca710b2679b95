"""What the clustering operators leave on disk (round 3, findings 2 to 5)."""

import os
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import functions as F

from quarry.functions.scalars import l2_normalize
from quarry.operators import clustering as C
from quarry.session import store

N, DIMS = 3000, 64
VECTOR_BYTES = N * DIMS * 8


def points(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(12, DIMS))[rng.integers(0, 12, N)] + 0.2 * rng.normal(size=(N, DIMS))
    return spark.createDataFrame([(i, X[i].tolist()) for i in range(N)], "id long, v array<double>").repartition(4)


class Written:
    """Bytes that checkpoints took since it was made."""

    def __init__(self, spark):
        self.root = urlparse(spark.conf.get("spark.checkpoint.dir")).path   # each call has a folder in it
        self.before = self.sizes()

    def sizes(self) -> dict:
        return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(self.root) for f in fs}

    def now(self) -> int:
        return sum(n for f, n in self.sizes().items() if f not in self.before)


def shuffled(spark) -> int:
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(str(b).startswith("shuffle") for b in (manager.getAllBlocks().apply(i)
                                                      for i in range(manager.getAllBlocks().size())))


def test_neighbours_write_the_vectors_once(spark):
    """a vector is in one checkpoint, and besides it only what can rank."""
    p, disk = points(spark), Written(spark)
    packed = C.pack_vectors(p, "id", "v", 5, 16)
    knn = C.knn_graph(p, "id", "v", 5, 16, packed)
    assert knn.count() == 5 * N and packed.count() > 1
    assert VECTOR_BYTES < disk.now() < 1.8 * VECTOR_BYTES


def test_a_stored_table_leaves_no_shuffle_files(spark):
    """the files of a shuffle go when its result is written."""
    before = shuffled(spark)
    d = spark.range(5000).withColumn("g", F.col("id") % 97).groupBy("g").count()
    assert store(d).count() == 97
    kept = shuffled(spark) - before
    store(spark.range(5000).repartition(7, "id").repartition(5, F.col("id") % 3))
    assert shuffled(spark) - before <= kept


def test_links_use_the_bundles_of_the_neighbours(spark):
    """with the bundles of knn_graph the links write no vector again, and
    are the same components."""
    p = points(spark)
    packed = C.pack_vectors(p, "id", "v", 5, 16)
    knn = C.knn_graph(p, "id", "v", 5, 16, packed)
    core = store(knn.filter(F.col("rank") == 5).select("id", F.col("dist").alias("core")))
    cuts = [4.0, 2.0, 1.9]
    disk = Written(spark)
    stars = C.linkage_stars(p, core, "id", "v", cuts, 16, packed)
    assert 0 < disk.now() < 0.2 * VECTOR_BYTES
    apart = C.linkage_stars(p, core, "id", "v", cuts, 64)
    label = [sorted(map(tuple, C.clusters_by_level(p, s, 3, 4).collect())) for s in (stars, apart)]
    assert label[0] == label[1] and len({x[2] for x in label[0]}) > 12


def test_broad_side_tables_are_shuffled(spark, monkeypatch):
    """Beyond SIDE_BYTES nothing is broadcast, with the same links."""
    p = points(spark).limit(600).localCheckpoint()
    core = p.select("id", F.lit(0.5).alias("core"))
    got = []
    for limit in (C.SIDE_BYTES, 0):
        monkeypatch.setattr(C, "SIDE_BYTES", limit)
        s = C.linkage_stars(p, core, "id", "v", [2.2], 16)
        got.append(sorted(map(tuple, C.clusters_by_level(p, s, 1, 1).collect())))
    assert got[0] == got[1] and len({x[2] for x in got[0]}) > 1


def test_tree_keeps_one_copy_of_the_vectors(spark):
    """the whole tree, its points scaled, over one copy of the vectors."""
    p, disk = points(spark), Written(spark)
    tree = C.community_tree(p, "id", "v", block_rows=16)
    assert tree.communities.count() >= 12
    assert VECTOR_BYTES < disk.now() < 2.5 * VECTOR_BYTES


def test_norm_is_computed_once_per_row(spark):
    """scaled vectors scaled again do not nest the first norm per component."""
    p = points(spark)
    plan = p.select(l2_normalize(l2_normalize("v")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 4, plan
    x = np.array([r.x for r in p.limit(20).select(l2_normalize("v").alias("x")).collect()])
    assert np.allclose((x * x).sum(1), 1.0)
    odd = spark.createDataFrame([([0.0, 0.0],), (None,), ([],), ([3.0, None, 4.0],)], "v array<double>")
    assert [r.x for r in odd.select(l2_normalize("v").alias("x")).collect()] == [[0.0, 0.0], None, [], [None] * 3]


def test_leaves_of_stars_join_at_the_end(spark):
    """Components with nodes of a single edge, smaller or larger than its other end."""
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (170, 2))] + [(500, 501), (600, 3), (601, 3), (7, 7)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(label)):
        new = dict(label)
        for a, b in edges:
            if a != b:
                new[a] = new[b] = min(new[a], new[b])
        if new == label:
            break
        label = new
    got = C.connected_components(spark.createDataFrame(edges, "u long, v long"))
    rows = [tuple(r) for r in got.select("id", "label").collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == label
