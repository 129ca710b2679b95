"""Bound clustering queries (ops 105-109) and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import clustering as C
from quarry.plans import bindings as B
from quarry.plans.q_scalars import PLANTED_SQL, planted, planted_raw
from quarry.plans.registry import register
from quarry.session import store
from quarry.sources.tables import Tables


#: Small blocks, so that the tables at hand fill several groups.
BLOCK_ROWS = 256
#: About the size of a leaf at sf0.01, so that some leaves are too small.
NOISE_SIZE = 50


def r6(c):
    return F.round(c, 6)


PAIRS_SQL = B.with_sql(PLANTED_SQL) + """,
d AS (SELECT a.vec_id AS u, b.vec_id AS v,
             sqrt(list_sum(list_transform(list_zip(a.vector, b.vector),
                                          lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist
      FROM planted a JOIN planted b ON a.vec_id <> b.vec_id),
knn AS (SELECT u, v, dist, row_number() OVER (PARTITION BY u ORDER BY round(dist, 9), v) AS rank
        FROM d),
core AS (SELECT u AS id, dist AS core FROM knn WHERE rank = 5),
scale AS (SELECT CASE WHEN (SELECT count(*) FROM planted) <= 6 THEN 1.0 ELSE median(dist) END AS scale
          FROM knn WHERE rank = 5)"""


def _points(spark, root):
    return planted(Tables(spark, root)).select(F.col("vec_id").alias("id"),
                                               F.col("vector").alias("v"))


@register("knn_graph", PAIRS_SQL + """
SELECT u AS id, v AS nbr, rank, round(dist, 6) AS dist FROM knn WHERE rank <= 5""")
def q_knn(spark, root):
    k = C.knn_graph(_points(spark, root), "id", "v", 5, BLOCK_ROWS)
    return k.select("id", "nbr", "rank", r6(F.col("dist")).alias("dist"))


@register("density_scale", PAIRS_SQL + """
SELECT round(scale, 6) AS scale FROM scale""")
def q_scale(spark, root):
    p = _points(spark, root)
    n = p.count()
    knn = store(C.knn_graph(p, "id", "v", 5, BLOCK_ROWS).filter(F.col("rank") == 5).select("rank", "dist"))
    s = C.density_scale(knn, n, 5)
    return spark.range(1).select(F.round(F.lit(s), 6).alias("scale"))


LINK_MULT = C.MID_MULT


@register("linkage_cut", PAIRS_SQL + f""",
e AS (SELECT d.u, d.v FROM d JOIN core cu ON cu.id = d.u JOIN core cv ON cv.id = d.v CROSS JOIN scale
      WHERE greatest(d.dist, cu.core, cv.core) <= {LINK_MULT} * scale.scale),
cc AS (
  WITH RECURSIVE r(id, label) AS (
    SELECT vec_id, vec_id FROM planted
    UNION
    SELECT e.v, r.label FROM r JOIN e ON e.u = r.id)
  SELECT id, min(label) AS label FROM r GROUP BY id),
sz AS (SELECT label, count(*) AS n FROM cc GROUP BY label)
SELECT id, CASE WHEN n >= {C.MIN_CLUSTER_SIZE} THEN label ELSE -1 END AS label
FROM cc JOIN sz USING (label)""")
def q_linkage(spark, root):
    p = _points(spark, root)
    n = p.count()
    packed = C.pack_vectors(p, "id", "v", C.MIN_SAMPLES, BLOCK_ROWS)          # read by neighbours and links
    knn = store(C.knn_graph(p, "id", "v", C.MIN_SAMPLES, BLOCK_ROWS, packed)
                .filter(F.col("rank").isin(5, C.MIN_SAMPLES)))                 # read by scale and cores
    scale = C.density_scale(knn, n, 5)
    core = knn.filter(F.col("rank") == C.MIN_SAMPLES).select("id", F.col("dist").alias("core"))
    stars = C.linkage_stars(p, core, "id", "v", [LINK_MULT * scale], BLOCK_ROWS, packed)
    return C.clusters_from_edges(p, stars.select("u", "v"), C.MIN_CLUSTER_SIZE)


_LEVELS = f"(VALUES (0, {C.BROAD_MULT}), (1, {C.MID_MULT}), (2, {C.LEAF_MULT})) l(lvl, mult)"

# Component labels of all three cut levels at once (recursive label spread).
TREE_CC_SQL = f""",
e AS (SELECT d.u, d.v, greatest(d.dist, cu.core, cv.core) AS w
      FROM d JOIN core cu ON cu.id = d.u JOIN core cv ON cv.id = d.v),
cc AS (
  WITH RECURSIVE r(lvl, id, label) AS (
    SELECT l.lvl, p.vec_id, p.vec_id FROM planted p CROSS JOIN {_LEVELS}
    UNION
    SELECT r.lvl, e.v, r.label FROM r JOIN e ON e.u = r.id JOIN {_LEVELS} ON l.lvl = r.lvl
    CROSS JOIN scale WHERE e.w <= l.mult * scale.scale)
  SELECT lvl, id, min(label) AS label FROM r GROUP BY lvl, id),
sz AS (SELECT lvl, label, count(*) AS n FROM cc GROUP BY lvl, label)"""


@register("community_tree", PAIRS_SQL + TREE_CC_SQL + f""",
comm AS (SELECT lvl, label FROM sz WHERE n >= {C.MIN_CLUSTER_SIZE}),
ids AS (SELECT lvl, label, row_number() OVER (ORDER BY lvl, label) - 1 AS temp_id FROM comm),
mem AS (SELECT i.temp_id, c.lvl, c.id AS member FROM cc c JOIN ids i USING (lvl, label)),
votes AS (SELECT k.temp_id AS child, p.temp_id AS parent, count(*) AS votes, min(k.member) AS first_pos
          FROM mem k JOIN mem p ON p.member = k.member AND p.lvl = k.lvl - 1 GROUP BY 1, 2),
par AS (SELECT child, parent FROM (
          SELECT *, row_number() OVER (PARTITION BY child ORDER BY votes DESC, first_pos) AS r FROM votes)
        WHERE r = 1),
ex AS (SELECT m.temp_id, unnest(p.vector) AS x, unnest(range(1, len(p.vector) + 1)) AS pos
       FROM mem m JOIN planted p ON p.vec_id = m.member),
cent2 AS (SELECT temp_id, list(a ORDER BY pos) AS c
          FROM (SELECT temp_id, pos, avg(x) AS a FROM ex GROUP BY ALL) GROUP BY temp_id),
dist AS (SELECT m.temp_id, m.member,
                sqrt(list_sum(list_transform(list_zip(p.vector, c2.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))
                  AS dist
         FROM mem m JOIN planted p ON p.vec_id = m.member JOIN cent2 c2 USING (temp_id)),
reps AS (SELECT temp_id, list(member ORDER BY rk) AS representatives
         FROM (SELECT *, row_number() OVER (PARTITION BY temp_id ORDER BY dist, member) AS rk FROM dist)
         WHERE rk <= 3 GROUP BY temp_id)
SELECT i.temp_id, par.parent AS parent_temp_id, CAST(i.lvl AS INTEGER) AS level, s.n AS size,
       r.representatives
FROM ids i JOIN sz s USING (lvl, label) LEFT JOIN par ON par.child = i.temp_id JOIN reps r USING (temp_id)""")
def q_tree(spark, root):
    return C.community_tree(_points(spark, root), "id", "v", block_rows=BLOCK_ROWS).communities


@register("community_noise", PAIRS_SQL + TREE_CC_SQL + f"""
SELECT c.id FROM cc c JOIN sz USING (lvl, label) WHERE lvl = 2 AND n < {NOISE_SIZE}""")
def q_noise(spark, root):
    """Op 108: the ids outside all leaf communities, of the vectors as they
    were before scaling (the tree scales them)."""
    raw = planted_raw(Tables(spark, root)).select(F.col("vec_id").alias("id"), "v")
    return C.community_tree(raw, "id", "v", min_size=NOISE_SIZE, block_rows=BLOCK_ROWS).noise


@register("cluster_diagnostics", PAIRS_SQL + TREE_CC_SQL + f"""
SELECT (SELECT count(*) FROM planted) AS n_points,
       count(*) FILTER (WHERE lvl = 0 AND n >= {C.MIN_CLUSTER_SIZE}) AS broad_count,
       count(*) FILTER (WHERE lvl = 1 AND n >= {C.MIN_CLUSTER_SIZE}) AS mid_count,
       count(*) FILTER (WHERE lvl = 2 AND n >= {C.MIN_CLUSTER_SIZE}) AS leaf_count,
       CAST(coalesce(sum(n) FILTER (WHERE lvl = 2 AND n < {C.MIN_CLUSTER_SIZE}), 0) AS BIGINT)
         AS noise_count,
       (SELECT round(scale, 6) FROM scale) AS scale
FROM sz""")
def q_diag(spark, root):
    diag = C.community_tree(_points(spark, root), "id", "v", block_rows=BLOCK_ROWS).diagnostics
    return diag.withColumn("scale", F.round("scale", 6))
