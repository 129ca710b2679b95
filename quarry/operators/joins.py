"""Join operators (ops 35-44).

Join strategy is left to Catalyst and AQE: a side whose size statistics are
under ``spark.sql.autoBroadcastJoinThreshold`` is broadcast, anything else
is a sort-merge join on the equi-keys; skewed partitions are split by AQE.
Non-equi predicates are always given an equi-key first (a time bucket, a
pool, a term) so that no operator here plans a nested-loop join over two
large inputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators.windows import epoch_seconds


def join_hierarchy(child: DataFrame, parent: DataFrame, grand: DataFrame,
                   child_fk: str, parent_pk: str, parent_fk: str, grand_pk: str) -> DataFrame:
    """Op 35: child rows with their parent and grand-parent attributes; a
    missing parent keeps the child (left outer)."""
    p = parent.join(grand, parent[parent_fk] == grand[grand_pk], "left")
    return child.join(p, child[child_fk] == p[parent_pk], "left")


def missing_in(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Op 38: rows of ``left`` whose key does not occur in ``right``."""
    return left.join(right, key, "left_anti")


def fresh_at(probes: DataFrame, beats: DataFrame, queue: str, probe_ts: str, beat_ts: str,
             worker: str, max_age_s: int) -> DataFrame:
    """Op 39: per probe (time, queue), distinct workers whose heartbeat lies
    in [probe - max_age, probe].

    Interval join without a range explosion: beats are keyed by the time
    bucket of width ``max_age``; a probe looks at its own bucket and the one
    before, so the join is an equi-join on (queue, bucket) plus a filter.
    """
    w = max_age_s * 1_000_000  # microseconds: exact timestamp comparisons
    b = beats.select(F.col(queue).alias("_q"), F.col(worker).alias("_w"),
                     F.unix_micros(F.col(beat_ts).cast("timestamp")).alias("_bt"))
    b = b.withColumn("_bk", F.floor(F.col("_bt") / w))
    p = probes.withColumn("_pt", F.unix_micros(F.col(probe_ts).cast("timestamp")))
    p = p.withColumn("_bk", F.explode(F.array(F.floor(F.col("_pt") / w),
                                              F.floor(F.col("_pt") / w) - 1)))
    j = p.join(b, (p[queue] == b["_q"]) & (p["_bk"] == b["_bk"])
               & (b["_bt"] <= p["_pt"]) & (b["_bt"] >= p["_pt"] - w), "left")
    return (j.groupBy(*[p[c] for c in probes.columns])
            .agg(F.count_distinct(b["_w"]).alias("fresh_workers")))


def asof_state(left: DataFrame, right: DataFrame, key: str, ts: str, value: str,
               left_id: str, segment_seconds: int | None = None) -> DataFrame:
    """Op 40: for each left row the last right ``value`` at or before its
    time (backward as-of).

    Union of both sides and ``last(ignorenulls)`` over the key's history; no
    range explosion.  With ``segment_seconds`` the history of a key is cut
    into time segments processed in parallel: the state carried into a
    segment is the last right value of all earlier segments (an aggregate of
    one row per key and segment), so a hot key is not one task.
    """
    r = right.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(0).alias("_side"),
                     F.lit(None).cast(left.schema[left_id].dataType).alias("_lid"),
                     F.col(value).alias("_v"))
    l_ = left.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(1).alias("_side"),
                     F.col(left_id).alias("_lid"),
                     F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    u = r.unionByName(l_)
    seg = (F.floor(epoch_seconds("_t") / segment_seconds) if segment_seconds else F.lit(0))
    u = u.withColumn("_seg", seg)
    w = (Window.partitionBy("_k", "_seg").orderBy("_t", "_side", "_lid")
         .rowsBetween(Window.unboundedPreceding, 0))
    u = u.withColumn("_state", F.last("_v", ignorenulls=True).over(w))
    if segment_seconds:
        last_r = (u.filter(F.col("_side") == 0).groupBy("_k", "_seg")
                  .agg(F.max_by("_v", F.struct("_t")).alias("_seg_last")))
        ws = Window.partitionBy("_k").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        # segments holding only left rows still need the carry: take it from the
        # latest earlier segment that had right rows
        lseg = u.filter(F.col("_side") == 1).select("_k", "_seg").distinct()
        allseg = lseg.unionByName(last_r.select("_k", "_seg")).distinct()
        c2 = allseg.join(last_r, ["_k", "_seg"], "left")
        c2 = c2.withColumn("_carry", F.last("_seg_last", ignorenulls=True).over(ws))
        u = u.join(c2.select("_k", "_seg", "_carry"), ["_k", "_seg"], "left")
        u = u.withColumn("_state", F.coalesce("_state", "_carry"))
    out = u.filter(F.col("_side") == 1).select(F.col("_lid").alias(left_id),
                                               F.col("_state").alias(f"{value}_asof"))
    return left.join(out, left_id)


def finalizable(outcomes: DataFrame, challenges: DataFrame, finalized: DataFrame, key: str,
                posted: str, now, window_s: int = 86400) -> DataFrame:
    """Op 42: outcomes whose dispute window has passed at ``now``, that were
    not challenged and are not yet finalized (two anti joins)."""
    ripe = outcomes.filter(epoch_seconds(posted) + window_s <= epoch_seconds(now))
    return (ripe.join(challenges.select(key), key, "left_anti")
            .join(finalized.select(key), key, "left_anti"))


def satisfy_all(hits: DataFrame, constraints: DataFrame, qid: str, cid: str, doc: str,
                score: str) -> DataFrame:
    """Op 43: relational division - documents matched by every constraint of
    a query; score is the sum of the hit scores.

    ``hits(cid, doc, score)`` with one row per (cid, doc), ``constraints(qid, cid)``.

    Candidates come only from each query's rarest constraint (fewest hits;
    a constraint without hits yields none), then every constraint of the
    query is verified by an equi-join on the (cid, doc) pair.  A constraint
    shared by most queries and most documents (a stopword) is never joined
    wholesale, so no (query, document) pair list is built beyond the
    rarest constraint's hits.
    """
    cons = constraints.select(qid, cid).distinct()
    need = cons.groupBy(qid).agg(F.count(F.lit(1)).alias("_need"))
    freq = hits.groupBy(cid).agg(F.count(F.lit(1)).alias("_f"))
    rare = (cons.join(freq, cid, "left").fillna(0, ["_f"]).groupBy(qid)
            .agg(F.min_by(cid, F.struct("_f", cid)).alias(cid)))
    cand = rare.join(hits.select(cid, doc), cid).select(qid, doc)
    check = cand.join(cons, qid).join(hits.select(cid, doc, score), [cid, doc])
    got = check.groupBy(qid, doc).agg(F.count(F.lit(1)).alias("_got"), F.sum(score).alias("score"))
    return got.join(need, qid).filter(F.col("_got") == F.col("_need")).drop("_got", "_need")


def baseline_delta(runs: DataFrame, group: str, variant: str, baseline: str,
                   metrics: Sequence[str]) -> DataFrame:
    """Op 44: every run of a group against the group's baseline variant:
    relative change in percent per metric (self join on the group)."""
    base = runs.filter(F.col(variant) == baseline).select(
        group, *[F.col(m).alias(f"_b_{m}") for m in metrics])
    out = runs.join(base, group, "left")
    for m in metrics:
        out = out.withColumn(f"delta_{m}_pct", F.try_divide(
            (F.col(m) - F.col(f"_b_{m}")) * 100.0, F.col(f"_b_{m}")))
    return out.drop(*[f"_b_{m}" for m in metrics])


# ---------------------------------------------------------------- nearest centroid
def _collect_block(blk: DataFrame):
    """A centroid block (at most ``max_centroids_per_pass`` rows) as arrays."""
    import numpy as np
    rows = blk.orderBy("ord").select("ord", "id", "v").collect()
    return (np.array([r.ord for r in rows], dtype=np.int64), [r.id for r in rows],
            np.array([r.v for r in rows], dtype=np.float64))


def _vectorized_best_of(point_id: str, point_vec: str, id_type):
    from pyspark.sql import types as T

    def best_of(df: DataFrame, block) -> DataFrame:
        import numpy as np
        import pandas as pd
        ords, ids, cm = block
        out_schema = T.StructType(df.schema.fields + [T.StructField(
            "_best", T.StructType([T.StructField("s", T.DoubleType()),
                                   T.StructField("no", T.LongType()),
                                   T.StructField("id", id_type)]))])

        def fn(it):
            for pdf in it:
                if len(pdf) == 0:
                    yield pdf.assign(_best=[])
                    continue
                X = np.stack([np.asarray(x, dtype=np.float64) for x in pdf[point_vec]])
                xn = np.linalg.norm(X, axis=1, keepdims=True)
                xn[xn == 0] = 1.0
                S_ = (X / xn) @ cm.T
                j = np.argmax(S_, axis=1)  # first maximum = smallest ordinal
                yield pdf.assign(_best=[{"s": float(S_[i, k]), "no": int(-ords[k]), "id": ids[k]}
                                        for i, k in enumerate(j)])

        return df.mapInPandas(fn, out_schema)

    return best_of


def assign_nearest(points: DataFrame, centroids: DataFrame, point_id: str, point_vec: str,
                   cid: str, cvec: str, corder: str, min_sim: float = 0.4,
                   max_centroids_per_pass: int = 4096) -> DataFrame:
    """Op 36: nearest centroid by cosine, without a join.

    The centroid list is a model, not data.  It is cut by the hash of its ids
    into blocks of about ``max_centroids_per_pass``; a block ships with the
    tasks of one pass, in which every Arrow batch of points is one BLAS
    product, and the winners of the passes are reduced per point.  The
    arithmetic is the same for any number of centroids.
    Similarity below ``min_sim`` -> NULL id but the similarity is kept; no
    centroid -> NULL id with similarity 0.0; a zero point vector is rejected
    (row dropped); a zero centroid scores 0; ties -> first centroid in
    ``corder``.
    """
    n = centroids.count()
    p = points.filter(S.sq_norm(point_vec) > 0)
    id_type = centroids.schema[cid].dataType
    if n == 0:
        return p.withColumn(cid, F.lit(None).cast(id_type)).withColumn("similarity", F.lit(0.0))
    n_pass = -(-n // max_centroids_per_pass)
    c = centroids.select(F.col(corder).cast("long").alias("ord"), F.col(cid).alias("id"),
                         S.l2_normalize(cvec).alias("v")).withColumn(
        "_blk", F.pmod(F.xxhash64("id"), F.lit(n_pass)))
    best_of = _vectorized_best_of(point_id, point_vec, id_type)
    own = p.select(point_id, point_vec)
    u = None
    for k in range(n_pass):
        block = _collect_block(c.filter(F.col("_blk") == k))
        if len(block[1]):
            part = best_of(own, block).select(point_id, "_best")
            u = part if u is None else u.unionByName(part)
    u = u.groupBy(point_id).agg(F.max("_best").alias("_best"))
    sim = F.col("_best.s")
    return (p.join(u, point_id).withColumn("similarity", sim)
            .withColumn(cid, F.when(sim >= min_sim, F.col("_best.id")).cast(id_type))
            .drop("_best"))


def link_parents(child_members: DataFrame, parent_members: DataFrame, child: str, parent: str,
                 member: str, pos: str) -> DataFrame:
    """Op 37: parent of a child community = the parent community holding most
    of its members; ties -> the parent met first in member order; members
    without a parent do not vote; no vote -> NULL parent."""
    votes = (child_members.join(parent_members, member)
             .groupBy(child, parent).agg(F.count(F.lit(1)).alias("votes"),
                                         F.min(pos).alias("_first")))
    w = Window.partitionBy(child).orderBy(F.col("votes").desc(), F.col("_first").asc())
    best = votes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(
        child, parent, "votes")
    kids = child_members.select(child).distinct()
    return kids.join(best, child, "left")
