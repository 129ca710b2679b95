"""Set operations and sampling (ops 85-90)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import md5_uniform
from quarry.operators.windows import SEGMENT_ROWS, join_carries, range_segments, segmented_running


def set_compare(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Op 85: every name of A union B with its membership; intersect is
    ``in_a and in_b``, A except B is ``in_a and not in_b``.  One full outer
    join of the two distinct sets (both shuffled on the name)."""
    da = a.select(name).distinct().withColumn("in_a", F.lit(True))
    db = b.select(name).distinct().withColumn("in_b", F.lit(True))
    return (da.join(db, name, "full")
            .select(name, F.coalesce("in_a", F.lit(False)).alias("in_a"),
                    F.coalesce("in_b", F.lit(False)).alias("in_b")))


def union_names(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect_names(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_names(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).distinct()


def federate_hits(sources: Sequence[DataFrame], key: str, rank: str, source: str) -> DataFrame:
    """Op 86: union the hit lists of several sources, one row per identity
    key with the best rank and the sorted list of sources that found it."""
    u = sources[0]
    for s in sources[1:]:
        u = u.unionByName(s)
    return u.groupBy(key).agg(F.min(rank).alias("best_rank"),
                              F.sort_array(F.collect_set(source)).alias("sources"),
                              F.count(F.lit(1)).alias("n_hits"))


def dedup_keyed(df: DataFrame, key: str | Column, order: str, key_name: str = "key") -> DataFrame:
    """Op 87: one row per identity key, the one with the lowest ``order``.

    ``min_by`` is a partial aggregate, so a key held by a third of all rows
    reaches the reducer as one candidate per map task.
    """
    k = F.col(key) if isinstance(key, str) else key
    cols = df.columns
    g = df.withColumn(key_name, k).groupBy(key_name).agg(
        F.min_by(F.struct(*cols), F.col(order)).alias("_r"), F.count(F.lit(1)).alias("n_copies"))
    return g.select(key_name, *[F.col(f"_r.{c}").alias(c) for c in cols], "n_copies")


AUDIT_RATE_FLOOR = 0.005


def audit_sample(jobs: DataFrame, id_col: str, value: str, rate: Column | float,
                 high_value: int) -> DataFrame:
    """Op 88: deterministic Bernoulli selection: u = md5-derived uniform of
    the id, selected when u < max(rate, 0.5 %); jobs at or above the
    high-value threshold are always audited."""
    r = F.greatest(rate if isinstance(rate, Column) else F.lit(rate), F.lit(AUDIT_RATE_FLOOR))
    u = md5_uniform(F.col(id_col))
    forced = F.col(value) >= high_value
    return (jobs.withColumn("u", u)
            .withColumn("audited", forced | (F.col("u") < r))
            .withColumn("reason", F.when(forced, F.lit("forced"))
                        .when(F.col("u") < r, F.lit("sampled")).otherwise(F.lit("none"))))


def split_by_tokens(docs: DataFrame, source: str, order: Sequence[str], tokens: str,
                    test_budget: int, val_budget: int, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Op 89: per source, in order, the first ``test_budget`` tokens go to
    test, the next ``val_budget`` to val, the rest to train (a document is
    placed by the running total before it, so splits are disjoint).  Totals
    are carried over segments of ``segment_rows`` documents."""
    cut = range_segments(docs, [source, *order], segment_rows)
    run = segmented_running(cut, source, order, F.col("_segment"), {"_cum": F.col(tokens).cast("long")}).drop("_segment")
    before = F.col("_cum") - F.col(tokens)
    split = (F.when(before < test_budget, F.lit("test"))
             .when(before < test_budget + val_budget, F.lit("val")).otherwise(F.lit("train")))
    return run.withColumn("split", split).drop("_cum")


def preference_pairs(items: DataFrame, group: str, length: str, id_col: str,
                     preferred: Column, rejected: Column, bucket_width: int = 1000) -> DataFrame:
    """Op 90: each preferred item paired with the rejected item of the same
    group whose length is nearest (ties: shorter, then smaller id).

    No pair enumeration.  Of equal lengths only the smallest rejected id can
    be chosen, so each (group, length) is first reduced to one row; the nearest
    rejected length below (last ignorenulls) and above (first ignorenulls) is
    found on those, in buckets of ``bucket_width`` lengths, which therefore
    hold at most that many rows.  A bucket without a rejected neighbour takes
    it from the nearest bucket below / above.  The preferred items then join
    the answer of their length.
    """
    items = items.filter(F.col(group).isNotNull())
    is_rejected, is_preferred = F.coalesce(rejected, F.lit(False)), F.coalesce(preferred, F.lit(False))
    u = (items.filter(F.col(length).isNotNull()).groupBy(group, length)
         .agg(F.min(F.when(is_rejected, F.col(id_col))).alias("_rid"), F.max(is_preferred).alias("_asked"))
         .withColumn("_seg", F.floor(F.col(length) / bucket_width)))
    cand = F.when(F.col("_rid").isNotNull(), F.struct(F.col(length).alias("l"), F.col("_rid").alias("i")))
    w = Window.partitionBy(group, "_seg").orderBy(length)
    u = (u.withColumn("_dn", F.last(cand, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_up", F.first(cand, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))))
    segs = u.groupBy(group, "_seg").agg(F.max(cand).alias("_last"), F.min(cand).alias("_first"))
    ws = Window.partitionBy(group).orderBy("_seg")
    segs = segs.select(
        group, "_seg",
        F.last("_last", ignorenulls=True).over(ws.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_carry_dn"),
        F.first("_first", ignorenulls=True).over(ws.rowsBetween(1, Window.unboundedFollowing))
        .alias("_carry_up"))
    near = (join_carries(u.filter("_asked"), segs, [group, "_seg"])
            .select(group, length, F.coalesce("_dn", "_carry_dn").alias("_dn"),
                    F.coalesce("_up", "_carry_up").alias("_up")))
    pref = join_carries(items.filter(preferred).select(group, length, id_col), near, [group, length])
    d_dn = F.col(length) - F.col("_dn.l")
    d_up = F.col("_up.l") - F.col(length)
    pick = (F.when(F.col("_dn").isNull(), F.col("_up"))
            .when(F.col("_up").isNull(), F.col("_dn"))
            .when(d_dn <= d_up, F.col("_dn")).otherwise(F.col("_up")))
    return (pref.withColumn("_p", pick).filter(F.col("_p").isNotNull())
            .select(group, F.col(id_col).alias("chosen_id"), F.col("_p.i").alias("rejected_id"),
                    (F.col(length) - F.col("_p.l")).alias("length_gap")))
