"""Window operators (ops 67-79) and skew-safe window building blocks.

A plain ``Window.partitionBy(key)`` sends every row of one key to one task.
When a key may hold a third of all rows that task is the whole job, so the
ordered operators here are built on three helpers that split a key into
ordered segments and stitch the segments back together exactly:

* :func:`segmented_running` - running sums (and the running minimum of a
  running sum) as a segment-local window plus a carry from the per-segment
  aggregate, which is one row per (key, segment).
* :func:`split_range_window` - a ``rangeBetween(-w, 0)`` frame evaluated per
  (key, bucket of width w); each bucket also receives the rows of the bucket
  before it as read-only context, so every frame is complete.
* :func:`seq_index` - a dense 1-based position within each key, computed the
  same way as a running count, so row-count frames (last n rows) become range
  frames on the position.
* :func:`range_segments` - segments cut from counts where no column of the data
  bounds them: about ``rows`` rows each, however the order is distributed.
  Carries then are one row per ``rows`` rows of a key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.ops import scratch_path

#: Rows of one segment of :func:`range_segments`.
SEGMENT_ROWS = 1_000_000


def _cols(xs):
    return [xs] if isinstance(xs, (str, Column)) else list(xs)


# ---------------------------------------------------------------- helpers
def join_carries(rows: DataFrame, carries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``carries`` of their keys; a null key is
    a key like any other."""
    there = carries.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                           *[c for c in carries.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return rows.join(there, same).drop(*[f"__k{i}" for i in range(len(keys))])


def range_segments(df: DataFrame, by: Sequence[str], rows: int = SEGMENT_ROWS,
                   name: str = "_segment") -> DataFrame:
    """``df`` with the number of its range partition under ``by``, as many
    partitions as its count asks for; rows equal in ``by`` share one.  The cut
    comes from a sample, so the numbered rows are written to the shared
    checkpoint folder: every later step sees the same segments (pass no wide
    columns that can be joined afterwards)."""
    n = max(1, math.ceil(df.count() / rows))
    path = scratch_path(df.sparkSession, "segments")
    cut = df.repartitionByRange(n, *by).withColumn(name, F.spark_partition_id())
    cut.write.parquet(path)
    return df.sparkSession.read.schema(cut.schema).parquet(path)


def segmented_running(df: DataFrame, key: str | Sequence[str], order: Sequence[str],
                      segment: Column, values: dict[str, Column],
                      min_of: Sequence[str] = (), largest: dict[str, Column] | None = None) -> DataFrame:
    """Add running sums ``values`` per key in ``order``; split by ``segment``.

    ``segment`` must be monotone in ``order`` within a key (a time bucket,
    ``floor(position / n)`` or :func:`range_segments`).  For each name in
    ``min_of`` the running minimum of that running sum is added as
    ``<name>_min``; ``largest`` adds running maxima.
    """
    largest = largest or {}
    keys = _cols(key)
    d = df.withColumn("__seg", segment)
    for n, c in {**values, **largest}.items():
        d = d.withColumn(f"__v_{n}", c)
    w_local = (Window.partitionBy(*keys, "__seg").orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, 0))
    for n in values:
        d = d.withColumn(f"__l_{n}", F.sum(f"__v_{n}").over(w_local))
    for n in largest:
        d = d.withColumn(f"__l_{n}", F.max(f"__v_{n}").over(w_local))
    for n in min_of:
        d = d.withColumn(f"__lm_{n}", F.min(f"__l_{n}").over(w_local))
    # one row per (key, segment): totals and local minima of the prefix
    aggs = [F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values]
    aggs += [F.min(f"__l_{n}").alias(f"__sm_{n}") for n in min_of]
    aggs += [F.max(f"__v_{n}").alias(f"__t_{n}") for n in largest]
    seg = d.groupBy(*keys, "__seg").agg(*aggs)
    w_seg = Window.partitionBy(*keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    for n in values:
        seg = seg.withColumn(f"__o_{n}", F.coalesce(F.sum(f"__t_{n}").over(w_seg), F.lit(0)))
    for n in min_of:
        seg = seg.withColumn(f"__pm_{n}", F.min(F.col(f"__o_{n}") + F.col(f"__sm_{n}")).over(w_seg))
    for n in largest:
        seg = seg.withColumn(f"__o_{n}", F.max(f"__t_{n}").over(w_seg))
    seg = seg.select(*keys, "__seg", *[f"__o_{n}" for n in [*values, *largest]], *[f"__pm_{n}" for n in min_of])
    out = join_carries(d, seg, [*keys, "__seg"])
    for n in values:
        out = out.withColumn(n, F.col(f"__l_{n}") + F.col(f"__o_{n}"))
    for n in largest:
        out = out.withColumn(n, F.greatest(f"__l_{n}", f"__o_{n}"))
    for n in min_of:
        here = F.col(f"__lm_{n}") + F.col(f"__o_{n}")
        out = out.withColumn(f"{n}_min", F.when(F.col(f"__pm_{n}").isNull(), here)
                             .otherwise(F.least(here, F.col(f"__pm_{n}"))))
    drop = [c for c in out.columns if c.startswith("__")]
    return out.drop(*drop)


def segmented_shift(df: DataFrame, key: str | Sequence[str], order: Sequence[str],
                    segment: Column, cols: Sequence[str], lead: bool = False,
                    suffix: str = "_prev") -> DataFrame:
    """``lag`` (or ``lead``) by one row of ``cols`` within a key, computed
    per (key, segment); the first (last) row of a segment takes the value
    from the last (first) row of the nearest earlier (later) segment, found
    on the one-row-per-segment table.  ``order`` names columns; ``segment``
    must be monotone in ``order``."""
    keys = _cols(key)
    d = df.withColumn("__seg", segment)
    w = Window.partitionBy(*keys, "__seg").orderBy(*order)
    ordk = F.struct(*order)
    shift = F.lead if lead else F.lag
    # the segment's first row (lag) or last row (lead) takes the carried value
    edge_order = [F.col(c).desc() for c in order] if lead else [F.col(c) for c in order]
    d = d.withColumn("__edge", F.row_number().over(
        Window.partitionBy(*keys, "__seg").orderBy(*edge_order)) == 1)
    for c in cols:
        d = d.withColumn(f"__in_{c}", shift(c).over(w))
    pick = F.min_by if lead else F.max_by
    seg = d.groupBy(*keys, "__seg").agg(*[pick(F.col(c), ordk).alias(f"__e_{c}") for c in cols])
    ws = Window.partitionBy(*keys).orderBy("__seg")
    seg = seg.select(*keys, "__seg", *[shift(f"__e_{c}").over(ws).alias(f"__b_{c}") for c in cols])
    out = join_carries(d, seg, [*keys, "__seg"])
    for c in cols:
        out = out.withColumn(f"{c}{suffix}", F.when(F.col("__edge"), F.col(f"__b_{c}"))
                             .otherwise(F.col(f"__in_{c}")))
    return out.drop(*[x for x in out.columns if x.startswith("__")])


def seq_index(df: DataFrame, key: str | Sequence[str], order: Sequence[str], segment: Column,
              name: str = "pos") -> DataFrame:
    """1-based position of each row within its key under ``order``."""
    return segmented_running(df, key, order, segment, {name: F.lit(1).cast("long")})


def split_range_window(df: DataFrame, key: str | Sequence[str], pos: str, width,
                       compute: Callable[[DataFrame, Window], DataFrame]) -> DataFrame:
    """Evaluate a ``rangeBetween(-width, 0)`` frame on ``pos`` per key, split
    into buckets of ``width``.  ``compute(df, window)`` adds columns; only the
    rows that own their bucket are returned.  ``pos`` must be numeric."""
    keys = _cols(key)
    b = F.floor(F.col(pos) / F.lit(width)).cast("long")
    own = df.withColumn("_b", b).withColumn("_own", F.lit(True))
    ctx = df.withColumn("_b", b + 1).withColumn("_own", F.lit(False))
    both = own.unionByName(ctx)
    w = Window.partitionBy(*keys, "_b").orderBy(pos).rangeBetween(-width, 0)
    return compute(both, w).filter("_own").drop("_b", "_own")


def epoch_seconds(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_seconds(c.cast("timestamp"))


# ---------------------------------------------------------------- operators
def restart_delta(samples: DataFrame, key: str = "container_id", ts: str = "epoch",
                  counter: str = "restart_count", window: int = 120,
                  threshold: int = 5) -> DataFrame:
    """Op 67: counter now minus counter at the oldest sample with
    ts >= now - window; breach when the delta is strictly above threshold."""
    def comp(d, w):
        return d.withColumn("delta", F.col(counter) - F.first(counter).over(w))
    out = split_range_window(samples, key, ts, window, comp)
    return out.withColumn("breach", F.col("delta") > threshold)


def rolling_fail_rate(audits: DataFrame, node: str, order: Sequence[str], segment: Column,
                      n: int = 100, m: int = 10) -> DataFrame:
    """Op 68: failure share of the last n audits and max severity of the
    last m, per node (row frames turned into range frames on the position)."""
    if m > n:
        raise ValueError("m must not exceed n")
    idx = seq_index(audits, node, order, segment, "pos")
    idx = idx.withColumn("_fail", F.when(F.col("pass"), 0.0).otherwise(1.0))

    def comp(d, w):
        # both frames fit in the same buckets of width n-1: one pass, one sort
        w_m = Window.partitionBy(node, "_b").orderBy("pos").rangeBetween(-(m - 1), 0)
        return (d.withColumn("fail_rate", F.avg("_fail").over(w))
                .withColumn("max_sev_recent", F.max("severity").over(w_m)))

    return split_range_window(idx, node, "pos", n - 1, comp).drop("_fail")


def ema(df: DataFrame, key: str, order: Sequence[str], value: str, n: int = 1000,
        segment: Column | None = None) -> DataFrame:
    """Op 70: exponential moving average, alpha = 2/(n+1), seeded with the
    first value: e_i = sum_{j<=i} c_j q^(i-j), q = 1-a, c_1 = x_1, c_j = a x_j.

    Exact for any series length and no task holds a whole key:
    1. position i of every row in its key (:func:`seq_index`, skew-safe);
    2. positions are cut into blocks of B rows, B chosen so q^-B stays far
       from overflow; inside a block the EMA from a zero start is a running
       sum with block-relative exponents (window per (key, block));
    3. block totals T_s (one row per block) are chained by Horner's rule,
       E_s = E_{s-1} q^B + T_s, over the last K blocks only: an older
       block is weighted by q^(K B) < 1e-320, below double range, exactly
       as in a sequential evaluation;
    4. e_i = q^(i - start + 1) E_{s-1} + local_i.
    """
    import math
    a = 2.0 / (n + 1)
    lq = math.log(1.0 - a)
    blk = max(1, int(600 / -lq))           # rows per block: q^-blk <= e^600
    k_back = int(745 / (blk * -lq)) + 1    # blocks that can still contribute
    seg = segment if segment is not None else F.lit(0)
    idx = seq_index(df, key, order, seg, "_i")
    idx = idx.withColumn("_ps", F.floor((F.col("_i") - 1) / blk)).withColumn(
        "_a", F.col("_ps") * blk + 1)
    c = F.when(F.col("_i") == 1, F.col(value)).otherwise(F.lit(a) * F.col(value))
    idx = idx.withColumn("_c", c * F.exp(-lq * (F.col("_i") - F.col("_a"))))
    w = Window.partitionBy(key, "_ps").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    idx = idx.withColumn("_loc", F.exp(lq * (F.col("_i") - F.col("_a"))) * F.sum("_c").over(w))
    segs = idx.groupBy(key, "_ps").agg(F.max("_i").alias("_b"), F.min("_a").alias("_a"),
                                       F.sum("_c").alias("_sc"))
    segs = segs.withColumn("_T", F.exp(lq * (F.col("_b") - F.col("_a"))) * F.col("_sc"))
    qb = math.exp(lq * blk)
    ws = Window.partitionBy(key).orderBy("_ps")
    segs = segs.withColumn("_last", F.collect_list("_T").over(ws.rowsBetween(-k_back, 0)))
    segs = segs.withColumn("_E", F.aggregate("_last", F.lit(0.0), lambda acc, t: acc * qb + t))
    segs = segs.withColumn("_carry", F.coalesce(F.lag("_E").over(ws), F.lit(0.0)))
    out = idx.join(segs.select(key, "_ps", "_carry"), [key, "_ps"])
    e = F.exp(lq * (F.col("_i") - F.col("_a") + 1)) * F.col("_carry") + F.col("_loc")
    return out.withColumn("ema", e).drop("_i", "_ps", "_a", "_c", "_loc", "_carry")


# Fixed values of the audit-rate control law.
FLOOR_AUDIT_RATE = 0.005
BASELINE_AUDIT_RATE = 0.05


def category_bump(fraud_rate) -> Column:
    """0 at 0 %, 0.5 at 10 %, 1.0 from 50 % on, linear in between."""
    f = F.col(fraud_rate) if isinstance(fraud_rate, str) else fraud_rate
    return (F.when(f <= 0, F.lit(0.0)).when(f <= 0.1, f * 5.0)
            .when(f < 0.5, F.lit(0.5) + (f - 0.1) * 1.25).otherwise(F.lit(1.0)))


def node_bump(fail_rate, max_sev_recent) -> Column:
    """0.95 x failure share of the last 100 audits; 1.0 when one of the last
    10 had severity above 0.5."""
    return F.when(F.col(max_sev_recent) > 0.5, F.lit(1.0)).otherwise(F.col(fail_rate) * 0.95)


def audit_rate(df: DataFrame, fail_rate: str = "fail_rate", max_sev: str = "max_sev_recent",
               fraud_ema: str = "ema") -> DataFrame:
    """Op 69: clamp(0.05 + node bump + category bump, 0.005, 1) on rows that
    carry op 68's rolling columns and op 70's category EMA."""
    r = F.lit(BASELINE_AUDIT_RATE) + node_bump(fail_rate, max_sev) + category_bump(fraud_ema)
    return df.withColumn("audit_rate", F.least(F.greatest(r, F.lit(FLOOR_AUDIT_RATE)), F.lit(1.0)))


def reputation(outcomes: DataFrame, node: str, order: Sequence[str], segment: Column,
               passed: str = "pass", gain: int = 1, loss: int = 10) -> DataFrame:
    """Op 71: +gain per pass, -loss per fail, floored at 0 after every step.

    Closed form of the floored walk: r_i = c_i - min(0, min_{j<=i} c_j) with
    c the unfloored running sum (equal to the sequential fold).
    """
    step = F.when(F.col(passed), F.lit(gain)).otherwise(F.lit(-loss)).cast("long")
    run = segmented_running(outcomes, node, order, segment, {"_c": step}, min_of=["_c"])
    return (run.withColumn("reputation", F.col("_c") - F.least(F.lit(0), F.col("_c_min")))
            .drop("_c", "_c_min"))


def reputation_signed(outcomes: DataFrame, node: str, order: Sequence[str], segment: Column,
                      passed: str = "pass", burn_at: int = 10) -> DataFrame:
    """Op 72: v1 signed score, default count, burn flag at >= burn_at defaults,
    negative score blocks new jobs."""
    step = F.when(F.col(passed), F.lit(1)).otherwise(F.lit(-1)).cast("long")
    dflt = F.when(F.col(passed), F.lit(0)).otherwise(F.lit(1)).cast("long")
    run = segmented_running(outcomes, node, order, segment, {"score": step, "default_count": dflt})
    return (run.withColumn("burned", F.col("default_count") >= burn_at)
            .withColumn("blocked", F.col("score") < 0))


def running_balance(journal: DataFrame, node: str, order: Sequence[str], segment: Column,
                    amount: str = "signed_amount") -> DataFrame:
    """Op 73: balance after each event; a withdrawal beyond the balance is flagged."""
    run = segmented_running(journal, node, order, segment, {"balance": F.col(amount)})
    return run.withColumn("overdraft", F.col("balance") < 0)


def rolling_volume(settlements: DataFrame, pool: str, ts: str, value: str,
                   days: int = 30) -> DataFrame:
    """Op 74: sum of value over the last ``days`` days (inclusive) per pool."""
    d = settlements.withColumn("_t", epoch_seconds(ts))

    def comp(x, w):
        return x.withColumn("volume_30d", F.sum(value).over(w))
    return split_range_window(d, pool, "_t", days * 86400, comp).drop("_t")


def tier_changes(readings: DataFrame, key: str, order: Sequence[str], tier: str,
                 segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Op 75: readings whose tier differs from the previous reading of the key
    (a segmented lag over segments of ``segment_rows`` readings)."""
    cut = range_segments(readings, [key, *order], segment_rows)
    prev = segmented_shift(cut, key, order, F.col("_segment"), [tier])
    return (prev.withColumnRenamed(f"{tier}_prev", "prev_tier").drop("_segment")
            .filter(F.col("prev_tier").isNotNull() & (F.col("prev_tier") != F.col(tier))))


def lifecycle_check(events: DataFrame, key: str, order: Sequence[str], state: str,
                    allowed: DataFrame, initial: str = "unclaimed",
                    segment: Column | None = None) -> DataFrame:
    """Op 76: transitions (previous state -> state) that are not in
    ``allowed(from_state, to_state)``; the first event starts from
    ``initial``.  The previous state is a segmented lag (a key's history is
    split by ``segment``, default: the day of the first order column)."""
    seg = segment if segment is not None else F.floor(epoch_seconds(order[0]) / 86400)
    t = segmented_shift(events, key, order, seg, [state], suffix="_prev")
    t = t.withColumn("from_state", F.coalesce(F.col(f"{state}_prev"), F.lit(initial))).drop(
        f"{state}_prev")
    t = t.withColumnRenamed(state, "to_state")
    return t.join(allowed, ["from_state", "to_state"], "left_anti")


def stage_durations(events: DataFrame, run: str, ts: str, stage: str, tie: str,
                    segment: Column | None = None) -> DataFrame:
    """Op 77: each stage lasts until the next event of the run; per run and
    stage the total seconds and its share of the run (last event: 0 s).
    The next event time is a segmented lead (default segment: the day)."""
    seg = segment if segment is not None else F.floor(epoch_seconds(ts) / 86400)
    d = segmented_shift(events.withColumn("_nts", F.col(ts)), run, [ts, tie], seg, ["_nts"],
                        lead=True, suffix="_next")
    nxt = F.col("_nts_next")
    d = d.withColumn("_dur", F.coalesce(
        epoch_seconds(nxt) - epoch_seconds(ts), F.lit(0)).cast("long"))
    per = d.groupBy(run, stage).agg(F.sum("_dur").alias("seconds"))
    tot = per.groupBy(run).agg(F.sum("seconds").alias("_tot"))
    return (per.join(tot, run)
            .withColumn("share", F.when(F.col("_tot") > 0, F.col("seconds") / F.col("_tot")))
            .drop("_tot"))


def queue_depth(events: DataFrame, queue: str, order: Sequence[str], segment: Column,
                delta: Column) -> DataFrame:
    """Op 78: depth gauge, running sum of +1 enqueue / -1 dequeue."""
    return segmented_running(events, queue, order, segment, {"depth": delta.cast("long")})


def rank_variants(runs: DataFrame, group: str, metric_cols: Sequence[str],
                  before: str | None = None, after: str | None = None,
                  segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Op 79: dense rank of every variant per metric within its group (lower
    is better, no measurement first); with ``before``/``after`` columns also
    the forgetting in percent, (after - before) / before * 100.

    A rank is the position of the value among the group's distinct values,
    counted by segments of ``segment_rows`` values."""
    out = runs
    for m in metric_cols:
        values = range_segments(runs.select(group, m).distinct(), [group, m], segment_rows)
        ranks = seq_index(values, group, [m], F.col("_segment"), f"rank_{m}").drop("_segment")
        out = join_carries(out, ranks, [group, m])
    if before and after:
        out = out.withColumn("forget_pct", F.try_divide((F.col(after) - F.col(before)) * 100.0,
                                                        F.col(before)))
    return out
