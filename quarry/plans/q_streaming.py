"""Bound streaming queries (ops 9, 114-125) and SQL twins of their final tables.

Each query stages the events table as a time-ordered folder of files (the
live tail of the log), runs the streaming operator with
``Trigger.AvailableNow`` and returns the table it produced.  Append-mode
operators get one trailing heartbeat file that repeats the latest event
time, so the watermark evicts what it has closed; the SQL twins apply the
same closure rule (``< max(ts)``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans import bindings as B
from quarry.plans.registry import register
from quarry.schemas import TABLES
from quarry.sources.ops import scratch_path
from quarry.sources.tables import Tables
from quarry.streaming import ops as S
from quarry.streaming import stateful as K

# Watermark delays: the staged log is replayed in event-time order, so a
# short delay drops no row and keeps the state bounded.
WM_SHORT = "10 minutes"
WM_HOUR = "1 hour"


def _staged_events(spark, root, name, tick=False, after=None):
    """The events as a folder of files; ``tick`` and ``after`` add a last file
    with an event of no user, at the last time or that much later."""
    e = Tables(spark, root).events
    path = S.stage_files(e, scratch_path(spark, name), "ts", 8)
    if tick:
        last = e.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1)
        S.append_tick(spark, path, last.withColumn("user_id", F.lit(-1).cast("long")))
    if after:
        last = e.groupBy().agg(F.max("ts").alias("ts")).select(
            F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr(f"INTERVAL {after}")).alias("ts"),
            F.lit(-1).cast("long").alias("user_id"), F.lit("tick").alias("event_type"),
            F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
        S.append_tick(spark, path, last)
    return S.stream_source(spark, path, TABLES["events"], "ts")


def ntz(c):
    return F.col(c).cast("timestamp_ntz")


@register("stream_source", """
SELECT event_type, count(*) AS n, round(sum(value), 6) AS value_sum FROM events GROUP BY 1""")
def q_stream_source(spark, root):
    s = _staged_events(spark, root, "stream-source")
    t = S.run_to_table(s, "stream-source", "append")
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                       F.round(F.sum("value"), 6).alias("value_sum"))


@register("stream_heartbeat_windows", """
SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       round(avg(value), 6) AS avg_value, count(*) AS beats
FROM events GROUP BY 1, 2, 3""")
def q_hb(spark, root):
    s = _staged_events(spark, root, "stream-hb")
    t = S.run_to_table(S.heartbeat_windows(s, "user_id", "ts", "value", "1 hour", WM_SHORT),
                       "stream-hb", "update", ["user_id", "window_start"])
    return t.select("user_id", ntz("window_start").alias("window_start"),
                    ntz("window_end").alias("window_end"), F.round("avg_value", 6).alias("avg_value"),
                    "beats")


LIVENESS_GAP_H = 6


@register("stream_liveness", f"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                                        < INTERVAL {LIVENESS_GAP_H} HOUR THEN 0 ELSE 1 END AS new_s
           FROM events),
s AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
sess AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL {LIVENESS_GAP_H} HOUR AS session_end,
                count(*) AS beats FROM s GROUP BY user_id, sid)
SELECT * FROM sess WHERE session_end < (SELECT max(ts) FROM events)""")
def q_liveness(spark, root):
    s = _staged_events(spark, root, "stream-live", tick=True)
    t = S.run_to_table(S.liveness_sessions(s, "user_id", "ts", f"{LIVENESS_GAP_H} hours", "0 seconds"),
                       "stream-live", "append")
    return t.filter(F.col("user_id") >= 0).select(
        "user_id", ntz("session_start").alias("session_start"),
        ntz("session_end").alias("session_end"), "beats")


CRASH_WINDOW_S = 3 * 86400
CRASH_THRESHOLD = 2
EXPIRE_DAYS = 1


def _restart_stream(spark, root, name):
    t = Tables(spark, root)
    r = B.restart_samples(t).withColumn("container_id", F.col("container_id").cast("long"))
    path = S.stage_files(r, scratch_path(spark, name), "ts", 8)
    last = r.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1)
    S.append_tick(spark, path, last.withColumn("container_id", F.lit(-1).cast("long")))
    return S.stream_source(spark, path, r.schema, "ts")


def _crash(spark, root, name):
    s = _restart_stream(spark, root, name)
    out = S.crashloop(s, "container_id", "epoch", "restart_count", "event_id", "ts",
                      CRASH_WINDOW_S, CRASH_THRESHOLD, f"{EXPIRE_DAYS} days")
    return S.run_to_table(out, name, "append").filter(F.col("container_id") >= 0)


_KEPT = ("list_filter(list_append(f.samples, {'t': s.epoch, 'c': s.restart_count}), "
         f"lambda x: x.t >= s.epoch - {CRASH_WINDOW_S})")

# The sequential fold as a recursive query: the state is the list of kept
# samples; a breach resets it to the current sample.
CRASH_SQL = B.with_sql(B.RESTARTS_SQL) + f""",
s AS (SELECT container_id, event_id, epoch, restart_count,
             row_number() OVER (PARTITION BY container_id ORDER BY epoch, event_id) AS i FROM restarts),
r AS (
  WITH RECURSIVE f(container_id, i, event_id, samples, delta, breach) AS (
    SELECT container_id, i, event_id, [{{'t': epoch, 'c': restart_count}}], CAST(0 AS BIGINT), FALSE
    FROM s WHERE i = 1
    UNION ALL
    SELECT s.container_id, s.i, s.event_id,
           CASE WHEN s.restart_count - {_KEPT}[1].c > {CRASH_THRESHOLD}
                THEN [{{'t': s.epoch, 'c': s.restart_count}}] ELSE {_KEPT} END,
           s.restart_count - {_KEPT}[1].c,
           s.restart_count - {_KEPT}[1].c > {CRASH_THRESHOLD}
    FROM f JOIN s ON s.container_id = f.container_id AND s.i = f.i + 1)
  SELECT * FROM f)
SELECT container_id, event_id, delta, breach FROM r"""


@register("stream_crashloop", CRASH_SQL)
def q_crash(spark, root):
    return _crash(spark, root, "stream-crash").filter(~F.col("expired")).select(
        "container_id", "event_id", "delta", "breach")


@register("expire_state", f"""
SELECT user_id AS container_id FROM events GROUP BY user_id
HAVING max(ts) + INTERVAL {EXPIRE_DAYS} DAY < (SELECT max(ts) FROM events)""")
def q_expire(spark, root):
    return _crash(spark, root, "stream-expire").filter(F.col("expired")).select("container_id")


FINAL_WINDOW_H = 24


FINAL_EVENTS_SQL = """o AS (SELECT o_orderkey AS job_id, 'outcome' AS kind, o_orderdate AS ts FROM orders),
r AS (SELECT DISTINCT l_orderkey AS job_id FROM lineitem WHERE l_returnflag = 'R'),
ev AS (SELECT * FROM o
       UNION ALL SELECT job_id, 'challenge', ts + CASE job_id % 3 WHEN 0 THEN INTERVAL (-1) HOUR
                 WHEN 1 THEN INTERVAL 1 HOUR ELSE INTERVAL 30 HOUR END FROM o JOIN r USING (job_id)
       UNION ALL SELECT job_id, 'outcome', ts + INTERVAL 2 HOUR FROM o WHERE job_id % 5 = 0
       UNION ALL SELECT job_id, 'note', ts FROM o WHERE job_id % 7 = 0)"""


@register("stream_finalizer", f"""
WITH {FINAL_EVENTS_SQL},
p AS (SELECT job_id, min(ts) AS ts FROM ev WHERE kind = 'outcome' GROUP BY 1),
c AS (SELECT job_id, min(ts) AS disputed FROM ev WHERE kind = 'challenge' GROUP BY 1)
SELECT job_id, ts AS posted_at, TRUE AS finalized FROM p LEFT JOIN c USING (job_id)
WHERE (disputed IS NULL OR disputed >= ts + INTERVAL {FINAL_WINDOW_H} HOUR)
  AND ts + INTERVAL {FINAL_WINDOW_H} HOUR < (SELECT max(ts) FROM ev)""")
def q_finalizer(spark, root):
    """Outcomes with challenges before, inside and after the window, replayed
    outcomes and events of another kind."""
    t = Tables(spark, root)
    o = t.orders.select(F.col("o_orderkey").alias("job_id"), F.lit("outcome").alias("kind"),
                        F.col("o_orderdate").alias("ts"))
    r = t.lineitem.filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("job_id")).distinct()
    when = F.expr("ts + CASE job_id % 3 WHEN 0 THEN INTERVAL -1 HOUR WHEN 1 THEN INTERVAL 1 HOUR "
                  "ELSE INTERVAL 30 HOUR END")
    ev = (o.unionByName(o.join(r, "job_id", "left_semi").select("job_id", F.lit("challenge").alias("kind"),
                                                              when.alias("ts")))
          .unionByName(o.filter("job_id % 5 = 0").withColumn("ts", F.expr("ts + INTERVAL 2 HOUR")))
          .unionByName(o.filter("job_id % 7 = 0").withColumn("kind", F.lit("note"))))
    path = S.stage_files(ev, scratch_path(spark, "stream-final"), "ts", 8)
    last = ev.orderBy(F.col("ts").desc()).limit(1)
    S.append_tick(spark, path, last.withColumn("job_id", F.lit(-1).cast("long")).withColumn(
        "kind", F.lit("tick")))
    s = S.stream_source(spark, path, ev.schema, "ts")
    out = S.run_to_table(S.finalizer(s, "job_id", "kind", "ts", f"{FINAL_WINDOW_H} hours"),
                         "stream-final", "append")
    return out.select("job_id", ntz("posted_at").alias("posted_at"), "finalized")


CONFIRM_DEPTH = 10
LATE_EVERY, LATE_BY = 97, 3000


@register("confirmed_only", f"""
SELECT event_id, CAST(1 AS BIGINT) AS copies FROM events
WHERE event_id <= (SELECT max(event_id) FROM events) - {CONFIRM_DEPTH}""")
def q_confirmed(spark, root):
    """Every ``LATE_EVERY``-th event comes ``LATE_BY`` blocks after its block, far
    below the confirmed height; every fifth event comes again that much later."""
    e = Tables(spark, root).events.select("event_id", F.col("event_id").alias("arrival"))
    late = (F.col("event_id") % LATE_EVERY == 0) & (F.col("event_id") % 5 != 0)
    e = (e.withColumn("arrival", F.when(late, F.col("arrival") + LATE_BY).otherwise(F.col("arrival")))
         .unionByName(e.filter("event_id % 5 = 0").withColumn("arrival", F.col("arrival") + LATE_BY)))
    top = e.agg(F.max("event_id")).first()[0]
    path = S.stage_files(e, scratch_path(spark, "stream-confirm"), "arrival", 12)
    S.append_tick(spark, path, e.limit(1).select(F.lit(top).cast("long").alias("event_id"),
                                                 F.lit(top).cast("long").alias("arrival")))
    s = S.stream_source(spark, path, e.schema, None)
    out = S.run_to_table(K.confirmed(s, "event_id", "event_id", CONFIRM_DEPTH), "stream-confirm", "append")
    return out.groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"))


@register("stream_rate_limit", """
SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n,
       count(*) > CASE WHEN max(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END) = 1 THEN 5 ELSE 3 END
         AS over_limit
FROM events GROUP BY 1, 2""")
def q_rate(spark, root):
    s = _staged_events(spark, root, "stream-rate").withColumn("auth", F.col("user_id") % 2 == 0)
    out = S.rate_limit(s, "user_id", "ts", "1 day", 3, 5, "auth", WM_HOUR)
    t = S.run_to_table(out, "stream-rate", "update", ["user_id", "window_start"])
    return t.select("user_id", ntz("window_start").alias("window_start"), "n", "over_limit")


CARD_STATE_SQL = ("CASE event_type WHEN 'signup' THEN 'unclaimed' WHEN 'view' THEN 'claimed' "
                  "WHEN 'click' THEN 'claimed' WHEN 'purchase' THEN 'done' ELSE 'failed' END")
STALE_AGE_S = 6 * 3600


@register("stale_claims", f"""
WITH l AS (SELECT user_id, arg_max({CARD_STATE_SQL}, ts) AS state, max(ts) AS ts FROM events GROUP BY 1)
SELECT user_id, CASE WHEN state = 'claimed'
                          AND epoch_us(ts) // 1000000 < epoch_us((SELECT max(ts) FROM events)) // 1000000
                                                        - {STALE_AGE_S}
                     THEN 'unclaimed' ELSE state END AS state
FROM l""")
def q_stale(spark, root):
    e = Tables(spark, root).events
    last = e.groupBy("user_id").agg(F.max_by(F.struct("ts", F.expr(CARD_STATE_SQL).alias("state")), "ts")
                                    .alias("_l")).select("user_id", "_l.ts", "_l.state")
    now = e.select(F.max("ts")).scalar()
    return S.stale_claims(last, "state", "ts", now, STALE_AGE_S).select("user_id", "state")


@register("first_claim_wins", """
WITH c AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS card, user_id, ts FROM events
           WHERE event_type IN ('view', 'click'))
SELECT event_id, card, user_id,
       CASE WHEN event_id = arg_min(event_id, (ts, event_id)) OVER (PARTITION BY card) THEN 'claim'
            ELSE 'conflict' END AS outcome
FROM c""")
def q_first_claim(spark, root):
    e = Tables(spark, root).events.filter(F.col("event_type").isin("view", "click")).select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("card"), "user_id", "ts")
    return S.first_claim_wins(e, "card", "ts", "event_id").select("event_id", "card", "user_id",
                                                                 "outcome")


@register("stream_first_claim", """
WITH c AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS card, user_id, ts FROM events
           WHERE event_type IN ('view', 'click'))
SELECT event_id, card, user_id,
       CASE WHEN event_id = arg_min(event_id, (ts, event_id)) OVER (PARTITION BY card) THEN 'claim'
            ELSE 'conflict' END AS outcome
FROM c""")
def q_stream_first_claim(spark, root):
    """Op 122 as a stream: the claims of a card lie in many micro-batches."""
    s = _staged_events(spark, root, "stream-claims", after="1 hour")
    s = s.filter(F.col("event_type").isin("view", "click", "tick")).withColumn(
        "card", F.when(F.col("event_type") == "tick", -1).otherwise(F.get_json_object("props", "$.k").cast("long")))
    return S.run_to_table(K.claims(s, "card", "ts", "event_id", "user_id"), "stream-claims", "append").filter(
        F.col("card") >= 0)


@register("stream_stale_claims", f"""
WITH l AS (SELECT user_id, arg_max({CARD_STATE_SQL}, (ts, event_id)) AS state, max(ts) AS ts FROM events GROUP BY 1)
SELECT user_id, CASE WHEN state = 'claimed'
                          AND epoch_us(ts) // 1000000 < epoch_us((SELECT max(ts) FROM events)) // 1000000
                                                        - {STALE_AGE_S}
                     THEN 'unclaimed' ELSE state END AS state
FROM l""")
def q_stream_stale(spark, root):
    """Op 121 as a stream: timers flip stale claims back."""
    s = _staged_events(spark, root, "stream-stale", after="1 second").withColumn("state", F.expr(CARD_STATE_SQL))
    out = S.run_to_table(K.stale_cards(s, "user_id", "state", "ts", "event_id", STALE_AGE_S), "stream-stale", "append")
    last = out.filter(F.col("card") >= 0).groupBy("card").agg(
        F.max_by("state", F.struct("ts", "event_id", "stale")).alias("state"))
    return last.select(F.col("card").alias("user_id"), "state")


@register("stream_dedup", """
SELECT event_type, count(*) AS n FROM events GROUP BY 1""")
def q_dedup(spark, root):
    """Every event comes twice, the copy in a later file: four slices of time,
    each read again as a whole before the next."""
    e = Tables(spark, root).events
    lo, hi = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))),
                   F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    slice_ = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - lo) * 4 / (hi - lo + 1))
    both = e.withColumn("turn", 2 * slice_).unionByName(e.withColumn("turn", 2 * slice_ + 1))
    path = scratch_path(spark, "stream-dedup")
    for turn in range(8):
        S.stage_files(both.filter(F.col("turn") == turn).drop("turn"), path, "ts", 1, pause=1.1)
    s = S.stream_source(spark, path, TABLES["events"], "ts")
    # a copy may come as long after its original as a slice of the log is long
    slack = f"{(hi - lo) // 4_000_000 + 3600} seconds"
    t = S.run_to_table(S.stream_dedup(s, "event_id", "ts", slack), "stream-dedup", "append")
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("stream_state_table", """
SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value
FROM events GROUP BY 1""")
def q_state_table(spark, root):
    s = _staged_events(spark, root, "stream-state")
    t = S.run_to_table(S.latest_state(s, "user_id", "ts", ["event_type", "value"], WM_HOUR),
                       "stream-state", "update", ["user_id"])
    return t.select("user_id", ntz("ts").alias("ts"), "event_type", "value")


@register("stream_state_read", """
SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value
FROM events GROUP BY 1""")
def q_state_read(spark, root):
    """Op 124 without a sink: readers see the query's own state store."""
    s = _staged_events(spark, root, "stream-state-read")
    ckpt = S.run_to_state(S.latest_state(s, "user_id", "ts", ["event_type", "value"], WM_HOUR), "stream-state-read")
    t = S.read_latest_state(spark, ckpt, "user_id", ["ts", "event_type", "value"])
    return t.select("user_id", ntz("ts").alias("ts"), "event_type", "value")


@register("telemetry_counts", """
WITH w AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS window_start
           FROM events, range(0, 4) r(k))
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n
FROM w GROUP BY ALL""")
def q_telemetry(spark, root):
    s = _staged_events(spark, root, "stream-telemetry")
    t = S.run_to_table(S.telemetry_counts(s, "event_type", "ts", "1 hour", "15 minutes", WM_SHORT),
                       "stream-telemetry", "update", ["window_start", "event_type"])
    return t.select(ntz("window_start").alias("window_start"), ntz("window_end").alias("window_end"),
                    "event_type", "n")

