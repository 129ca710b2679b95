"""Streams with state and timers against their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarry.sources.ops import scratch_path
from quarry.streaming import ops as S
from quarry.streaming import stateful as K

T0 = dt.datetime(2026, 1, 1)


def staged(spark, name, batches, schema):
    """One file, and so one micro-batch, per list of rows."""
    path = scratch_path(spark, name)
    for rows in batches:
        S.append_tick(spark, path, spark.createDataFrame(rows, schema))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_late_and_repeated_events_are_confirmed_once(spark):
    schema = "event long, height long"
    first = [(i, i // 3) for i in range(300)]
    batches = [[r for r in first if r[0] % 10], [(900, 200)], [r for r in first if r[0] % 10 == 0] + first[:30],
               [(901, 210), (902, 95), (902, 95)], [(903, 215)], [(904, 216)]]
    s = staged(spark, "t-confirm", batches, schema)
    got = S.run_to_table(K.confirmed(s, "event", "height", 10), "t-confirm", state_partitions=2).collect()
    everything = {r for b in batches for r in b}
    assert sorted((r["event_id"], r["height"]) for r in got) == sorted(r for r in everything if r[1] <= 216 - 10)
    late = {r["event_id"] for r in got if r["late"]}
    assert late == {i for i, _ in first if i % 10 == 0} | {902}


def test_events_beyond_the_late_bound_are_dropped_and_counted(spark):
    schema = "event long, height long"
    # the watermark that drops rows is that of the micro-batch before
    batches = [[(1, 1), (2, 1000)], [(3, 2000)], [(7, 2000)], [(4, 1960), (5, 1900)], [(6, 2001)]]
    counts = {}
    s = staged(spark, "t-bound", batches, schema)
    got = S.run_to_table(K.confirmed(s, "event", "height", 10, late=50), "t-bound", state_partitions=2, counts=counts)
    assert {r["event_id"] for r in got.collect()} == {1, 2, 4}
    assert counts["dropped"] == 1 and counts["batches"] >= 4


@pytest.mark.parametrize("seed", [1, 2])
def test_claims_equal_the_batch_form(spark, seed):
    """A hot card's claims in every micro-batch, out of order within the delay."""
    rng = random.Random(seed)
    schema = "event_id long, card long, user_id long, ts timestamp"
    rows = [(i, 7 if rng.random() < 0.4 else rng.randint(0, 9), rng.randint(0, 5), at(10 * i)) for i in range(200)]
    rows += [(500 + i, 20 + i, 1, rows[50 * i][3]) for i in range(4)] + [(600, 7, 3, rows[0][3])]
    order = sorted(rows, key=lambda r: r[3] + dt.timedelta(seconds=rng.randint(0, 100)))
    batches = [order[45 * k:45 * k + 45] for k in range(5)]
    s = staged(spark, f"t-claims-{seed}", [*batches, [(-1, -1, 0, at(9000))]], schema)
    counts = {}
    got = S.run_to_table(K.claims(s, "card", "ts", "event_id", "user_id", "10 minutes"), "t-claims",
                         state_partitions=2, counts=counts).filter("card >= 0")
    want = S.first_claim_wins(spark.createDataFrame(rows, schema), "card", "ts", "event_id").select(*got.columns)
    assert counts["dropped"] == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_conflicts_come_out_as_they_arrive(spark):
    schema = "event_id long, card long, user_id long, ts timestamp"
    batches = [[(1, 1, 1, at(0)), (2, 1, 2, at(1))], [(-1, -1, 0, at(100))], [(3, 1, 3, at(101))], [(4, 1, 4, at(102))]]
    s = staged(spark, "t-conflict", batches, schema)
    got = S.run_to_table(K.claims(s, "card", "ts", "event_id", "user_id"), "t-conflict", state_partitions=1)
    # the last claims are decided though no watermark has passed them
    assert {r["event_id"]: r["outcome"] for r in got.filter("card > 0").collect()} == {
        1: "claim", 2: "conflict", 3: "conflict", 4: "conflict"}


def test_stale_claims_equal_the_batch_form(spark):
    rng = random.Random(6)
    schema = "card long, state string, ts timestamp, event_id long"
    rows = [(rng.randint(0, 30), rng.choice(["claimed", "claimed", "done", "failed"]), at(60 * i + rng.random()), i)
            for i in range(150)]
    s = staged(spark, "t-stale", [*[rows[30 * k:30 * k + 30] for k in range(5)], [(-1, "tick", at(9100), -1)]], schema)
    got = S.run_to_table(K.stale_cards(s, "card", "state", "ts", "event_id", 1800), "t-stale", state_partitions=2)
    last = (got.filter("card >= 0").groupBy("card")
            .agg(F.max_by("state", F.struct("ts", "event_id", "stale")).alias("state"), F.max("stale").alias("stale")))
    df = spark.createDataFrame(rows, schema)
    cards = df.groupBy("card").agg(F.max_by(F.struct("state", "ts"), F.struct("ts", "event_id")).alias("l")).select(
        "card", "l.state", "l.ts")
    want = {r["card"]: r["state"] for r in
            S.stale_claims(cards, "state", "ts", F.lit(at(9099)).cast("timestamp"), 1800).collect()}
    assert {r["card"]: r["state"] for r in last.collect()} == want
    assert {"claimed", "unclaimed"} <= set(want.values())


def test_copies_lie_in_later_files(spark):
    from conftest import SF_SMALL
    from quarry.plans import catalog
    paths = set()
    source = S.stream_source

    def seen(spark, path, *a, **k):
        paths.add(path)
        return source(spark, path, *a, **k)
    S.stream_source = seen
    try:
        catalog.QUERIES["stream_dedup"](spark, SF_SMALL).collect()
    finally:
        S.stream_source = source
    files = spark.read.parquet(paths.pop()).select("event_id", F.input_file_name().alias("file")).groupBy(
        "event_id").agg(F.count_distinct("file").alias("files"), F.count("*").alias("n"))
    assert files.filter("files <> 2 OR n <> 2").count() == 0


def test_state_is_read_as_of_a_batch(spark):
    """The state store after its last and after an earlier micro-batch is the
    latest row per key of the files read by then."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i % 5, "view", float(i), "{}") for i in range(60)]
    path = scratch_path(spark, "state-read")
    events = spark.createDataFrame(
        rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    S.stage_files(events, path, "ts", 3)
    stream = S.stream_source(spark, path, events.schema, "ts")
    ckpt = S.run_to_state(S.latest_state(stream, "user_id", "ts", ["value"], "1 hour"), "state-read", 2)
    read = lambda b: {r["user_id"]: r["value"] for r in S.read_latest_state(spark, ckpt, "user_id", ["value"], b).collect()}
    assert read(None) == {u: 55.0 + u for u in range(5)}
    first = read(0)
    assert set(first) == set(range(5)) and max(first.values()) < 40
    assert all(v % 5 == u for u, v in first.items())


def test_timers_of_a_bucket_keep_to_their_job(spark):
    """Outcomes and challenges of 300 jobs whose state lies in three rows."""
    rng = random.Random(8)
    rows = []
    for j in range(300):
        t = rng.randint(0, 5000) if j < 280 else rng.randint(6500, 6900)
        rows += [(j, "outcome", at(t))] if j % 11 else []
        rows += [(j, "challenge", at(t + rng.choice([-50, 50, 2000] if j < 280 else [50])))] if j % 3 == 0 else []
        rows += [(j, "outcome", at(t + 30))] if j % 5 == 0 and j % 11 else []
        rows += [(j, "note", at(t))] if j % 7 == 0 else []
    rows += [(None, "outcome", at(100))]
    rows.sort(key=lambda r: r[2])
    n = len(rows) // 6 + 1
    batches = [*[rows[n * k:n * k + n] for k in range(6)], [(-1, "tick", at(7100))]]
    s = staged(spark, "t-final", batches, "job_id long, kind string, ts timestamp")
    got = S.run_to_table(S.finalizer(s, window="1000 seconds", buckets=2), "t-final", state_partitions=2).collect()
    want = []
    for j in {r[0] for r in rows}:
        first = min((t for i, k, t in rows if i == j and k == "outcome"), default=None)
        against = min((t for i, k, t in rows if i == j and k == "challenge"), default=None)
        end = first and first + dt.timedelta(seconds=1000)
        if end and end < at(7100) and (against is None or against >= end):
            want.append((j, first))
    assert sorted(((r["job_id"], r["posted_at"]) for r in got), key=str) == sorted(want, key=str)
    assert 100 < len(want) < 250


def test_samples_of_a_bucket_keep_to_their_container(spark):
    """Restart counters and expiry of 60 containers whose state lies in two rows."""
    rng = random.Random(9)
    schema = "container_id long, event_id long, epoch long, restart_count long, ts timestamp"
    count, rows = {}, []
    for i in range(900):
        c, t = rng.randrange(60), 10 * i + rng.randrange(5)
        if c % 10 == 0 and 2000 < t < 7000:
            continue
        count[c] = count.get(c, 0) + rng.randrange(3)
        rows.append((c, i, t, count[c], at(t)))
    batches = [*[rows[150 * k:150 * k + 150] for k in range(6)], [(-1, -1, 9500, 0, at(9500))]]
    s = staged(spark, "t-crash", batches, schema)
    out = S.run_to_table(S.crashloop(s, window=1500, threshold=3, expire_after="2000 seconds", buckets=2), "t-crash",
                         state_partitions=2).filter("container_id >= 0").collect()
    got = {r["event_id"]: (r["delta"], r["breach"]) for r in out if not r["expired"]}
    own = [r for r in rows if r[0] % 10]                      # never silent long enough to expire
    want, held = {}, {}
    for c, i, t, n, _ in own:
        kept = [x for x in held.get(c, []) if x[0] >= t - 1500] + [(t, n)]
        delta = n - kept[0][1]
        want[i] = (delta, delta > 3)
        held[c] = [(t, n)] if delta > 3 else kept
    assert {i: got[i] for i in want} == want and any(b for _, b in want.values())
    assert len(got) == len(rows)
    assert {r["container_id"] for r in out if r["expired"]} >= {c for c in range(0, 60, 10)}


def test_claims_of_a_bucket_go_stale_alone(spark):
    """Every card has its own timer, whatever others in its row do."""
    rows = [(c, "claimed", at(10 * c), c) for c in range(200)] + [(c, "done", at(1500 + c), 1000 + c) for c in range(0, 200, 4)]
    rows.sort(key=lambda r: r[2])
    batches = [*[rows[50 * k:50 * k + 50] for k in range(5)], [(-1, "tick", at(3000), -1)]]
    s = staged(spark, "t-stale2", batches, "card long, state string, ts timestamp, event_id long")
    out = S.run_to_table(K.stale_cards(s, "card", "state", "ts", "event_id", 1800, buckets=2), "t-stale2",
                         state_partitions=2).filter("card >= 0").collect()
    flipped = {r["card"] for r in out if r["stale"]}
    # the watermark ends a second before the tick
    assert flipped == {c for c in range(200) if c % 4 and 10 * c < 2999 - 1800}
    assert all(r["state"] == "unclaimed" for r in out if r["stale"])
    # one row per card and micro-batch
    ends = {(r[0], k): r[3] for k, batch in enumerate(batches) for r in batch if r[0] >= 0}
    assert sorted(r["event_id"] for r in out if not r["stale"]) == sorted(ends.values())
