"""Streams with keyed state and their own timers (ops 119, 121, 122).

Each operator is a ``StatefulProcessor`` run by ``transformWithStateInPandas``
(RocksDB state, event-time timers).  Rows of a key that come in several Arrow
chunks of a micro-batch are handled together, in time order.  Rows older than
the watermark are dropped by Spark before they reach the state and counted in
the query's progress (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.streaming.ops import KEY_BUCKETS, key_bucket

#: Blocks whose events share a state row, and the parts of a crowded block.
BLOCKS_PER_KEY = 512
PARTS = 8


def _all(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True)


def _millis(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[ms]").astype("int64")


class _Value:
    """A value state of one row."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: str):
        self.state = handle.getValueState(name, schema)

    def get(self) -> tuple | None:
        return self.state.get() if self.state.exists() else None

    def set(self, *value) -> None:
        self.state.update(value)

    def clear(self) -> None:
        self.state.clear()


# ---------------------------------------------------------------- op 119
class _Confirmations(StatefulProcessor):
    """Events of a range of blocks: the waiting ones, and the ids seen."""

    def __init__(self, late_ms: int, offset_ms: int):
        self.late_ms, self.offset_ms = late_ms, offset_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = _Value(handle, "waiting", "heights array<long>, ids array<long>")
        self.seen = _Value(handle, "seen", "ids array<long>")

    def _emit(self, heights: list[int], ids: list[int], mark: int, late: bool):
        """What lies at or below the mark goes out, the rest waits on."""
        out = [(h, i) for h, i in zip(heights, ids) if h <= mark]
        rest = [(h, i) for h, i in zip(heights, ids) if h > mark]
        if rest:
            self.waiting.set([h for h, _ in rest], [i for _, i in rest])
            self.handle.registerTimer(self._due(min(h for h, _ in rest)))
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame({"event_id": [i for _, i in out], "height": [h for h, _ in out], "late": late})

    def _due(self, height: int) -> int:
        """The watermark at which a block is confirmed."""
        return height * 1000 + self.offset_ms - self.late_ms

    def _mark(self, timers) -> int:
        return (timers.getCurrentWatermarkInMs() - self.offset_ms + self.late_ms) // 1000

    def handleInputRows(self, key, rows, timerValues):
        new = _all(rows).drop_duplicates("event_id")
        seen = self.seen.get()
        known = set(seen[0]) if seen else set()
        new = new[~new["event_id"].isin(known)]
        if not len(new):
            return
        known.update(new["event_id"].tolist())
        self.seen.set(sorted(known))
        # nothing older is let in from here on, and the ids can go
        self.handle.registerTimer((int(key[0]) + 1) * BLOCKS_PER_KEY * 1000 + self.offset_ms)
        mark = self._mark(timerValues)
        below = new["height"] <= mark if timerValues.getCurrentWatermarkInMs() > 0 else new["height"] != new["height"]
        if below.any():
            yield new[below][["event_id", "height"]].assign(late=True)
        waiting = self.waiting.get()
        above = new[~below]
        if len(above):
            self.waiting.set([*(waiting[0] if waiting else []), *above["height"].tolist()],
                             [*(waiting[1] if waiting else []), *above["event_id"].tolist()])
            self.handle.registerTimer(self._due(int(above["height"].min())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        waiting = self.waiting.get()
        if waiting:
            yield from self._emit(*waiting, self._mark(timerValues), False)
        if timerValues.getCurrentWatermarkInMs() >= (int(key[0]) + 1) * BLOCKS_PER_KEY * 1000 + self.offset_ms:
            self.seen.clear()

    def close(self) -> None:
        pass


def confirmed(stream: DataFrame, event: str, height: str, depth: int = 10, late: int = 1_000_000) -> DataFrame:
    """Op 119: every event once, when its block lies at least ``depth`` blocks
    below the highest seen.  An event that arrives when its block is
    confirmed already comes out at once, marked ``late``, if it is at most
    ``late`` blocks below the confirmed height; replays of an event are
    ignored.

    Blocks are event time (a second each), shifted so that the watermark,
    highest block less ``depth + late``, tells the confirmed height without
    dropping late events.  State: the ids of the last ``late`` blocks, in keys
    of ``BLOCKS_PER_KEY`` blocks, a crowded block over ``PARTS`` keys.
    Output ``event_id, height, late``."""
    offset = depth + late
    s = stream.select(F.col(event).cast("long").alias("event_id"), F.col(height).cast("long").alias("height"))
    s = s.withColumn("at", F.timestamp_seconds(F.col("height") + offset)).withWatermark("at", f"{offset} seconds")
    s = s.withColumn("range", F.floor(F.col("height") / BLOCKS_PER_KEY)).withColumn(
        "part", F.pmod(F.xxhash64("event_id"), F.lit(PARTS)))
    return s.groupBy("range", "part").transformWithStateInPandas(
        _Confirmations(late * 1000, offset * 1000), "event_id long, height long, late boolean", "append", "eventTime")


# ---------------------------------------------------------------- op 122
class _FirstClaim(StatefulProcessor):
    """Of one card: the claims that wait for a decision, then the winner."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, user_id long, at long")
        self.winner = _Value(handle, "winner", "event_id long")

    def handleInputRows(self, key, rows, timerValues):
        new = _all(rows)
        new = new.assign(at=_millis(new["ts"]))
        if self.winner.get():
            yield self._rows(key, new, None)
            return
        if not self.waiting.exists():
            first = None
        else:
            first = min(t for *_, t in self.waiting.get())
        self.waiting.appendList(list(new[["event_id", "user_id", "at"]].itertuples(index=False, name=None)))
        least = int(new["at"].min())
        if first is None or least < first:
            if first is not None:
                self.handle.deleteTimer(first)
            # once the watermark is past the earliest claim, no earlier one comes
            self.handle.registerTimer(max(least, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.winner.get() or not self.waiting.exists():
            return
        claims = pd.DataFrame(list(map(tuple, self.waiting.get())), columns=["event_id", "user_id", "at"])
        first = int(claims.sort_values(["at", "event_id"])["event_id"].iloc[0])
        self.winner.set(first)
        self.waiting.clear()
        yield self._rows(key, claims, first)

    @staticmethod
    def _rows(key, claims: pd.DataFrame, winner: int | None) -> pd.DataFrame:
        won = claims["event_id"] == winner if winner is not None else pd.Series(False, index=claims.index)
        return pd.DataFrame({"event_id": claims["event_id"], "card": int(key[0]), "user_id": claims["user_id"],
                             "outcome": won.map({True: "claim", False: "conflict"})})

    def close(self) -> None:
        pass


def claims(stream: DataFrame, card: str, ts: str, event: str, user: str, delay: str = "1 second") -> DataFrame:
    """Op 122 as a stream: per card the earliest claim (ties by event id) gets
    it.  Claims wait until the watermark has passed the earliest of them;
    from then on every further claim is a conflict as it arrives, whatever
    the number of claims.  Output ``event_id, card, user_id, outcome``."""
    s = stream.select(F.col(event).cast("long").alias("event_id"), F.col(card).cast("long").alias("card"),
                      F.col(user).cast("long").alias("user_id"), F.col(ts).alias("ts")).withWatermark("ts", delay)
    return s.groupBy("card").transformWithStateInPandas(
        _FirstClaim(), "event_id long, card long, user_id long, outcome string", "append", "eventTime")


# ---------------------------------------------------------------- op 121
class _StaleClaims(StatefulProcessor):
    """Of a bucket of cards: the state of each, since when, and its timer while
    it is claimed.  Spark's timer is the earliest of them."""

    def __init__(self, age_s: int):
        self.age_s = age_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = _Value(handle, "now", "card array<long>, state array<string>, at array<long>, "
                                         "event_id array<long>, timer array<long>, armed long")

    def _held(self) -> tuple[dict, int]:
        """Cards with their (state, at, event, timer), and Spark's timer."""
        old = self.now.get()
        return (dict(zip(old[0], zip(*old[1:5]))), old[5]) if old else ({}, 0)

    def _store(self, held: dict, armed: int) -> None:
        first = min((x[3] for x in held.values() if x[3]), default=0)
        if first != armed:
            if armed:
                self.handle.deleteTimer(armed)
            if first:
                self.handle.registerTimer(first)
        self.now.set(list(held), *map(list, zip(*held.values())), first)

    def handleInputRows(self, key, rows, timerValues):
        new = _all(rows)
        new = new.assign(card=new["card"].fillna(0).astype("int64"), at=_millis(new["ts"])).sort_values(
            ["ts", "event_id"], kind="mergesort").drop_duplicates("card", keep="last")
        held, armed = self._held()
        soon, out = timerValues.getCurrentWatermarkInMs() + 1, []
        for card, state, at, event in zip(*(new[c].tolist() for c in ("card", "state", "at", "event_id"))):
            old = held.get(card)
            if old and (old[1], old[2]) > (at, event):      # late, but within the delay
                continue
            # older than the age in whole seconds
            timer = max((at // 1000 + self.age_s + 1) * 1000, soon) if state == "claimed" else 0
            held[card] = (state, at, event, timer)
            out.append((card, state, at, event))
        self._store(held, armed)
        if out:
            yield self._rows(key, out, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, armed = self._held()
        wm, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        due = [c for c, x in held.items() if x[3] and (x[3] < wm or x[3] <= fired)]
        for c in due:
            held[c] = ("unclaimed", *held[c][1:3], 0)
        # Spark removes the timer that fired
        self._store(held, 0 if armed == fired else armed)
        if due:
            yield self._rows(key, [(c, *held[c][:3]) for c in due], True)

    @staticmethod
    def _rows(key, rows: list[tuple], stale: bool) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["card", "state", "ts", "event_id"])
        card = pd.Series([None] * len(out), dtype="Int64") if key[0] < 0 else out["card"]
        return out.assign(card=card, ts=pd.to_datetime(out["ts"], unit="ms"), stale=stale)

    def close(self) -> None:
        pass


def stale_cards(stream: DataFrame, card: str, state: str, ts: str, event: str, age_s: int,
                delay: str = "1 second", buckets: int = KEY_BUCKETS) -> DataFrame:
    """Op 121 as a stream: the state of a card after each micro-batch that
    touches it, and a row back to ``unclaimed`` when the watermark shows that
    a claim is older than ``age_s``.  Output ``card, state, ts, event_id,
    stale``; the latest row of a card by ``(ts, event_id, stale)`` is its state."""
    s = stream.select(F.col(card).cast("long").alias("card"), F.col(state).alias("state"), F.col(ts).alias("ts"),
                      F.col(event).cast("long").alias("event_id")).withWatermark("ts", delay)
    return s.withColumn("_bucket", key_bucket("card", buckets)).groupBy("_bucket").transformWithStateInPandas(
        _StaleClaims(age_s), "card long, state string, ts timestamp, event_id long, stale boolean", "append",
        "eventTime")
