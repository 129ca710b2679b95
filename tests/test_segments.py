"""Ordered operators over range segments: one key holds a third of the rows
and more, keys and values are null, rows repeat, segments are a few rows."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import aggs as A
from quarry.operators import sets as X
from quarry.operators import topk as K
from quarry.operators import windows as W


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(23)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "a", "b", None]), rnd.randint(0, 40),
             rnd.choice([None, 1.0, 2.0, 2.5, 7.0]), rnd.randint(2, 4)) for i in range(400)]
    return spark.createDataFrame(rows, "id long, k string, t long, x double, tier int")


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_segments_are_cut_from_counts(table):
    cut = W.range_segments(table, ["k", "id"], 40)
    sizes = [r["n"] for r in cut.groupBy("_segment").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 400 and len(sizes) >= 8 and max(sizes) < 130
    hot = cut.filter("k = 'hot'").groupBy("_segment").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("_segment")
    spans = [(r["lo"], r["hi"]) for r in hot.collect()]
    assert len(spans) > 3 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_running_keeps_null_keys(table):
    cut = W.range_segments(table, ["k", "id"], 40)
    got = W.segmented_running(cut, "k", ["id"], F.col("_segment"), {"s": F.col("t")}, min_of=["s"],
                              largest={"m": F.col("x")})
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = table.select("id", F.sum("t").over(w).alias("s"), F.max("x").over(w).alias("m"))
    assert as_rows(got.select("id", "s", "m")) == as_rows(want)


def test_tier_changes(table):
    w = Window.partitionBy("k").orderBy("id")
    want = table.withColumn("p", F.lag("tier").over(w)).filter("p <> tier").select("id", "k", "tier", "p")
    got = W.tier_changes(table, "k", ["id"], "tier", segment_rows=30)
    assert as_rows(got.select("id", "k", "tier", "prev_tier")) == as_rows(want)


def test_rank_variants(table):
    want = table.select("id", *[F.dense_rank().over(Window.partitionBy("k").orderBy(m)).cast("long") for m in ("x", "t")])
    got = W.rank_variants(table, "k", ["x", "t"], segment_rows=9)
    assert as_rows(got.select("id", "rank_x", "rank_t")) == as_rows(want)


def test_split_by_tokens(table):
    got = {r["id"]: r["split"] for r in X.split_by_tokens(table, "k", ["id"], "t", 200, 300, segment_rows=25).collect()}
    seen, want = defaultdict(int), {}
    for r in sorted(table.collect(), key=lambda r: r["id"]):
        want[r["id"]] = "test" if seen[r["k"]] < 200 else "val" if seen[r["k"]] < 500 else "train"
        seen[r["k"]] += r["t"]
    assert got == want


def test_elite_progress(table):
    got = A.elite_progress(table.filter("k IS NOT NULL"), ["k", "tier"], "x", "t", segment_rows=7)
    best, cells, want = None, set(), []
    rows = [r for r in table.collect() if r["k"] is not None]
    for t in sorted({r["t"] for r in rows}):
        now = [r for r in rows if r["t"] == t]
        here = max((r["x"] for r in now if r["x"] is not None), default=None)
        best = here if best is None else max(best, here if here is not None else best)
        cells |= {(r["k"], r["tier"]) for r in now}
        want.append((t, here, best, len(cells)))
    assert as_rows(got) == sorted(want, key=repr)


def test_positions_without_a_segment(table):
    got = K.positions(table, [F.col("x").desc(), F.col("id")], "p", by="k")
    w = Window.partitionBy("k").orderBy(F.col("x").desc(), F.col("id"))
    want = table.withColumn("p", F.row_number().over(w).cast("long"))
    assert as_rows(got) == as_rows(want)


def test_preference_pairs_hot_length(spark):
    """A third of the items share one length; nulls pair with nothing."""
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["en", "en", None]), 100 if i % 3 == 0 else rnd.choice([None, *range(90, 140)]),
             rnd.choice([True, False, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, n long, good boolean")
    got = {r["chosen_id"]: r["rejected_id"] for r in X.preference_pairs(
        df, "g", "n", "id", F.col("good"), ~F.col("good"), bucket_width=5).collect()}
    bad = [(n, i) for i, g, n, ok in rows if ok is False and g and n is not None]
    want = {i: min((abs(n - m), m, j) for m, j in bad)[2] for i, g, n, ok in rows if ok and g and n is not None}
    assert got == want


def test_rerank_of_nothing_is_an_error(table):
    pairs = table.select("id", "k", F.col("x").alias("raw"))
    assert K.rerank(pairs, "raw", "k", "id", 3, required=True).count() > 0
    with pytest.raises(ValueError, match="nothing to rerank"):
        K.rerank(pairs.limit(0), "raw", "k", "id", 3, required=True)
    assert K.rerank(pairs.limit(0), "raw", "k", "id", 3).count() == 0
