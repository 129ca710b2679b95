"""Sharding by rendezvous hashing.

Every record key scores every shard: ``-weight / ln(u)`` with u the hash of
key and shard, mapped into (0, 1).  The shard with the highest score takes
the record, so a new shard takes records only into itself and no other moves.
Slots number a shard's records without gaps: the rows are sorted once by
shard and key over ranges of bounded size, and only the row counts of ranges
and shards (a few rows each) are carried on.

Edge cases: a null key is one key; rows that share a key share the shard and
get slots of their own; a null text has 0 bytes and the CRC of the empty
string; other columns pass through, and input columns named like an output
are replaced; an empty table gives an empty result; a shard of weight 0 takes
nothing, and without a shard of positive weight there is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage


def unit_hash(key: Column, shard: int) -> Column:
    """Hash of key and shard in (0, 1), 52 bits of MD5."""
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(shard)))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / float(1 << 52)


def _scores(key: Column, weights: Sequence[float], first: int = 0) -> list[Column]:
    return [F.struct((F.lit(-float(w)) / F.log(unit_hash(key, s))).alias("score"), F.lit(s).alias("shard"))
            for s, w in enumerate(weights) if w > 0 and s >= first]


def _best(scores: list[Column]) -> Column:
    if not scores:
        raise ValueError("no shard has a positive weight")
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key; ``weights[s]`` is the weight of shard s."""
    return _best(_scores(key, weights))["shard"]


def assign_shards(df: DataFrame, key_col: str, weights: Sequence[float], grown: Sequence[float] | None = None,
                  order: Sequence[str] = ()) -> DataFrame:
    """Every row of ``df`` with ``shard``, ``slot`` (0, 1, ... within the
    shard, by key and then ``order``) and ``grown_shard`` (the shard under the
    weights ``grown``; null without)."""
    key, n = F.col("key"), len(weights)
    keep = [c for c in df.columns if c not in ("shard", "slot", "grown_shard")]
    by = [f"order{i}" for i in range(len(order))]
    # the input row travels as one struct, so that no name of it can clash
    rows = df.select(F.struct(*keep).alias("row"), F.col(key_col).alias("key"),
                     *[F.col(c).alias(o) for c, o in zip(order, by)])
    rows = rows.withColumn("best", _best(_scores(key, weights)))
    if grown is None:
        after = F.lit(None)
    elif list(grown[:n]) == list(weights):      # the winner so far against the new shards
        after = _best([F.col("best"), *_scores(key, grown, n)])["shard"]
    else:
        after = rendezvous(key, grown)
    rows = rows.select("row", "key", *by, F.col("best.shard").alias("shard"), after.cast("int").alias("grown"),
                       # the row number parts the rows of one key, so that ranges stay bounded
                       F.monotonically_increasing_id().alias("number"))
    rows = (rows.repartitionByRange("shard", "key", *by, "number")
            .sortWithinPartitions("shard", "key", *by, "number").select("row", "shard", "grown"))
    rows = cut_lineage(rows.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    # one row per range and shard; a range that crosses shards has several
    counts = rows.groupBy("shard", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return (rows.withColumn("part", part).join(F.broadcast(counts), ["shard", "part"])
            .select("row", F.struct("shard", F.col("grown").alias("grown_shard"),
                                    (F.col("before") + F.col("at") - F.col("first")).alias("slot")).alias("new"))
            .select("row.*", "new.*"))
