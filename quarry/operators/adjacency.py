"""Adjacency lists of bounded length (ops 100-102).

An edge list is read once and stored as lists ``(a, part, neighbours)``, both
directions.  Repeated edges become one entry with a count.  The list of a node
with more than ``limit`` entries is cut into parts by the hash of the
neighbour, so no row grows with a hub; while parts are built, only the rows of
hubs meet a table of hubs, each hub under ``SALTS`` keys.  A hop sends every
node of the frontier to its parts: keys are (node, part), which spread a hub
over the tasks.

Edges without an end lead nowhere and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.ops import scratch_path

#: Entries of one part of a list (expected; parts are cut by hash).
LIST_ENTRIES = 10_000
#: Keys under which the rows of one hub are dealt while it is cut.
SALTS = 256


class Adjacency:
    """Stored lists ``a, part, parts, degree, neighbours``; ``neighbours``
    holds ``b``, ``kind`` and ``n`` (how often the edge occurs)."""

    def __init__(self, edges: DataFrame, src: str = "src", dst: str = "dst", kind: str | None = "kind",
                 limit: int = LIST_ENTRIES):
        label = F.col(kind) if kind else F.lit(None).cast("string")
        there = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), label.alias("kind")).dropna(subset=["a", "b"])
        both = there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind"))
        entries = both.groupBy("a", "b", "kind").agg(F.count(F.lit(1)).alias("n"))
        path = scratch_path(edges.sparkSession, "adjacency")
        entries.write.parquet(f"{path}/entries")
        entries = edges.sparkSession.read.schema(entries.schema).parquet(f"{path}/entries")
        nodes = entries.groupBy("a").agg(F.sum("n").alias("degree"), F.count(F.lit(1)).alias("entries"))
        nodes = nodes.select("a", "degree", F.ceil(F.col("entries") / limit).cast("int").alias("parts"))
        nodes.write.parquet(f"{path}/nodes")
        self.nodes = edges.sparkSession.read.schema(nodes.schema).parquet(f"{path}/nodes")
        hubs = self.nodes.filter("parts > 1").select(
            "a", "parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        cut = (entries.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
               .join(hubs, ["a", "salt"], "left")
               .withColumn("part", F.pmod(F.hash("b"), F.coalesce("parts", F.lit(1)))))
        lists = cut.groupBy("a", "part").agg(F.collect_list(F.struct("b", "kind", "n")).alias("neighbours"))
        lists.write.parquet(f"{path}/lists")
        self.lists = edges.sparkSession.read.schema(lists.schema).parquet(f"{path}/lists")

    def hop(self, frontier: DataFrame, node: str = "a") -> DataFrame:
        """Every row of ``frontier`` once per neighbour of its node, with the
        neighbour ``b``, the ``kind`` of the edge and how often it occurs."""
        start = frontier.withColumnRenamed(node, "a")
        sent = (start.join(self.nodes.select("a", "parts"), "a")
                .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
        met = sent.join(self.lists, ["a", "part"]).withColumn("_e", F.explode("neighbours"))
        return met.select(F.col("a").alias(node), *[c for c in start.columns if c != "a"],
                          F.col("_e.b").alias("b"), F.col("_e.kind").alias("kind"), F.col("_e.n").alias("n"))
