"""Sources, sinks and state merges (ops 2-12)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.schemas import LOG_LINE
from quarry.session import ensure_checkpoint_dir

LOG_KEYS = [f.name for f in LOG_LINE.fields]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a
    machine-local temp folder): safe for every executor to write."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-io/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- op 2
def parse_json_logs(df: DataFrame, col: str) -> DataFrame:
    """Op 2: one JSON object per line -> ts, level, logger, msg, exc plus the
    remaining keys as a sorted ``key=value`` list; ``ok`` is false for lines
    that are not a JSON object (kept, with NULL fields)."""
    m = F.from_json(F.col(col), T.MapType(T.StringType(), T.StringType()),
                    {"mode": "PERMISSIVE"})
    s = F.from_json(F.col(col), LOG_LINE, {"mode": "PERMISSIVE"})
    out = df.withColumn("_m", m).withColumn("_s", s)
    extra = F.map_filter("_m", lambda k, v: ~k.isin(*LOG_KEYS))
    return out.select(
        *[c for c in df.columns if c != col], F.col("_m").isNotNull().alias("ok"),
        *[F.when(F.col("_m").isNotNull(), F.col(f"_s.{k}")).alias(k) for k in LOG_KEYS],
        F.when(F.col("_m").isNotNull(), F.array_sort(F.transform(
            F.map_entries(extra), lambda e: F.concat(e["key"], F.lit("="), e["value"]))))
        .alias("extras"))


# ---------------------------------------------------------------- op 3
def flatten_json_shapes(df: DataFrame, col: str) -> DataFrame:
    """Op 3: a body that is a JSON array, a single object or an ``{error}``
    object -> one row per object with its position and a status."""
    mt = T.MapType(T.StringType(), T.StringType())
    arr = F.from_json(F.col(col), T.ArrayType(mt), {"mode": "PERMISSIVE"})
    one = F.from_json(F.col(col), mt, {"mode": "PERMISSIVE"})
    objs = F.when(F.trim(F.col(col)).startswith("["), arr).otherwise(
        F.when(one.isNotNull(), F.array(one)))
    ex = df.select(*[c for c in df.columns if c != col],
                   F.posexplode_outer(objs).alias("pos", "_o"))
    status = (F.when(F.col("_o").isNull(), F.lit("invalid"))
              .when(F.element_at("_o", F.lit("error")).isNotNull(), F.lit("error"))
              .otherwise(F.lit("ok")))
    return ex.select(*[c for c in df.columns if c != col], "pos", status.alias("status"),
                     F.element_at("_o", F.lit("error")).alias("error"), F.col("_o").alias("object"))


# ---------------------------------------------------------------- op 4
def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet") -> str:
    """Op 4 (sink): key-prefixed objects, one folder per key value."""
    df.write.mode("overwrite").partitionBy(*keys).format(fmt).save(path)
    return path


def read_blobs(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Op 4 (source): every object under ``root`` as ``path, prefix, length,
    content`` (``binaryFile``; the prefix is the first folder below root)."""
    b = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
         .option("pathGlobFilter", glob).load(root))
    rel = F.regexp_replace(F.col("path"), r"^.*?" + root.rstrip("/").split("://")[-1] + "/", "")
    return b.select("path", F.split(rel, "/")[0].alias("prefix"), "length", "content")


# ---------------------------------------------------------------- ops 5, 6
STICKY_STATUS = ("draining", "maintenance", "banned")


def upsert_latest(state: DataFrame, updates: DataFrame, key: str, ts: str,
                  cols: Sequence[str], status: str = "status",
                  sticky: Sequence[str] = STICKY_STATUS, blank_null: Sequence[str] = ()) -> DataFrame:
    """Op 5: ``INSERT ... ON CONFLICT DO UPDATE``: the latest update per key
    wins, except that a current status in ``sticky`` is kept; in the columns
    ``blank_null`` an update's empty string is stored as NULL.  Latest-per-key
    is a partial ``max_by`` aggregate."""
    last = updates.groupBy(key).agg(
        F.max_by(F.struct(ts, *cols), F.struct(ts, *cols)).alias("_u")).select(
        key, *[F.col(f"_u.{c}").alias(f"_n_{c}") for c in [ts, *cols]])
    for c in blank_null:
        last = last.withColumn(f"_n_{c}", F.nullif(f"_n_{c}", F.lit("")))
    cur = state.select(key, *[F.col(c).alias(f"_c_{c}") for c in [ts, *cols]])
    j = cur.join(last, key, "full")
    out = [key]
    for c in [ts, *cols]:
        newer = F.col(f"_n_{ts}").isNotNull()
        v = F.when(newer, F.col(f"_n_{c}")).otherwise(F.col(f"_c_{c}"))
        if c == status:
            v = F.when(F.col(f"_c_{c}").isin(*sticky), F.col(f"_c_{c}")).otherwise(v)
        out.append(v.alias(c))
    return j.select(*out)


def apply_heartbeats(state: DataFrame, beats: DataFrame, key: str, ts: str,
                     metrics: Sequence[str], kind: str = "kind") -> DataFrame:
    """Op 6: the latest beat of each known key sets the measurements (NaN ->
    NULL) and never the status; an event of kind ``offline`` sets the status
    and leaves the measurements; either moves ``last_seen``.  Beats at one
    instant are ordered by their measurements.  Unknown keys are ignored."""
    off = F.col(kind) == "offline"
    m = F.struct(*metrics)
    last = beats.groupBy(key).agg(
        F.max(ts).alias("_seen"), F.bool_or(off).alias("_off"),
        F.max_by(m, F.when(~off, F.struct(ts, *metrics))).alias("_b"))
    out = state.join(last, key, "left")
    for c in metrics:
        v = F.col(f"_b.{c}")
        kept = F.col(c) if c in state.columns else F.lit(None).cast("double")
        out = out.withColumn(c, F.when(F.col("_b").isNull(), kept)
                             .otherwise(F.when(F.isnan(v), F.lit(None)).otherwise(v)))
    out = out.withColumn("last_seen", F.coalesce("_seen", "last_seen"))
    out = out.withColumn("status", F.when(F.col("_off"), F.lit("offline")).otherwise(F.col("status")))
    return out.drop("_b", "_seen", "_off")


# ---------------------------------------------------------------- op 7
def import_idempotent(target: DataFrame, incoming: DataFrame, key: str,
                      force: bool = False) -> DataFrame:
    """Op 7: import runs by key: keys already present are skipped, or with
    ``force`` the incoming rows replace them."""
    if force:
        return target.join(incoming.select(key), key, "left_anti").unionByName(incoming)
    return target.unionByName(incoming.join(target.select(key), key, "left_anti"))


# ---------------------------------------------------------------- op 8
def write_manifest(docs: DataFrame, split: str, tokens_col: str, path: str | None = None) -> DataFrame:
    """Op 8: per split the document count, token count and vocabulary size
    (distinct tokens); written as JSON next to the data when ``path`` is
    given.  The vocabulary count is a two-level partial aggregate."""
    ex = docs.select(split, F.explode(tokens_col).alias("_t"))
    vocab = ex.groupBy(split).agg(F.count_distinct("_t").alias("vocab_size"))
    tot = docs.groupBy(split).agg(F.count(F.lit(1)).alias("n_docs"),
                                  F.sum(F.size(tokens_col)).cast("long").alias("tokens"))
    m = tot.join(vocab, split, "left").fillna(0, ["vocab_size"])
    if path:
        m.coalesce(1).write.mode("overwrite").json(path)
    return m


# ---------------------------------------------------------------- op 10
def chunked_backfill(events: DataFrame, height: str, step: int) -> DataFrame:
    """Op 10: split [min, max] of the height into windows of ``step`` and
    attach every event to its window (equi-join on the window index; the
    windows come from ``sequence`` over the range, so empty windows stay)."""
    b = events.agg(F.min(height).alias("_lo"), F.max(height).alias("_hi"))
    wins = b.select("_lo", F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.lit(step)))
                    .alias("window_start"))
    wins = wins.select(((F.col("window_start") - F.col("_lo")) / step).cast("long").alias("_w"),
                       "window_start", (F.col("window_start") + step - 1).alias("window_end"))
    lo = b.select("_lo").scalar()
    e = events.withColumn("_w", ((F.col(height) - lo) / step).cast("long"))
    agg = e.groupBy("_w").agg(F.count(F.lit(1)).alias("n_events"),
                              F.min(height).alias("first_height"), F.max(height).alias("last_height"))
    return wins.join(agg, "_w", "left").fillna(0, ["n_events"]).drop("_w")


# ---------------------------------------------------------------- ops 11, 12
def diff_snapshots(src: DataFrame, dst: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Op 11: mirror-with-delete plan: add (only in src), delete (only in
    dst), update (fingerprints differ), same."""
    s = src.select(key, F.col(fingerprint).alias("_fs"))
    d = dst.select(key, F.col(fingerprint).alias("_fd"))
    j = s.join(d, key, "full")
    act = (F.when(F.col("_fd").isNull(), F.lit("add")).when(F.col("_fs").isNull(), F.lit("delete"))
           .when(F.col("_fs") != F.col("_fd"), F.lit("update")).otherwise(F.lit("same")))
    return j.select(key, act.alias("action"))


def copy_parity(src: DataFrame, dst: DataFrame, prefix: str, size: str) -> DataFrame:
    """Op 12: per prefix the object count and bytes on both sides and the
    parity flag (null-safe equality of both)."""
    a = src.groupBy(prefix).agg(F.count(F.lit(1)).alias("n_src"), F.sum(size).alias("bytes_src"))
    b = dst.groupBy(prefix).agg(F.count(F.lit(1)).alias("n_dst"), F.sum(size).alias("bytes_dst"))
    j = a.join(b, prefix, "full")
    return j.withColumn("parity", F.col("n_src").eqNullSafe(F.col("n_dst"))
                        & F.col("bytes_src").eqNullSafe(F.col("bytes_dst")))


def folder_exists(path: str) -> bool:
    return os.path.exists(path.split("://")[-1])
