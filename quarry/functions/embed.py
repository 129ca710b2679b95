"""Deterministic hashing embedder (JVM-side, no model weights).

Each word token votes +1 or -1 into one of ``dims`` buckets chosen by the md5
of the token; the vector is L2-normalized.  Built from ``explode`` and a
partial aggregate, so only at most ``dims`` rows per text cross the shuffle.
The same rule is written in SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import l2_normalize
from quarry.functions.text import sql_tokens, tokens

DIMS = 64


def hash_embed(df: DataFrame, id_col: str, text_col: str, dims: int = DIMS,
               out: str = "vector") -> DataFrame:
    """``(id, vector)`` for every row with at least one token."""
    t = df.select(F.col(id_col).alias("_id"), F.explode(tokens(text_col)).alias("_t"))
    h = F.md5("_t")
    t = t.select("_id", F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dims))
                 .cast("int").alias("_d"),
                 F.when(F.pmod(F.conv(F.substring(h, 9, 1), 16, 10).cast("int"), F.lit(2)) == 0,
                        F.lit(1.0)).otherwise(F.lit(-1.0)).alias("_s"))
    g = t.groupBy("_id", "_d").agg(F.sum("_s").alias("_v"))
    g = g.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_d", "_v"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)),
                        lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0)))
    return g.select(F.col("_id").alias(id_col), l2_normalize(dense).alias(out))


def embed_texts(df: DataFrame, id_col: str, text_col: str, embedder=None,
                out: str = "vector") -> DataFrame:
    """``(id, vector)`` through a row-local, Arrow-batched embedder (op 126;
    default: the hashing embedder, same vectors as :func:`hash_embed`).
    No shuffle: each text is embedded where it is read.  Texts without a
    token are skipped, as in :func:`hash_embed`."""
    from quarry.functions.text import tokens as _tokens
    from quarry.functions.udf import make_embedder
    emb = embedder or make_embedder()
    d = df.filter(F.size(_tokens(text_col)) > 0)
    return d.select(F.col(id_col), emb(F.col(text_col)).alias(out))


def sql_hash_embed(table: str, id_col: str, text_col: str, name: str, dims: int = DIMS) -> str:
    """DuckDB CTEs ``<name>(id_col, vector)`` computing :func:`hash_embed`."""
    return f"""{name}_tok AS (
  SELECT {id_col}, unnest({sql_tokens(text_col)}) AS t FROM {table}),
{name}_cell AS (
  SELECT {id_col}, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % {dims} AS INTEGER) AS d,
         sum(CASE WHEN ('0x' || substr(md5(t), 9, 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v
  FROM {name}_tok GROUP BY ALL),
{name}_raw AS (
  SELECT i.{id_col}, list(coalesce(c.v, 0.0) ORDER BY i.d) AS raw
  FROM (SELECT DISTINCT {id_col}, unnest(range(0, {dims})) AS d FROM {name}_cell) i
  LEFT JOIN {name}_cell c USING ({id_col}, d) GROUP BY i.{id_col}),
{name} AS (
  SELECT {id_col}, list_transform(raw, lambda x: x / CASE WHEN nrm = 0 THEN 1.0 ELSE nrm END) AS vector
  FROM (SELECT *, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS nrm FROM {name}_raw))"""
