"""Sort, limit and top-k operators (ops 80-84).

Per-group top-k is always written as ``row_number() <= k``.  Catalyst turns
that into a *partial* ``WindowGroupLimit`` before the exchange and a final
one after it, so every map task forwards at most k rows per group: a hot
group (a third of all rows) never reaches one reducer whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs) -> list:
    if isinstance(xs, (str, Column)):
        return [xs]
    return list(xs)


def top_k(df: DataFrame, by: str | Sequence[str], order: Sequence[Column | str], k: int,
          rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows of each ``by`` group under ``order``.

    ``order`` must end with a unique tie-breaker so results are deterministic.
    """
    w = Window.partitionBy(*_cols(by)).orderBy(*_cols(order))
    return (df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
            .withColumn(rank_col, F.col(rank_col).cast("long")))


def positions(df: DataFrame, order: Sequence[Column | str], name: str = "position",
              by: str | None = None, segment: Column | None = None) -> DataFrame:
    """Dense 1-based positions under ``order`` (within ``by`` groups).

    Never a single-task window: rows are numbered inside ``segment``s (which
    must be monotone in ``order``; by default range partitions sized from the
    count) and shifted by the counts of the earlier segments (see
    ``windows.segmented_running``).
    """
    from quarry.operators.windows import range_segments, seq_index
    d = df if by else df.withColumn("_all", F.lit(0))
    if segment is None:
        d, segment = range_segments(d, [by or "_all", *order]), F.col("_segment")
    out = seq_index(d, by or "_all", list(order), segment, name)
    return out.select(*df.columns, name)


def filtered_page(df: DataFrame, status_col: str, status: str, ts_col: str, id_col: str,
                  limit: int) -> DataFrame:
    """Op 83: rows with one status, newest first, first ``limit`` only.

    ``orderBy().limit()`` plans as ``TakeOrderedAndProject``: a per-partition
    top-n and a final merge of n rows per task.
    """
    return (df.filter(F.col(status_col) == status)
            .orderBy(F.col(ts_col).desc(), F.col(id_col).desc())
            .limit(limit))


def keep_last(df: DataFrame, key: str | None, ts_col: str, id_col: str, n: int) -> DataFrame:
    """Op 84: ring buffer of the last ``n`` rows (per key if given), in order."""
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(
        F.col(ts_col).desc(), F.col(id_col).desc())
    if key is None:
        # A global ring buffer is a global top-n: TakeOrdered, no single-task window.
        return (df.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).limit(n)
                .withColumn("pos", F.lit(None).cast("int")))
    return (df.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n))


def ready_cards(cards: DataFrame, columns: DataFrame) -> DataFrame:
    """Op 82: unclaimed cards whose column is the ready column, by position.

    ``columns`` is tiny (one row per board column); the semi join is planned
    as a broadcast by size statistics.
    """
    ready = columns.filter(F.lower("column_name") == "ready").select("column_id")
    return (cards.filter(F.col("claim_status") == "unclaimed")
            .join(ready, "column_id", "left_semi"))


def rerank(pairs: DataFrame, score_col: str, group_col: str, idx_col: str,
           top_k_n: int | None, required: bool = False) -> DataFrame:
    """Op 80: sigmoid of a raw pair score, descending, stable by input index,
    cut to ``top_k_n`` when it is positive, else all pairs are kept.
    ``required``: no pairs at all is an error (looks for a first row, so a
    caller with a costly plan stores the pairs before)."""
    if required and pairs.isEmpty():
        raise ValueError("nothing to rerank: there are no (query, document) pairs")
    scored = pairs.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(score_col))))
    order = [F.col("score").desc(), F.col(idx_col).asc()]
    if top_k_n and top_k_n > 0:
        return top_k(scored, group_col, order, top_k_n)
    w = Window.partitionBy(group_col).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w))
