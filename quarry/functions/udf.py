"""UDF, UDTF and aggregate surface (ops 126-129).

* Scorers, embedders and checkers are Arrow-batched pandas UDFs (iterator
  form: a model or rule set is set up once per Python worker and fed
  batches of ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows).
* Table functions are Python UDTFs, callable from SQL with ``LATERAL``.
* The aggregates of op 129 are Column expressions built from algebraic
  built-ins (``avg``, ``sum``, ``max``), so Spark aggregates them partially
  per task; no group is handed to Python whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import TOKEN_SPLIT

_SPLIT = regex.compile(TOKEN_SPLIT)


def py_tokens(text: str | None) -> list[str]:
    """Python twin of :func:`quarry.functions.text.tokens`."""
    if text is None:
        return []
    return [t for t in _SPLIT.split(text.lower()) if t]


# ---------------------------------------------------------------- op 126
def overlap_score(query: str, doc: str) -> float:
    """Default pair scorer: shared distinct tokens / sqrt(query tokens) - 3."""
    q, d = set(py_tokens(query)), set(py_tokens(doc))
    if not q:
        return float("nan")
    return len(q & d) / math.sqrt(len(q)) - 3.0


def make_pair_scorer(fn: Callable[[list[str], list[str]], list[float]] | None = None,
                     batch_size: int = 32):
    """Op 126: a pluggable (query, document) scorer as an iterator pandas
    UDF.  ``fn`` receives lists of at most ``batch_size`` queries and
    documents (the model batch) and returns their raw scores; the default
    is the token-overlap scorer."""
    score = fn or (lambda qs, ds: [overlap_score(q, d) for q, d in zip(qs, ds)])

    @F.pandas_udf(T.DoubleType())
    def scorer(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for qs, ds in it:
            out = []
            for i in range(0, len(qs), batch_size):
                out.extend(score(list(qs.iloc[i:i + batch_size]), list(ds.iloc[i:i + batch_size])))
            yield pd.Series(out, dtype="float64")

    return scorer


_BUCKETS: dict[str, tuple[int, float]] = {}  # per Python worker: token -> (dim, sign)
#: Tokens kept there, some 20 MB: the frequent ones come early, others are hashed each time.
BUCKETS_KEPT = 100_000


def _bucket(tok: str, dims: int) -> tuple[int, float]:
    hit = _BUCKETS.get(tok)
    if hit is None:
        h = hashlib.md5(tok.encode("utf-8")).hexdigest()
        hit = (int(h[:8], 16) % dims, 1.0 if int(h[8], 16) % 2 == 0 else -1.0)
        if len(_BUCKETS) < BUCKETS_KEPT:
            _BUCKETS[tok] = hit
    return hit


def hash_embed_batch(texts: list[str], dims: int = 64) -> list[list[float]]:
    """Python twin of :func:`quarry.functions.embed.hash_embed` (same md5
    rule); a token's bucket is hashed once per worker and cached."""
    out = []
    for t in texts:
        toks = py_tokens(t)
        v = np.zeros(dims)
        if toks:
            ds, ss = zip(*(_bucket(x, dims) for x in toks))
            np.add.at(v, np.fromiter(ds, dtype=np.int64, count=len(ds)),
                      np.fromiter(ss, dtype=np.float64, count=len(ss)))
        n = float(np.sqrt((v * v).sum()))
        out.append((v / (n if n else 1.0)).tolist())
    return out


def make_embedder(fn: Callable[[list[str]], list[list[float]]] | None = None, batch_size: int = 32):
    """Op 126: a pluggable text embedder as an iterator pandas UDF returning
    ``array<double>``; the default is the hashing embedder."""
    embed = fn or hash_embed_batch

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embedder(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            out = []
            for i in range(0, len(s), batch_size):
                out.extend(embed(list(s.iloc[i:i + batch_size])))
            yield pd.Series(out)

    return embedder


def register_scorer(spark: SparkSession, name: str, fn=None, batch_size: int = 32):
    """Register a pair scorer for SQL use: ``SELECT name(q, d) ...``."""
    return spark.udf.register(name, make_pair_scorer(fn, batch_size))


def register_embedder(spark: SparkSession, name: str, fn=None, batch_size: int = 32):
    return spark.udf.register(name, make_embedder(fn, batch_size))


# ---------------------------------------------------------------- op 127
CHECK_RESULT = T.StructType([T.StructField("verdict", T.StringType()),
                             T.StructField("rationale", T.StringType())])


def make_checker(fn: Callable[[dict], tuple[str, str]]):
    """Op 127: a rule-based checker over change rows (passed as a struct
    column).  ``fn(row) -> (verdict, rationale)``; a failing rule never
    fails the job - it yields ``ERROR`` with the exception text."""

    @F.pandas_udf(CHECK_RESULT)
    def checker(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            rows = []
            for rec in df.to_dict("records"):
                try:
                    v, r = fn(rec)
                except Exception as e:  # noqa: BLE001  (fallback, by contract)
                    v, r = "ERROR", f"{type(e).__name__}: {e}"
                rows.append((v, r))
            yield pd.DataFrame(rows, columns=["verdict", "rationale"])

    return checker


def register_checker(spark: SparkSession, name: str, fn, weight: float = 1.0,
                     required: bool = False):
    """Register a checker UDF for SQL and return its config row
    ``(name, weight, required)`` for the agent table of op 45."""
    spark.udf.register(name, make_checker(fn))
    return name, weight, required


# ---------------------------------------------------------------- op 128
class ChunkUDTF:
    """``chunk_udtf(text, size)``: one row per chunk of ``size`` word tokens."""

    def eval(self, text: str, size: int):
        toks = py_tokens(text)
        for i, start in enumerate(range(0, len(toks), size)):
            piece = toks[start:start + size]
            yield i, len(piece), " ".join(piece)


class RefsUDTF:
    """``refs_udtf(text, pattern)``: one row per match of the pattern's first
    group (include references, ``${VAR}`` references, links)."""

    def eval(self, text: str, pattern: str):
        if text is None:
            return
        for i, m in enumerate(regex.finditer(pattern, text)):
            yield i, m.group(1)


def register_udtfs(spark: SparkSession) -> None:
    """Register both table functions (Arrow-optimized: rows cross the JVM /
    Python boundary in Arrow batches)."""
    spark.udtf.register("chunk_udtf", F.udtf(ChunkUDTF, returnType="chunk_idx int, n_tokens int, text string",
                                             useArrow=True))
    spark.udtf.register("refs_udtf", F.udtf(RefsUDTF, returnType="pos int, ref string", useArrow=True))


# ---------------------------------------------------------------- op 129
def centroid_agg(vec: str, dims: int) -> Column:
    """Op 129: mean vector as an aggregate expression (``agg(centroid_agg(..))``):
    one partial ``avg`` per dimension, no group collected."""
    return F.array(*[F.avg(F.col(vec)[i].cast("double")) for i in range(dims)])


def ema_agg(pos: str, value: str, total: str, n: int = 1000) -> Column:
    """Op 129: the EMA (alpha = 2/(n+1)) at the last position of a group as an
    aggregate expression over ``(pos, value)``, ``pos`` being the 1-based
    position in the group's order and ``total`` the group's last position
    (a first aggregate, joined back): e = x_1 q^(N-1) + sum_{j>=2} a x_j
    q^(N-j).  A plain sum, so partial per task; no weight exceeds 1, so groups
    of any length work (weights of far rows fade to 0, as in the recursion)."""
    a = 2.0 / (n + 1)
    lq = math.log(1.0 - a)
    p, x = F.col(pos), F.col(value)
    return F.sum(F.when(p == 1, x).otherwise(F.lit(a) * x) * F.exp(lq * (F.col(total) - p)))
