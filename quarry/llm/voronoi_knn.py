"""Exact top-k inner products by a Voronoi kNN join.

Inner products become distances: with M the largest norm, every data vector x
gets the further component sqrt(M**2 - |x|**2) and every query a zero there, so
``distance(q, x)**2 = |q|**2 + M**2 - 2 * q.x`` and the nearest vectors are
those with the largest products.

Pivots (a hashed sample of at most ``pivots`` vectors) cut the space into
Voronoi cells.  Summaries of the cells - the farthest query, the k + 1 data
vectors nearest to the pivot - bound for each cell's queries how far their
k-th neighbour can lie.  Cells next to each other are merged into query groups
of about ``group_rows`` rows, larger cells are split.  The bound of a group
gives a ring around every pivot; a data vector is replicated to a group only
if its distance to its own pivot lies in that ring (triangle inequality), and
each group is solved locally by exact integer products, a block of data at a
time.  Pivots only steer the pruning: results are exact with any of them.

The driver sees the pivots and one summary per cell, both bounded by the
parameter ``pivots``.  A (group, part) pair holds about ``group_rows`` queries
and ``part_rows`` vectors whatever the data: equal vectors, however many, are
dealt over the parts of their group.

Edge cases: rows whose vector is null or holds null or non-finite components
take no part; vectors of different lengths are compared as if the shorter
ended in zeros (an empty one is all zeros); a row with a null id is a
candidate, never a query, and comes last among equal scores; rows that share
an id are rows of their own, so a repeated query gets its results once per row
and finds its twins; fewer candidates than k give fewer ranks; an empty table
gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.int_vectors import int_vectors, matrix, pack, unpack
from quarry.llm.stored import stored

PIVOTS = 128
GROUP_ROWS = 1024
PART_ROWS = 8192
PACK_ROWS = 4096
_EXACT = float(1 << 53)
_LAST = np.iinfo(np.int64).max          # stands for a null id when ids are ordered

_ASSIGNED = ("uid long, id long, query boolean, x array<long>, cell int, dist double, "
             "query_cell int, query_dist double")
_PACK = "group long, part int, n int, kind string, uids binary, ids binary, known binary, x binary"


def _norm2(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    return np.einsum("ij,ij->i", y, y)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; the longer rows' ends count as zero."""
    w = min(q.shape[1], x.shape[1])
    q, x = q[:, :w], x[:, :w]
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), dtype=np.int64)
    bound = np.sqrt(_norm2(q).max() * _norm2(x).max())
    if bound < _EXACT:                  # every partial sum is an integer below 2**53
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if bound >= float(1 << 62):
        raise OverflowError("an inner product leaves the range of a long")
    return q.astype(np.int64) @ x.astype(np.int64).T


class Pivots:
    """The pivots with the geometry of the lifted space."""

    def __init__(self, vectors: list[list[int]], largest2: float):
        width = max(map(len, vectors))
        self.p = np.zeros((len(vectors), width))
        for row, v in zip(self.p, vectors):
            row[:len(v)] = v
        self.largest2 = largest2
        self.n2 = np.einsum("ij,ij->i", self.p, self.p)
        self.lift = np.sqrt(np.maximum(largest2 - self.n2, 0))
        #: more than rounding can move a distance
        self.slack = 1e-6 * (1 + np.sqrt(largest2))

    def _dot(self, x: np.ndarray) -> np.ndarray:
        w = min(x.shape[1], self.p.shape[1])
        return x[:, :w].astype(np.float64) @ self.p[:, :w].T

    def _nearest(self, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.argmin(d2, axis=1)
        return cell.astype(np.int32), np.sqrt(np.maximum(d2[np.arange(len(d2)), cell], 0))

    def data(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n2 = _norm2(x)
        lift = np.sqrt(np.maximum(self.largest2 - n2, 0))
        d2 = n2[:, None] + self.n2[None, :] - 2 * self._dot(x) + (lift[:, None] - self.lift[None, :]) ** 2
        return self._nearest(d2)

    def queries(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._nearest(_norm2(x)[:, None] + self.largest2 - 2 * self._dot(x))

    def between(self) -> np.ndarray:
        d2 = (self.n2[:, None] + self.n2[None, :] - 2 * self.p @ self.p.T
              + (self.lift[:, None] - self.lift[None, :]) ** 2)
        return np.sqrt(np.maximum(d2, 0))


class Groups:
    """Query groups over the cells, and the ring around each pivot from which
    a group needs data."""

    def __init__(self, pivots: Pivots, queries: dict[int, tuple[int, float]], nearest: dict[int, list[float]],
                 k: int, group_rows: int):
        between, n = pivots.between(), len(pivots.p)
        low, high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
        for i, (_, far) in queries.items():
            # one of the k + 1 nearest candidates may be the query itself
            bound = np.sort(np.concatenate([far + between[i, j] + np.array(d) for j, d in nearest.items()]))
            reach = far + (bound[k] if len(bound) > k else np.inf) + pivots.slack
            low[i], high[i] = between[i] - reach, between[i] + reach
        self.base, self.parts = [0] * n, [1] * n
        members: list[list[int]] = []
        room = 0
        for i in self._chain(between, sorted(queries)):
            count = queries[i][0]
            if count > group_rows:
                self.parts[i] = -(-count // group_rows)
                self.base[i] = len(members)
                members += [[i]] * self.parts[i]
                room = 0
                continue
            if count > room:
                members.append([])
                room = group_rows
            members[-1].append(i)
            self.base[i] = len(members) - 1
            room -= count
        # groups that are parts of one cell have one ring
        rings: dict[tuple[int, ...], list[int]] = {}
        for g, cells in enumerate(members):
            rings.setdefault(tuple(cells), []).append(g)
        self.rings = [(low[list(c)].min(axis=0), high[list(c)].max(axis=0), gs) for c, gs in rings.items()]

    @staticmethod
    def _chain(between: np.ndarray, cells: list[int]) -> list[int]:
        """The cells in an order that goes to the nearest pivot next."""
        left, out = list(cells), []
        while left:
            out.append(min(left, key=lambda c: between[out[-1], c]) if out else left[0])
            left.remove(out[-1])
        return out


def _packed(group: int, part: int, uid: np.ndarray, ids: np.ndarray, known: np.ndarray, x: np.ndarray) -> tuple:
    """One row of the packs' schema, ordered by id (nulls last)."""
    o = np.argsort(np.where(known, ids, _LAST), kind="stable")
    kind, raw = pack(x[o])
    return (group, part, len(o), kind, uid[o].tobytes(), ids[o].tobytes(), known[o].tobytes(), raw)


def _pack_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = [c.split(" ")[0] for c in _PACK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _arrays(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = batch.column("id")
    known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array)
                       else ids.is_valid().to_numpy(), dtype=bool)
    number = np.asarray(ids.fill_null(0).to_numpy(), dtype=np.int64)
    return np.asarray(batch.column("uid").to_numpy(), dtype=np.int64), number, known, matrix(batch.column("x"))


def local_top(q_uid: np.ndarray, q: np.ndarray, uid: np.ndarray, x: np.ndarray, k: int,
              step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, data row and product of the k largest products of every
    query, its own row left out; of equal products the earlier data rows."""
    rows, cols, scores = [], [], []
    own = np.argsort(uid)
    least = np.iinfo(np.int64).min
    for a in range(0, len(q), step):
        s = products(q[a:a + step], x)
        at = np.minimum(np.searchsorted(uid, q_uid[a:a + step], sorter=own), len(uid) - 1)
        me = np.flatnonzero(uid[own[at]] == q_uid[a:a + step])
        s[me, own[at[me]]] = least
        m = min(k, s.shape[1])
        kth = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m][:, None]
        above, equal = s > kth, s == kth
        room = m - above.sum(axis=1, keepdims=True)
        take = (above | (equal & (np.cumsum(equal, axis=1) <= room))) & (s > least)
        r, c = np.nonzero(take)
        rows.append(r + a)
        cols.append(c)
        scores.append(s[r, c])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def voronoi_topk(vectors: DataFrame, id_col: str, vec_col: str, k: int, is_query: Callable[[Column], Column],
                 pivots: int = PIVOTS, group_rows: int = GROUP_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (int, from 1), ``vec_id`` and ``score`` (long) of
    the k vectors with the largest integer inner product for every query row:
    the rows for whose id ``is_query`` holds.  Ties go to the smaller id."""
    rows = int_vectors(vectors, id_col, vec_col)
    norm2 = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    # written once, so that the row numbers stay as they are
    rows = stored(rows.select(F.monotonically_increasing_id().alias("uid"), "id",
                              F.coalesce(is_query(F.col("id")), F.lit(False)).alias("query"), "x",
                              norm2.alias("norm2")), "voronoi-rows")
    total = rows.agg(F.count("*").alias("n"), F.max("norm2").alias("m")).first()
    sample = rows.orderBy(F.xxhash64("uid"), "uid").limit(pivots).select("x").collect()
    piv = Pivots([r["x"] for r in sample] or [[0]], total["m"] or 0.0)

    def assign(batches):
        for b in batches:
            x = matrix(b.column("x"))
            cell, dist = piv.data(x)
            query_cell, query_dist = piv.queries(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("uid", "id", "query", "x")]
                + [pa.array(cell, pa.int32()), pa.array(dist), pa.array(query_cell, pa.int32()), pa.array(query_dist)],
                names=["uid", "id", "query", "x", "cell", "dist", "query_cell", "query_dist"])

    rows = stored(rows.select("uid", "id", "query", "x").mapInArrow(assign, _ASSIGNED), "voronoi-cells")
    queries = rows.filter("query")
    summary = queries.groupBy("query_cell").agg(F.count("*").alias("n"), F.max("query_dist").alias("far")).collect()
    near = Window.partitionBy("cell").orderBy("dist")
    near = (rows.select("cell", "dist").withColumn("at", F.row_number().over(near)).filter(F.col("at") <= k + 1)
            .groupBy("cell").agg(F.collect_list("dist").alias("d")).collect())
    groups = Groups(piv, {r["query_cell"]: (r["n"], r["far"]) for r in summary},
                    {r["cell"]: r["d"] for r in near}, k, group_rows)
    parts = max(1, -(-total["n"] // part_rows))

    base, split = (F.array(*[F.lit(int(v)) for v in values])[F.col("query_cell")]
                   for values in (groups.base, groups.parts))
    grouped = queries.select((base + F.pmod(F.xxhash64("uid"), split)).cast("long").alias("group"), "uid", "id", "x")

    def gather(key, table):
        uid, ids, known, x = _arrays(table)
        return pa.Table.from_batches([_pack_batch([_packed(key[0].as_py(), 0, uid, ids, known, x)])])

    asked = (grouped.groupBy("group").applyInArrow(gather, _PACK)
             .select("group", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
                     *[F.col(c).alias(f"q_{c}") for c in ("n", "kind", "uids", "ids", "x")]))

    def replicate(batches):
        for b in batches:
            uid, ids, known, x = _arrays(b)
            cell = np.asarray(b.column("cell").to_numpy())
            dist = np.asarray(b.column("dist").to_numpy())
            for low, high, members in groups.rings:
                need = np.flatnonzero((dist >= low[cell] - piv.slack) & (dist <= high[cell] + piv.slack))
                for a in range(0, len(need), PACK_ROWS):
                    at = need[a:a + PACK_ROWS]
                    # a pack goes to the part that its first row names
                    part = int((int(uid[at[0]]) * 0x9E3779B97F4A7C15 % (1 << 64) >> 32) % parts)
                    one = _packed(0, part, uid[at], ids[at], known[at], x[at])
                    for g in members:
                        yield _pack_batch([(g, *one[1:])])

    packs = rows.select("uid", "id", "cell", "dist", "x").mapInArrow(replicate, _PACK)

    def solve(batches):
        for b in batches:
            for r in b.to_pylist():
                q_uid, q_id = (np.frombuffer(r[c], dtype=np.int64) for c in ("q_uids", "q_ids"))
                uid, ids = (np.frombuffer(r[c], dtype=np.int64) for c in ("uids", "ids"))
                known = np.frombuffer(r["known"], dtype=bool)
                i, j, score = local_top(q_uid, unpack(r["q_kind"], r["q_x"], r["q_n"]),
                                        uid, unpack(r["kind"], r["x"], r["n"]), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_uid[i]), pa.array(q_id[i]), pa.array(ids[j], mask=~known[j]), pa.array(score)],
                    names=["uid", "query_id", "vec_id", "score"])

    found = packs.join(asked, ["group", "part"]).mapInArrow(
        solve, "uid long, query_id long, vec_id long, score long")
    best = Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
