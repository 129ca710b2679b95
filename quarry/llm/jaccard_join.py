"""N-gram Jaccard self-join over count vectors, and its groups.

A document's set holds the hashes of its distinct word shingles.  Hashing the
shingles into ``GROUPS`` groups makes it a point of group counts, and
``sum(min(a_g, b_g))`` bounds the overlap of two sets from above.  Two sets
with ``100 * overlap >= 80 * union`` overlap by at least 4/9 of the sum of
their sizes, so pairs whose bound stays below are never verified.

The points are packed into leaves of at most ``LEAF`` documents; a leaf's
box holds the coordinate maxima and the least size, and a pair of leaves is
opened only where the bound of the boxes allows a link.  A single tree over
all points cannot route in this space (the ball of a link covers nearly every
box of its size band), so leaves are packed per *routing key*: each set emits
the first shingles of one global order.  If two sets link, at most a fifth of
either lies outside the other; in an order that does not depend on the
content, the chance that the first k of a set of n all lie there is below
``(0.2)^k``.  Every set emits the fewest keys (18 for a large set) that bring
this below ``MISS``, or all that the exact prefix rule asks for, whichever is
less.  The order puts shingles of crowded hash groups (passages and lines
that many documents share) last, and the number of keys accounts for them.

Copies are merged first: sets with one digest are one class.  Links between
classes are looked for in rounds, so that a group of thousands of near copies
needs no pairs within it: (1) every class against one other, the least that
the bound lets link among the least classes of its keys, (2) against a class
drawn for each of its keys, (3) all opened pairs of leaves, each round only
between classes that are not connected yet.  After round 3 every pair that
links is connected.

Edge cases: a null or empty text has an empty set and links with nothing; a
null id links with nothing and has a null component; rows that share an id
are one node; repeated rows and equal sets are connected; only the id and the
text are read, so other columns do not matter; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.stored import stored
from quarry.llm.textscan import (NOT_SPACE, Texts, field, map_slices, mix, ngrams, row_of, text_slices)
from quarry.llm.vectors import sum_vectors
from quarry.operators.clustering import connected_components

SHINGLE = 5
PERCENT = 80
GROUPS = 64
LEAF = 64
MISS = 1e-12
#: Hash groups whose counts tell crowded shingles; the table is 2 MB.
CROWD_BITS = 18
#: Ids of documents sent to every task at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_KEY_BITS = (1 << 64) - 1


class Shingles:
    """Sorted distinct shingle hashes of every row of a slice.

    ``hash[bound[r]:bound[r + 1]]`` is the set of row r, in the order of
    ``hash`` (crowded groups last where ``crowded`` is given)."""

    def __init__(self, arr: pa.Array, k: int = SHINGLE, crowded: np.ndarray | None = None):
        texts = Texts(arr)
        start, end, bound = texts.spans(NOT_SPACE)
        row = row_of(bound)
        h = texts.span_hash(texts.prefix(low=True), start, end)
        g, whole = ngrams(h, row, k)
        g, r = g[whole], row[:len(whole)][whole]
        count = np.diff(bound)
        for n in range(1, k):           # fewer words: the whole sequence
            few = np.flatnonzero(count == n)
            if len(few):
                s, _ = ngrams(h, row, n)
                g = np.concatenate([g, mix(s[bound[few]] + np.uint64(n))])
                r = np.concatenate([r, few])
        g = g >> np.uint64(1)           # 63 bits: the sign bit marks crowded ones
        if crowded is not None:
            g |= crowded[(g >> np.uint64(63 - CROWD_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
        order = np.lexsort((g, r))
        g, r = g[order], r[order]
        if len(g):
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])])
            g, r = g[new], r[new]
        self.hash, self.row, self.n = g, r, texts.n
        self.size = np.bincount(r, minlength=texts.n).astype(np.int64)
        self.bound = np.concatenate([[0], np.cumsum(self.size)])

    def plain(self) -> np.ndarray:
        return self.hash & np.uint64((1 << 63) - 1)

    def total(self, values: np.ndarray) -> np.ndarray:
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        return c[self.bound[1:]] - c[self.bound[:-1]]

    def class_ids(self) -> np.ndarray:
        """64-bit digest of every set, the same for any order."""
        p = self.plain()
        d = mix(self.total(mix(p + np.uint64(1))) ^ mix(self.total(mix(p ^ np.uint64(0x5851F42D4C957F2D)))))
        return mix(d + self.size.astype(np.uint64)).view(np.int64)


@lru_cache(maxsize=100_000)
def n_keys(n: int, crowded: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """How many of the first shingles of a set of ``n``, ``crowded`` of them
    at the end of the order, a link must show itself in: the exact prefix
    length, or fewer where the chance to miss falls below ``miss``.  Linked
    sets share at least ``percent`` of either; where fewer are crowded, a
    link shares one of the others, and no crowded shingle is needed."""
    outside = n - -(-percent * n // 100)
    plain = n - crowded
    if 100 * crowded < percent * n:
        parts, most = [(plain, min(outside, plain - 1))], min(outside + 1, plain)
    else:
        rest = max(0, outside - plain)
        parts, most = [(plain, min(outside, plain)), (crowded, rest)], outside + 1
    chance, k = 1.0, 0
    for part, left in parts:
        for i in range(part):
            if chance < miss or k >= most:
                return max(1, min(k, most))
            chance *= max(left - i, 0) / (part - i)
            k += 1
    return max(1, min(k, most))


def crowded_groups(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Which of the ``2**CROWD_BITS`` hash groups hold many more shingle
    occurrences than a random group would: the counts of all documents, each
    task's table summed by slices of the group number."""
    size = 1 << CROWD_BITS

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for piece in text_slices(batch, text_col):
                g = Shingles(piece.column(text_col)).plain()
                total += np.bincount((g >> np.uint64(63 - CROWD_BITS)).astype(np.int64), minlength=size)
        return total
    total = sum_vectors(docs.select(text_col), count, size, np.int64)
    mean = total.mean()
    return total > mean + 6 * np.sqrt(mean) + 64


def points(docs: DataFrame, crowded: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the set's size ``n``, its class ``cid``, the group
    counts ``vec``, the number of ``crowded`` shingles and the routing ``keys``
    (empty sets have none)."""
    shared = docs.sparkSession.sparkContext.broadcast(crowded)
    schema = T.StructType([docs.schema[id_col], field("n", T.LongType()), field("cid", T.LongType()),
                           field("vec", T.ArrayType(T.IntegerType())), field("crowded", T.LongType()),
                           field("keys", T.ArrayType(T.LongType()))])

    def make():
        table = shared.value

        def fn(batch):
            s = Shingles(batch.column(text_col), crowded=table)
            vec = np.bincount(s.row * GROUPS + (s.plain() & np.uint64(GROUPS - 1)).astype(np.int64),
                              minlength=s.n * GROUPS).astype(np.int32)
            late = s.total(s.hash >> np.uint64(63)).astype(np.int64)
            want = np.array([n_keys(int(a), int(b)) if a else 0 for a, b in zip(s.size, late)], dtype=np.int64)
            rank = np.arange(len(s.hash)) - s.bound[s.row]
            keys = s.hash[rank < want[s.row]].view(np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.minimum(want, s.size))]), pa.int32()), pa.array(keys))
            vecs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(vec) + 1, GROUPS), pa.int32()), pa.array(vec))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(s.size), pa.array(s.class_ids()), vecs, pa.array(late), lists],
                names=schema.names)
        return fn
    return map_slices(docs.select(id_col, text_col), text_col, schema, make)


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``wanted`` with the text of the document ``rep`` of every row."""
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return docs.select(id_col, text_col).join(wanted, F.col(id_col) == F.col("rep")).drop(id_col, "rep")


def _may_link(na: Column, nb: Column, va: Column, vb: Column) -> Column:
    """The bound: shared group counts of at least 4/9 of both sizes."""
    bound = F.aggregate(F.zip_with(va, vb, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return ((F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT)
            & (bound * (100 + PERCENT) >= (na + nb) * PERCENT))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Those of the pairs ``(x, m)`` of classes that link.  The set of x goes
    to its partners, so only one side of a pair is shuffled."""
    rep = classes.select("cid", "rep")
    left = stored(pairs.groupBy("x").agg(F.collect_set("m").alias("ms")).join(rep, F.col("x") == F.col("cid"))
                  .select("x", "ms", "rep"), "jaccard-members")
    right = stored(pairs.select(F.col("m").alias("cid")).distinct().join(rep, "cid").select("cid", "rep"),
                   "jaccard-centres")
    sent = T.StructType([field("x", T.LongType()), field("m", T.LongType()), field("sx", T.BinaryType())])
    own = T.StructType([field("cid", T.LongType()), field("sm", T.BinaryType())])

    def make_sent():
        def fn(batch):
            s = Shingles(batch.column(text_col))
            x = batch.column("x").to_numpy()
            for i in np.flatnonzero(s.class_ids() == x):
                raw = s.hash[s.bound[i]:s.bound[i + 1]].tobytes()
                ms = batch.column("ms")[int(i)].values
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ms), x[i])), ms.cast(pa.int64()), pa.array([raw] * len(ms), pa.binary())],
                    names=sent.names)
        return fn

    def make_own():
        def fn(batch):
            s = Shingles(batch.column(text_col))
            raw = [s.hash[a:b].tobytes() for a, b in zip(s.bound, s.bound[1:])]
            same = s.class_ids() == batch.column("cid").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(raw, pa.binary())],
                                             names=own.names).filter(pa.array(same))
        return fn
    a = map_slices(_texts(docs, left, id_col, text_col), text_col, sent, make_sent)
    b = map_slices(_texts(docs, right, id_col, text_col), text_col, own, make_own)
    schema = T.StructType([field("x", T.LongType()), field("m", T.LongType())])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sx"), batch.column("sm")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["x", "m"]).filter(pa.array(keep, pa.bool_()))
    return (a.join(b, F.col("m") == F.col("cid")).select("x", "m", "sx", "sm")
            .mapInArrow(run, schema).distinct())


def _labels(links: DataFrame) -> DataFrame | None:
    """Component label of every node of the links ``(u, v)``.  Each node is
    first hung under its least partner; only the partners' own links, few in
    stars, go through the rounds of :func:`connected_components`."""
    e = stored(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
               .filter("u != v").distinct(), "jaccard-links")
    if e.isEmpty():
        return None
    up = e.groupBy("v").agg(F.min("u").alias("p"))
    over = e.select("u").distinct()
    rest = stored(e.join(up, "v").filter("u != p").select("u", F.col("p").alias("v"))
                  .union(up.join(over, up["v"] == over["u"], "left_semi").select(F.col("v").alias("u"), F.col("p").alias("v")))
                  .distinct(), "jaccard-stars")
    nodes = up.select(F.col("v").alias("id"), F.col("p").alias("comp")).union(over.select(F.col("u").alias("id"), "u"))
    if not rest.isEmpty():
        nodes = _relabel(nodes, connected_components(rest))
    return nodes.groupBy("id").agg(F.min("comp").alias("label"))


def _relabel(rows: DataFrame, labels: DataFrame | None, col: str = "comp") -> DataFrame:
    """Replace node ``col`` by its component where it has one."""
    if labels is None:
        return rows
    lab = labels.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    return (rows.join(lab, rows[col] == lab["_id"], "left")
            .withColumn(col, F.coalesce("_label", col)).drop("_id", "_label"))


def _star_pairs(rows: DataFrame, classes: DataFrame, centre: Column) -> DataFrame:
    """Every member of a key's bucket against the bucket's centre, where they
    are not connected yet and the bound allows a link."""
    mid = rows.groupBy("key").agg(F.min_by("cid", centre).alias("m"))
    pairs = (rows.join(mid, "key").filter(F.col("cid") != F.col("m"))
             .select(F.col("cid").alias("x"), "m").distinct())
    side = {s: classes.select(F.col("cid").alias(s), F.col("n").alias(f"n{s}"), F.col("vec").alias(f"v{s}"),
                              F.col("comp").alias(f"c{s}")) for s in "xm"}
    return (pairs.join(side["x"], "x").join(side["m"], "m").filter(F.col("cx") != F.col("cm"))
            .filter(_may_link(F.col("nx"), F.col("nm"), F.col("vx"), F.col("vm"))).select("x", "m"))


def _leaf_pairs(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs of unconnected classes that share a key and that the bound
    lets link: leaves packed by size within a key, boxes first.  Under a
    crowded key only those are left whose crowded shingles alone are enough
    for a link; all others also meet under a key that is not crowded.  A pair
    comes out under the first of its common keys only."""
    full = rows.select("key", "cid").join(classes.select("cid", "n", "vec", "comp", "crowded", "keys"), "cid")
    place = F.row_number().over(Window.partitionBy("key").orderBy("n", "cid"))
    leaves = (full.withColumn("leaf", F.floor((place - 1) / LEAF))
              .groupBy("key", "leaf").agg(F.min("n").alias("low"), F.max("n").alias("high"),
                                          F.collect_list(F.struct("cid", "comp", "n", "crowded", "vec", "keys")).alias("m")))
    top = F.expr(f"transform(sequence(0, {GROUPS - 1}), i -> array_max(transform(m, x -> x.vec[i])))")
    leaves = leaves.withColumn("box", top)
    left, right = (leaves.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("leaf", "low", "high", "m", "box")])
                   for s in "ab")
    bound = F.aggregate(F.zip_with("box_a", "box_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    opened = (left.join(right, "key").filter(F.col("leaf_a") <= F.col("leaf_b"))
              .filter(F.col("low_b") * PERCENT <= F.col("high_a") * 100)
              .filter(bound * (100 + PERCENT) >= (F.col("low_a") + F.col("low_b")) * PERCENT)
              .select("m_a", "m_b", (F.col("leaf_a") == F.col("leaf_b")).alias("same"), "key"))
    schema = T.StructType([field("x", T.LongType()), field("m", T.LongType())])

    def run(batches):
        for batch in batches:
            for x, y, same, key in zip(batch.column("m_a"), batch.column("m_b"),
                                       batch.column("same").to_pylist(), batch.column("key").to_pylist()):
                (ia, ca, na, la, va), (ib, cb, nb, lb, vb) = (
                    (s.field("cid").to_numpy(), s.field("comp").to_numpy(), s.field("n").to_numpy(),
                     s.field("crowded").to_numpy(), s.field("vec").flatten().to_numpy().reshape(len(s), GROUPS))
                    for s in (x.values, y.values))
                shared = np.minimum(va[:, None, :], vb[None, :, :]).sum(axis=2)
                ok = ((ca[:, None] != cb[None, :])
                      & (shared * (100 + PERCENT) >= (na[:, None] + nb[None, :]) * PERCENT)
                      & (np.minimum(na[:, None], nb[None, :]) * 100 >= np.maximum(na[:, None], nb[None, :]) * PERCENT))
                if key < 0:
                    ok &= (np.minimum(la[:, None], lb[None, :]) * (100 + PERCENT)
                           >= (na[:, None] + nb[None, :]) * PERCENT)
                if same:
                    ok &= ia[:, None] < ib[None, :]
                i, j = np.nonzero(ok)
                if len(i):
                    # without the sign the crowded keys, whose top bit is set, come last
                    ka, kb = ([{k & _KEY_BITS for k in ks} for ks in s.field("keys").to_pylist()]
                              for s in (x.values, y.values))
                    first = [min(ka[p] & kb[q]) == key & _KEY_BITS for p, q in zip(i.tolist(), j.tolist())]
                    i, j = i[first], j[first]
                a, b = np.minimum(ia[i], ib[j]), np.maximum(ia[i], ib[j])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=schema.names)
    return opened.mapInArrow(run, schema).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles`` and
    ``component_id``, the smallest id reachable by links."""
    pts = stored(points(docs, crowded_groups(docs, text_col), id_col, text_col), "jaccard-points")
    known = pts.filter((F.col("n") > 0) & F.col(id_col).isNotNull())
    classes = stored(known.groupBy("cid").agg(
        F.min(id_col).alias("rep"), F.first("n").alias("n"), F.first("vec").alias("vec"),
        F.first("crowded").alias("crowded"), F.first("keys").alias("keys")), "jaccard-classes")
    rows = classes.select(F.explode("keys").alias("key"), "cid")
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    rows = stored(rows.join(shared, "key"), "jaccard-rows")

    # rows that share an id are one node: their classes are connected
    nodes = known.select(F.col(id_col).alias("id"), "cid").distinct()
    edges = stored(nodes.groupBy("id").agg(F.min("cid").alias("u"), F.count("*").alias("c"))
                   .filter("c > 1").join(nodes, "id").select("u", F.col("cid").alias("v")).filter("u != v"),
                   "jaccard-shared-ids")
    comps = classes.select("cid", F.col("cid").alias("comp"), "n", "vec", "crowded", "keys")
    rounds = [lambda r, c: _star_pairs(r, c, F.col("cid")).groupBy("x").agg(F.min("m").alias("m")),
              lambda r, c: _star_pairs(r, c, F.xxhash64("cid", "key")),
              _leaf_pairs]
    for k, find in enumerate(rounds):
        pairs = stored(find(rows, comps), "jaccard-pairs")
        found = edges if k == 0 else None
        if not pairs.isEmpty():
            named = comps.select("cid", "comp")
            links = (_verified(docs, classes, pairs, id_col, text_col)
                     .join(named.withColumnsRenamed({"cid": "x", "comp": "u"}), "x")
                     .join(named.withColumnsRenamed({"cid": "m", "comp": "v"}), "m").select("u", "v"))
            found = links if found is None else links.union(found)
        labels = None if found is None else _labels(found)
        if labels is not None:
            comps = stored(_relabel(comps, labels), "jaccard-components")
        if k < len(rounds) - 1:
            # go on with the keys whose classes are not all connected
            marked = rows.join(comps.select("cid", "comp"), "cid")
            open_keys = (marked.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"))
                         .filter("a != b").select("key"))
            rows = stored(rows.join(open_keys, "key"), "jaccard-rows")
            if rows.isEmpty():
                break

    member = known.select(id_col, "cid").join(comps.select("cid", "comp"), "cid")
    least = member.groupBy("comp").agg(F.min(id_col).alias("component_id"))
    place = comps.select("cid", "comp").join(least, "comp").select("cid", "component_id")
    return (pts.select(id_col, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cid")).alias("cid"))
            .join(place, "cid", "left")
            .select(id_col, "n_shingles",
                    F.when(F.col(id_col).isNotNull(), F.coalesce("component_id", id_col)).alias("component_id")))
